"""Detection of periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q and at least ``least`` words and
``times`` * q of them that cannot be extended with that period. Texts of a
record batch are one sequence in which every document has words of its own, so
that no match crosses documents:

1. Prefix doubling sorts the suffixes; on the way, the rank of each position by its
   first 2^k words names every block of that length and is the start of its
   interval in the suffix array.
2. A wavelet matrix over the suffix array counts the entries of an interval below a
   position and returns the next ones from there (range successor).
3. A run of period q, 2^k <= q < 2^(k+1), holds an aligned block of 2^k words
   that occurs again q words on. So each aligned block asks for its occurrences in the
   2^k starts from 2^k on. There are at most two, or they form an
   arithmetic progression whose difference d is the block's period. One or two give
   a candidate period each. In a progression, the stretch of period d around the block
   ends inside the run and ends again q on, so the distance of the two ends is the one
   candidate.
4. Candidates are extended both ways by the block ranks, a level at a time, and kept if long
   enough and not periodic with q / f for a prime f of q.

With exponents from 4 on (``times`` >= 4) nothing is missed; smaller ones are refused.

Null texts have no words. Where ``rewrite`` is set, documents whose crc32 of the
id calls for it are read with a stretch of them repeated (the contract's planting);
a null id plants nothing. Equal rows are judged alike, row by row.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
TIMES = 4
SLICE_WORDS = 400_000   # words of the documents that are sorted together; a longer document stands alone


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (x20, x09-x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(doc_id: int | None, words: list) -> list:
    """The words with the contract's repetition in documents chosen by id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a: a + p]
    return words[:a] + (again * (-(-(n - a) // p)))[: n - a]


def block_ranks(symbol: np.ndarray):
    """(suffix array, ranks): ranks[k][i] is the place in the suffix array where the suffixes
    that share the first 2^k symbols of i begin; levels go on until all differ."""
    n = len(symbol)
    order = np.argsort(symbol, kind="stable").astype(np.int64)
    s = symbol[order]
    rank = np.empty(n, np.int64)
    rank[order] = _heads(s[1:] != s[:-1], np.arange(n))
    ranks, h = [rank], 1
    slots = np.arange(n)
    while True:
        r = ranks[-1]
        shared = _shared(r[order[slots]])
        slots = slots[shared]
        if not len(slots):
            return order, ranks
        at = order[slots]
        nxt = at + h
        key = r[at] * (n + 1) + np.where(nxt < n, r[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, order[slots] = key[by], at[by]
        new = r.copy()
        new[order[slots]] = _heads(key[1:] != key[:-1], slots)
        ranks.append(new)
        h *= 2


def _heads(differs: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot where the group of each slot begins."""
    first = np.concatenate([[True], differs]) if len(slots) else np.zeros(0, bool)
    return slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]


def _shared(group: np.ndarray) -> np.ndarray:
    """Whether each value of an array with equal ones adjacent has a neighbour like it."""
    same = group[1:] == group[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(group) else np.zeros(0, bool)


class WaveletMatrix:
    """Counts and successors of values in ranges of an array, many at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        v = values
        for b in range(bits - 1, -1, -1):
            bit = (v >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(v) - int(bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def below(self, l: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values l..r-1 are less than x."""
        n, size, beyond = np.zeros(len(l), np.int64), r - l, x >> self.bits > 0
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            l1, r1 = ones[l].astype(np.int64), ones[r].astype(np.int64)
            up = (x >> b) & 1 == 1
            n += np.where(up, (r - l) - (r1 - l1), 0)
            l, r = np.where(up, zeros + l1, l - l1), np.where(up, zeros + r1, r - r1)
        return np.where(beyond, size, n)

    def nth(self, l: np.ndarray, r: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of rank n (from 0) among the values l..r-1."""
        out = np.zeros(len(l), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            l1, r1 = ones[l].astype(np.int64), ones[r].astype(np.int64)
            low = (r - l) - (r1 - l1)
            up = n >= low
            out |= np.where(up, 1 << b, 0)
            n = np.where(up, n - low, n)
            l, r = np.where(up, zeros + l1, l - l1), np.where(up, zeros + r1, r - r1)
        return out


class Matcher:
    """Common extensions of positions by block ranks."""

    def __init__(self, ranks: list[np.ndarray]):
        self.ranks, self.n = ranks, len(ranks[0])

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            go = j < self.n
            go[go] = r[i[go]] == r[j[go]]
            i[go] += 1 << k
            j[go] += 1 << k
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree (i < j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            go = i >= 1 << k
            go[go] = r[i[go] - (1 << k)] == r[j[go] - (1 << k)]
            i[go] -= 1 << k
            j[go] -= 1 << k
        return start - i

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` (1 or more) words from i and from j on agree, by two blocks that cover them."""
        level = np.log2(size).astype(np.int64)
        level -= (1 << level) > size
        level += (2 << level) <= size
        out = np.zeros(len(i), bool)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            if k < len(self.ranks):
                r, back = self.ranks[k], size[at] - (1 << int(k))
                out[at] = (r[i[at]] == r[j[at]]) & (r[i[at] + back] == r[j[at] + back])
        return out


def _primes(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] if q > 1 else out


def periodic_runs(symbol: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Arrays (start, length, period) of all runs, by start, then period. ``starts`` are the
    positions where documents begin; no symbol stands in two documents."""
    if times < 4:
        raise ValueError("times must be 4 or more")
    none = np.zeros(0, np.int64)
    n = len(symbol)
    if n < least:
        return none, none, none
    order, ranks = block_ranks(symbol)
    match = Matcher(ranks)
    own = np.zeros(n, np.int64)
    own[starts[starts < n][1:]] = 1
    offset = np.arange(n) - starts[starts < n][np.cumsum(own)]
    found_b = [np.flatnonzero(symbol[1:] == symbol[:-1])]  # one-word blocks: the window is the next word
    found_q = [np.ones(len(found_b[0]), np.int64)]
    if len(ranks) > 1:
        # only suffixes whose first two words come again can be asked for
        shared = _shared(ranks[1][order])
        place = np.concatenate([[0], np.cumsum(shared)])
        tree = WaveletMatrix(order[shared], max(1, (n - 1).bit_length()))
        for k in range(1, len(ranks)):
            r, size = ranks[k], 1 << k
            count = np.bincount(r, minlength=n)
            b = np.flatnonzero((offset & (size - 1) == 0) & (count[r] > 1))
            lo, hi = place[r[b]], place[r[b] + count[r[b]]]
            first = tree.below(lo, hi, b + size)
            many = tree.below(lo, hi, b + 2 * size) - first
            some = many > 0
            b, lo, hi, first, many = b[some], lo[some], hi[some], first[some], many[some]
            if not len(b):
                continue
            one = tree.nth(lo, hi, first)
            found_b.append(b[many <= 2])
            found_q.append((one - b)[many <= 2])
            two = many >= 2
            b, one, many = b[two], one[two], many[two]
            second = tree.nth(lo[two], hi[two], first[two] + 1)
            found_b.append(b[many == 2])
            found_q.append((second - b)[many == 2])
            row = many > 2
            b, one, d = b[row], one[row], (second - one)[row]
            q = one + match.right(one, one + d) - b - match.right(b, b + d)
            fits = (q >= size) & (q < 2 * size)
            found_b.append(b[fits])
            found_q.append(q[fits])
    b, q = np.concatenate(found_b), np.concatenate(found_q)
    s = b - match.left(b, b + q)
    length = b + q + match.right(b, b + q) - s
    keep = length >= np.maximum(least, times * q)
    at = np.unique(np.stack([s[keep], q[keep], length[keep]]), axis=1)
    s, q, length = at
    smallest = np.ones(len(s), bool)
    for value in np.unique(q):
        mine = np.flatnonzero(q == value)
        for f in _primes(int(value)):
            smallest[mine] &= ~match.same(s[mine], s[mine] + value // f, q[mine])
    return s[smallest], length[smallest], q[smallest]


def _slices(sizes: np.ndarray, limit: int):
    """Consecutive index ranges of at most ``limit`` words, or one document."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def find_runs(docs: list[list], least: int = LEAST, times: int = TIMES, slice_words: int = SLICE_WORDS):
    """For each document (a list of words) its runs as an array of rows (start, length, period)."""
    for a, z in _slices(np.array([len(d) for d in docs], np.int64), slice_words):
        sizes = np.array([len(d) for d in docs[a:z]], np.int64)
        flat = pa.array([w for d in docs[a:z] for w in d], pa.binary()).dictionary_encode()
        word = flat.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(z - a), sizes)
        starts = np.cumsum(sizes) - sizes
        s, length, q = periodic_runs(doc * (len(flat.dictionary) + 1) + word, np.unique(starts), least, times)
        of = doc[s] if len(s) else s
        local = np.stack([s - starts[of], length, q], axis=1) if len(s) else np.zeros((0, 3), np.int64)
        cut = np.searchsorted(of, np.arange(z - a + 1))
        for i in range(z - a):
            yield local[cut[i]: cut[i + 1]]


def kept_words(words: list, runs: np.ndarray) -> list:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES,
             rewrite: bool = False, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed (the words kept, one space
    between) of every row."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            docs = [words_of(t) for t in b.column("_text").to_pylist()]
            if rewrite:
                docs = [planted(i, w) for i, w in zip(ids, docs)]
            found = list(find_runs(docs, least, times, slice_words))
            sizes = np.array([len(f) for f in found], np.int64)
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)], ["start", "length", "period"]))
            text = [b" ".join(kept_words(w, f)).decode("utf-8", "surrogatepass") for w, f in zip(docs, found)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(w) for w in docs], pa.int64()), runs,
                                              pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_report(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """The contract's digest of ``annotate``."""
    best = ("array_max(transform(runs, x -> struct(x.length as length, -x.start as back, -x.period as short)))")
    listed = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')"
    return (annotate(docs, rewrite=rewrite).selectExpr("*", f"{best} as _best").selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "-_best.back as start", "_best.length as length",
        "-_best.short as period", "1000 * _best.length div -_best.short as exponent_milli",
        f"sha2({listed}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256"))
