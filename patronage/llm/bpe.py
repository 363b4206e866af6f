"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A slice of the corpus (the texts a task holds, up to ``REPLAY_PIECES`` piece
occurrences) is reduced to its distinct pieces. All their bytes lie in one
linked list, and an inverted index maps each merge rank to the positions of
its pairs. Ranks are taken in order from a heap; a merge is applied at all its
positions at once, the leftmost in each piece first, and only the two touched
neighbours get new pairs. A pair that appears with a lower rank is taken next,
so each piece sees the same merges in the same order as a one-piece encoder
(a repeated pair goes back to the index until no lower rank is left).

No row leaves its task: neither a shuffle nor a broadcast is needed, work and
memory follow the text of one slice, and a lost executor costs its tasks only.

Nulls and empty texts encode to no ids; very long texts are encoded whole
(they only close a slice early); repeated rows give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patronage.llm.pretok import Interner, intern_pieces, text_groups

REPLAY_PIECES = 1_000_000  # piece occurrences that share one replay: bounds a task's memory
NO_RANK = np.int32(2**31 - 1)


class Ranks:
    """A rank file: token bytes by id, and the table pair -> merged token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.ids.values()) + 1)
        keys, merged = [], []
        for t, r in self.ids.items():
            self.token[r] = t
            for i in range(1, len(t)):
                a, b = self.ids.get(t[:i]), self.ids.get(t[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    merged.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.byte = np.array([self.ids[bytes([i])] for i in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it cannot merge."""
        k = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.merged[at], NO_RANK)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(pieces: list[bytes], ranks: Ranks):
    """Ids of distinct non-empty pieces: one flat array and offsets into it."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(lens.sum())
    end = np.cumsum(lens)
    tok = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
    nxt = np.arange(1, n + 1, dtype=np.int32)
    prv = np.arange(-1, n - 1, dtype=np.int32)
    nxt[end - 1] = -1
    prv[end - lens] = -1
    rank = np.full(n, NO_RANK, np.int32)
    left = np.flatnonzero(nxt >= 0)
    rank[left] = ranks.rank(tok[left], tok[left + 1])
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(at: np.ndarray):
        """Enter positions in the index under their pairs' ranks."""
        at = at[rank[at] != NO_RANK]
        if not len(at):
            return
        r = rank[at]
        if len(at) > 1:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            heads = r[np.concatenate([[0], cuts])].tolist()
            parts = np.split(at, cuts)
        else:
            heads, parts = r.tolist(), [at]
        for h, p in zip(heads, parts):
            if h in index:
                index[h].append(p)
            else:
                index[h] = [p]
                heapq.heappush(heap, h)

    post(left)
    while heap:
        r = heapq.heappop(heap)
        got = index.pop(r)
        at = got[0] if len(got) == 1 else np.concatenate(got)
        at = at[rank[at] == r]
        if len(at) > 1:
            at.sort()
            p = piece[at]
            first = np.empty(len(at), bool)
            first[0] = True
            np.not_equal(p[1:], p[:-1], out=first[1:])
            if not first.all():
                later = ~first
                later[1:] &= at[1:] != at[:-1]
                index[r] = [at[later]]
                heapq.heappush(heap, r)
                at = at[first]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        tok[at] = r
        nxt[at] = after
        alive[gone] = False
        rank[gone] = NO_RANK
        rank[at] = NO_RANK
        has = after >= 0
        here, after = at[has], after[has]
        prv[after] = here
        rank[here] = ranks.rank(tok[here], tok[after])
        before = prv[at]
        has = before >= 0
        before = before[has]
        rank[before] = ranks.rank(tok[before], tok[at[has]])
        post(np.concatenate([here, before]))
    counts = np.bincount(piece[alive], minlength=len(pieces))
    return tok[alive], np.concatenate([[0], np.cumsum(counts)])


def encode_pieces(pieces: list[str], ranks: Ranks):
    """Ids of distinct pieces as (flat ids, begin and size of each piece); a
    piece that is itself a token is that token, the rest are replayed."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    one = np.fromiter((ranks.ids.get(p, -1) for p in raw), np.int32, len(raw))
    rest = np.flatnonzero(one < 0)
    flat, off = replay([raw[i] for i in rest.tolist()], ranks) if len(rest) else (np.empty(0, np.int32), [0])
    begin, size = np.arange(len(raw)), np.ones(len(raw), np.int64)
    begin[rest] = len(raw) + np.asarray(off[:-1])
    size[rest] = np.diff(off)
    return np.concatenate([one, flat]), begin, size


def decode_ids(ids, ranks: Ranks) -> bytes:
    """The bytes of a sequence of ids."""
    return b"".join(map(ranks.token.__getitem__, ids))


class Slice:
    """Texts that share one replay: their pieces by number, no text is kept."""

    def __init__(self):
        self.seen, self.idx, self.counts, self.n = Interner(), [], [], 0

    def add(self, texts: list[str]):
        for a, b in text_groups(texts):
            idx, counts = intern_pieces(texts[a:b], self.seen)
            self.idx.append(idx)
            self.counts.append(counts)
            self.n += len(idx)

    def encoded(self, ranks: Ranks):
        """For each text in order: its ids, as an int32 array."""
        flat, begin, size = encode_pieces(self.seen.order, ranks)
        for idx, counts in zip(self.idx, self.counts):
            lens = size[idx]
            total = int(lens.sum())
            stop = np.cumsum(lens)
            src = np.arange(total) + np.repeat(begin[idx] - (stop - lens), lens)
            ids = flat[src]
            cut = np.concatenate([[0], np.cumsum(counts)])
            at = np.concatenate([[0], stop])[cut]
            for i in range(len(counts)):
                yield ids[at[i]: at[i + 1]]


def encoded_batches(batches, text_col: str, path: str, pieces: int = REPLAY_PIECES):
    """(record batch, ids of each of its rows), replayed slice by slice."""
    ranks = load_ranks(path)
    held, sl = [], Slice()

    def flush():
        ids = sl.encoded(ranks)
        for b in held:
            yield b, [next(ids) for _ in range(b.num_rows)]

    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            sl.add([t or "" for t in part.column(text_col).to_pylist()])
            held.append(part.drop_columns([text_col]) if part.num_columns > 1 else part)
            if sl.n >= pieces:
                yield from flush()
                held, sl = [], Slice()
    yield from flush()


def _sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple = ("doc_id",),
           pieces: int = REPLAY_PIECES, verify: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (array<int>) of every row's
    whole text. Other columns, also ones with these names, are dropped. With
    ``verify``, the ids are decoded in the same pass and a row that does not
    give its text again (compared by sha256) raises."""
    src = df.select(*keep, df[text_col].cast("string").alias("_text"))
    schema = src.drop("_text").schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        ranks, texts = load_ranks(path), deque()

        def digests():
            for b in batches:
                if verify:
                    texts.extend(_sha256((t or "").encode("utf-8", "surrogatepass")) for t in b.column("_text").to_pylist())
                yield b

        for b, ids in encoded_batches(digests(), "_text", path, pieces):
            if verify:
                for k, i in enumerate(ids):
                    if _sha256(decode_ids(i.tolist(), ranks)) != texts.popleft():
                        row = {c: b.column(c)[k].as_py() for c in keep}
                        raise ValueError(f"decoded ids differ from the text of row {row}")
            cols = [b.column(c) for c in keep]
            off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            cols += [pa.array(np.diff(off).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids"])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) from an id array; null ids give null."""
    schema = df.drop("decoded").schema.add("decoded", "binary")
    names = [f.name for f in schema]

    def run(batches):
        ranks = load_ranks(path)
        for b in batches:
            out = [None if i is None else decode_ids(i, ranks) for i in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:-1]] + [pa.array(out, pa.binary())], names)

    return df.drop("decoded").mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, path: str, text_col: str = "text",
                      pieces: int = REPLAY_PIECES) -> DataFrame:
    """doc_id, n_tokens, sha256 of the decimal ids joined by a space, and
    sha256 of the bytes decoded from those ids, encoded and decoded in one
    pass so that ids never travel."""
    src = df.select("doc_id", df[text_col].cast("string").alias("_text"))

    def run(batches):
        ranks = load_ranks(path)
        decimal = [str(i).encode() for i in range(len(ranks.token))]
        for b, ids in encoded_batches(batches, "_text", path, pieces):
            lists = [i.tolist() for i in ids]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"),
                pa.array([len(i) for i in lists], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(map(decimal.__getitem__, i))).hexdigest() for i in lists]),
                pa.array([hashlib.sha256(decode_ids(i, ranks)).hexdigest() for i in lists]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, src.drop("_text").schema.add("n_tokens", "long")
                          .add("ids_sha256", "string").add("decoded_sha256", "string"))
