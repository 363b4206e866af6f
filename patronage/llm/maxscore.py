"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

Shards are runs of up to ``SHARD_DOCS`` documents, in which documents stand in
order of length. A term's postings form blocks of ``BLOCK``, each packed by itself
in the fewest bytes its gaps and frequencies need, with the largest frequency
and the least document length in it: as scores rise with the one and fall with
the other, these bound every score of the block under any corpus statistics.

For a query, lists stand by their global bound (weight times the largest block
bound). From the largest on they are essential and are unpacked whole, until the
bounds of all the rest together cannot lift a document that none of the
essential lists holds to the k-th best score. On the rest, a document found so far is
rejected, before anything is unpacked, if what it has and the block maxima
around it stay below the k-th best; only blocks with documents left are
unpacked, and documents go as soon as their bound falls too low. What remains has
its exact score. A task keeps one heap of k a query over its shards, so earlier
shards prune later ones, and the heaps of all tasks merge exactly.

Term weights and lengths use the whole corpus; all arithmetic but the logarithm
is in 64-bit integers: with N documents that hold a term, L terms in all, n terms in a
document, df documents with a term and tf occurrences, a term's weight is
floor(1000 * ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a document scores
weight * (10^9 tf div (1000tf + 12m)) for each term of the query, repeats included.

Terms are maximal runs of ASCII letters and digits and characters beyond ASCII,
only A-Z lower-cased. Null and empty texts hold none and are found by
nothing, and a query without terms finds nothing. Equal documents are rows of
their own, ties go to the smaller id, null ids come last. Every row of
``queries`` is a query of its own, also with a null or repeated id.

Queries are taken in blocks of about ``QUERY_CHARS`` characters, by hash; a block's
terms and weights are what the driver holds and broadcasts at a time.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import store

TOP_K = 20
SHARD_DOCS = 8192
SHARD_WORDS = 4_000_000
BLOCK = 64
STEP = 8                 # essential lists that are unpacked at once
QUERY_CHARS = 4_000_000

# every other ASCII character parts terms, and A-Z become lower case
_TABLE = bytes((c | 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_PARTS = ("lens", "df", "first", "last", "most", "least", "wide", "data")
_TYPES = dict(lens=np.int32, df=np.int32, first=np.int32, last=np.int32, most=np.int32, least=np.int32,
              wide=np.uint8, data=np.uint8)
SCHEMA = "ids array<long>, docs long, words long, terms binary, " + ", ".join(f"{p} binary" for p in _PARTS)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1 of all i, one after another."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that the largest number of a block needs."""
    return 1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)


def pack(lens: np.ndarray, doc: np.ndarray, term: np.ndarray, n_terms: int, block: int = BLOCK) -> dict:
    """The arrays of a shard from one (document, term) pair a word; documents are
    numbered in order of ``lens``."""
    n = max(1, len(lens))
    key, tf = np.unique(term.astype(np.int64) * n + doc, return_counts=True)
    term, doc = key // n, key % n
    df = np.bincount(term, minlength=n_terms)
    blocks = -(-df // block)
    size = np.full(int(blocks.sum()), block)
    size[np.cumsum(blocks)[df > 0] - 1] = (df - (blocks - 1) * block)[df > 0]
    start = np.cumsum(size) - size
    gap = np.diff(doc, prepend=0)
    gap[start] = 0
    if not len(doc):
        none = np.zeros(0, np.int64)
        return dict(lens=lens, df=df, first=none, last=none, most=none, least=none, wide=none, data=none)
    most = np.maximum.reduceat(tf, start)
    of_gap, of_tf = _width(np.maximum.reduceat(gap, start)), _width(most)
    at = np.cumsum(size * (of_gap + of_tf)) - size * (of_gap + of_tf)
    own = np.repeat(np.arange(len(size)), size)
    rank = np.arange(len(doc)) - start[own]
    data = np.zeros(int((size * (of_gap + of_tf)).sum()), np.uint8)
    for values, wide, base in ((gap, of_gap, at), (tf, of_tf, at + size * of_gap)):
        w = wide[own]
        to = base[own] + rank * w
        for j in range(4):
            has = w > j
            data[to[has] + j] = (values[has] >> 8 * j) & 255
    return dict(lens=lens, df=df, first=doc[start], last=doc[start + size - 1], most=most,
                least=np.minimum.reduceat(lens[doc], start), wide=of_gap * 16 + of_tf, data=data)


def _shard_row(ids: list, bags: list[np.ndarray], known: dict) -> pa.RecordBatch:
    lens = np.array([len(b) for b in bags], np.int64)
    order = np.argsort(lens, kind="stable")
    place = np.empty(len(bags), np.int64)
    place[order] = np.arange(len(bags))
    names = sorted(known)
    number = np.empty(len(names), np.int64)
    number[[known[t] for t in names]] = np.arange(len(names))
    term = number[np.concatenate(bags)] if len(names) else np.empty(0, np.int64)
    packed = pack(lens[order], np.repeat(place, lens), term, len(names))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    cols = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())),
            pa.array([int((lens > 0).sum())], pa.int64()), pa.array([int(lens.sum())], pa.int64()),
            pa.array([squeeze(b"\n".join(names))], pa.binary())]
    # block data is stored as it is packed, so that a block can be read without its neighbours
    cols += [pa.array([packed[p].astype(_TYPES[p]).tobytes() if p == "data" else squeeze(packed[p].astype(_TYPES[p]).tobytes())],
                      pa.binary()) for p in _PARTS]
    return pa.RecordBatch.from_arrays(cols, ["ids", "docs", "words", "terms", *_PARTS])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard, written to the shared folder."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches):
        def fresh():
            known = defaultdict()
            known.default_factory = known.__len__  # the next number for each new term
            return [], [], 0, known
        ids, bags, n, known = fresh()
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist()):
                w = terms_of(t)
                ids.append(d)
                bags.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
                n += len(w)
                if len(ids) >= shard_docs or n >= shard_words:
                    yield _shard_row(ids, bags, known)
                    ids, bags, n, known = fresh()
        if ids:
            yield _shard_row(ids, bags, known)

    return store(src.mapInArrow(run, SCHEMA), "maxscore-index")


def _names(batch: pa.RecordBatch, i: int) -> list[bytes]:
    got = zstandard.ZstdDecompressor().decompress(batch.column("terms")[i].as_buffer())
    return got.split(b"\n") if got else []


class Shard:
    """One shard's lists. ``unpacked`` and ``skipped`` count blocks."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_docs: int, n_words: int, block: int = BLOCK):
        spread = zstandard.ZstdDecompressor().decompress
        for p in _PARTS:
            raw = batch.column(p)[i].as_buffer()
            setattr(self, p, np.frombuffer(raw if p == "data" else spread(raw), _TYPES[p]))
        ids = batch.column("ids")[i].values
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.number = {t: k for k, t in enumerate(_names(batch, i))}
        df = self.df.astype(np.int64)
        self.blocks = -(-df // block)
        self.block_at = np.cumsum(self.blocks) - self.blocks
        self.size = np.full(len(self.first), block)
        self.size[np.cumsum(self.blocks) - 1] = df - (self.blocks - 1) * block
        self.of_gap, self.of_tf = self.wide.astype(np.int64) >> 4, self.wide.astype(np.int64) & 15
        width = self.size * (self.of_gap + self.of_tf)
        self.at = np.cumsum(width) - width
        self.m = 75 + 25 * self.lens.astype(np.int64) * n_docs // max(1, n_words)
        self.bound = self.impact(self.most.astype(np.int64), 75 + 25 * self.least.astype(np.int64) * n_docs // max(1, n_words))
        self.list_bound = np.maximum.reduceat(self.bound, self.block_at) if len(df) else np.zeros(0, np.int64)
        self.unpacked = self.skipped = 0

    @staticmethod
    def impact(tf, m):
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def unpack(self, blocks: np.ndarray):
        """(position of the block in ``blocks``, document, impact) of all postings of some blocks."""
        size, of_gap, of_tf = self.size[blocks], self.of_gap[blocks], self.of_tf[blocks]
        own = np.repeat(np.arange(len(blocks)), size)
        start = np.cumsum(size) - size
        rank = np.arange(len(own)) - start[own]
        out = []
        for wide, base in ((of_gap, self.at[blocks]), (of_tf, self.at[blocks] + size * of_gap)):
            w = wide[own]
            at = base[own] + rank * w
            v = self.data[at].astype(np.int64)
            for j in range(1, int(wide.max(initial=1))):
                has = w > j
                v[has] |= self.data[at[has] + j].astype(np.int64) << 8 * j
            out.append(v)
        gap, tf = out
        total = np.cumsum(gap)
        doc = total - total[start][own] + self.first[blocks][own]
        self.unpacked += len(blocks)
        return own, doc, self.impact(tf, self.m[doc])

    def top(self, terms: dict[bytes, int], k: int, floor: int = 0):
        """(document numbers, scores) of the k best and of those that tie with
        the last of them; documents below ``floor`` may be missing."""
        found = [(self.number[t], w) for t, w in terms.items() if w > 0 and t in self.number]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists, weight = (np.array(x, np.int64) for x in zip(*found))
        most = weight * self.list_bound[lists]
        by = np.argsort(-most, kind="stable")
        lists, weight, most = lists[by], weight[by], most[by]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the lists from here on can add
        score = np.zeros(len(self.lens), np.int64)
        i = 0
        while i < len(lists) and rest[i] >= floor:
            part = slice(i, i + STEP)
            n = self.blocks[lists[part]]
            own, doc, hit = self.unpack(_runs(self.block_at[lists[part]], n))
            np.add.at(score, doc, np.repeat(weight[part], n)[own] * hit)
            i += STEP
            if len(score) >= k:
                floor = max(floor, int(np.partition(score, -k)[-k]))
        i = min(i, len(lists))
        doc = np.flatnonzero((score > 0) & (score + rest[i] >= floor))
        left = range(i, len(lists))
        near, more = [], np.zeros(len(doc), np.int64)
        for j in left:  # block maxima around each document
            a = self.block_at[lists[j]]
            b = a + np.searchsorted(self.last[a: a + self.blocks[lists[j]]], doc)
            b[b == a + self.blocks[lists[j]]] = -1
            b[(b >= 0) & (self.first[b] > doc)] = -1
            near.append(b)
            more += np.where(b >= 0, weight[j] * self.bound[b], 0)
        got = score[doc]
        alive = got + more >= floor
        for j, b in zip(left, near):
            here = alive & (b >= 0)
            wanted, own_block = np.unique(b[here], return_inverse=True)
            self.skipped += int(self.blocks[lists[j]]) - len(wanted)
            if len(wanted):
                own, d, hit = self.unpack(wanted)
                key = own * len(self.lens) + d  # ascending: blocks and documents are
                ask = own_block * len(self.lens) + doc[here]
                at = np.minimum(np.searchsorted(key, ask), len(key) - 1)
                got[here] += np.where(key[at] == ask, weight[j] * hit[at], 0)
                more[here] -= weight[j] * self.bound[b[here]]
                alive &= got + more >= floor
        doc, got = doc[alive], got[alive]
        if len(doc) > k:
            keep = got >= np.partition(got, -k)[-k]
            doc, got = doc[keep], got[keep]
        return doc, got


class Heaps:
    """The k best (score, id) of every query of a block over a task's shards."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.floor = k, [None] * n, [0] * n

    def add(self, i: int, score, none, ids) -> None:
        new = (score, none, ids)
        if self.rows[i] is not None:
            new = tuple(np.concatenate(x) for x in zip(self.rows[i], new))
        by = np.lexsort((new[2], new[1], -new[0]))[: self.k]
        self.rows[i] = tuple(x[by] for x in new)
        if len(by) == self.k:
            self.floor[i] = int(self.rows[i][0][-1])

    def batch(self, names) -> pa.RecordBatch:
        held = [(n, r) for n, r in zip(names, self.rows) if r is not None and len(r[0])]
        row = [n[0] for n, r in held for _ in r[0]]
        item = [n[1] for n, r in held for _ in r[0]]
        score, none, ids = (np.concatenate([r[c] for _, r in held]) if held else np.zeros(0, np.int64) for c in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(item, pa.int64()),
             pa.array(ids.astype(np.int64), pa.int64(), mask=none.astype(bool)), pa.array(score.astype(np.int64))],
            ["row", "item_id", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text",
           query_col: str = "item_id", shard_docs: int = SHARD_DOCS, query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score
    above 0 for every row of ``queries`` (columns item_id, text)."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, shard_docs)
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = total["docs"] or 0, total["words"] or 0
    asked = store(queries.select(F.monotonically_increasing_id().alias("row"), queries[query_col].cast("long").alias("item_id"),
                                 F.coalesce(queries["text"].cast("string"), F.lit("")).alias("_text")), "maxscore-queries")
    chars = asked.agg(F.sum(F.length("_text") + 1)).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / query_chars))
    found = None
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block).collect()
        bags = [Counter(terms_of(r["_text"])) for r in rows]
        vocabulary = spark.sparkContext.broadcast(sorted(set().union(*bags)))

        def count(batches, vocabulary=vocabulary):
            for b in batches:
                for i in range(b.num_rows):
                    known = {t: n for n, t in enumerate(_names(b, i))}
                    df = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("df")[i].as_buffer()), np.int32)
                    hit = [(j, df[known[t]]) for j, t in enumerate(vocabulary.value) if t in known]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.int64()),
                                                      pa.array([x[1] for x in hit], pa.int64())], ["term", "df"])

        df = dict(index.select("terms", "df").mapInArrow(count, "term long, df long")
                       .groupBy("term").agg(F.sum("df").alias("df")).collect())
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[j] + 1)))
                  for j, t in enumerate(vocabulary.value) if j in df}
        shared = spark.sparkContext.broadcast(([(r["row"], r["item_id"]) for r in rows],
                                               [{t: c * weight[t] for t, c in bag.items() if t in weight} for bag in bags]))

        def run(batches, shared=shared):
            names, wanted = shared.value
            heaps = Heaps(len(names), k)
            for b in batches:
                for i in range(b.num_rows):
                    shard = Shard(b, i, n_docs, n_words)
                    for q, terms in enumerate(wanted):
                        doc, score = shard.top(terms, k, heaps.floor[q])
                        if len(doc):
                            heaps.add(q, score, shard.none[doc], shard.ids[doc])
                    del shard  # one at a time in memory
            yield heaps.batch(names)

        part = store(index.mapInArrow(run, "row long, item_id long, doc_id long, score long"), "maxscore-found")
        found = part if found is None else found.unionAll(part)
        vocabulary.unpersist()
        shared.unpersist()
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
                 .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
