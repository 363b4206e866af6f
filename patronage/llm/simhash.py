"""SimHash near-dedup with pivot distance tables.

Every document gets a 64-bit SimHash of its word shingles. Distinct
fingerprints are classes. A table holds, for each class, its Hamming distances
to ``PIVOTS`` reference fingerprints, computed once. By the triangle
inequality two fingerprints within ``max_bits`` differ by at most
``max_bits`` in every coordinate of that table, so a pair whose largest
coordinate difference exceeds it is discarded; survivors are verified on the
fingerprints themselves.

Pairs are not taken from all rows: 64 bits are cut into ``max_bits + 2``
blocks, and fingerprints that differ in at most ``max_bits`` bits agree on at
least two blocks, so classes meet in the buckets of their block pairs (lossless).
Large buckets are split into block pairs (``common.split_buckets``). Links
leave a task reduced to star edges, never as all pairs of a group.

Null or word-free texts have fingerprint zero and link like any other; equal
fingerprints are one class however many rows share it; a null doc_id is
ignored when a component is named (null if there is no other). Extra columns
are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import (EdgeSink, components, group_pairs, row_keys, split_buckets, store,
                                  whole_groups)

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
PIVOTS = 16
BLOCK_ROWS = 512


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    buf = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[: len(words) - shingle]]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(buf[a:b], HASH_SEED) for a, b in zip(starts, ends[shingle - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a: a + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, fp) for every row; fp as a signed long."""
    src = docs.select(docs[id_col].alias("doc_id"), *row_keys(docs[id_col], docs[text_col]),
                      docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_k1"), b.column("_k2"), pa.array(fp.view(np.int64))],
                ["doc_id", "_k1", "_k2", "fp"])

    return src.mapInArrow(run, src.drop("_text").schema.add("fp", "long"))


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """Signed 64-bit reference fingerprints, spread by hashing 0..n-1."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), HASH_SEED)).astype(np.int64)) for i in range(n)]


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Signed masks of all pairs of ``max_bits + 2`` near-equal bit blocks."""
    m = max_bits + 2
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [int(np.uint64(x | y).astype(np.int64)) for x, y in combinations(blocks, 2)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(classes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK_ROWS) -> DataFrame:
    """Star edges (a, b) between distinct fingerprints, column ``fp``, whose
    components are those of all pairs within ``max_bits`` bits."""
    pivots = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in reference_fingerprints()]
    table = classes.select("fp", F.array(*pivots).alias("dist"))
    keyed = table.withColumn("_b", F.explode(F.array(*[
        F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(block_masks(max_bits))])))
    rows = split_buckets(keyed.withColumnRenamed("_b", "bucket"), "bucket", "fp", block)

    def run(batches):
        sink = EdgeSink()
        for t in whole_groups(batches, "g"):
            t = t.combine_chunks()
            fp = t.column("fp").to_numpy().astype(np.int64)
            bits = fp.view(np.uint64)
            dist = t.column("dist").combine_chunks().flatten().to_numpy().reshape(len(fp), -1).astype(np.int8)
            for i, j in group_pairs(t.column("g").to_numpy(), t.column("own").to_numpy(),
                                    t.column("diag").to_numpy(zero_copy_only=False)):
                near = np.abs(dist[i] - dist[j]).max(axis=1) <= max_bits
                i, j = i[near], j[near]
                near = _popcount(bits[i] ^ bits[j]) <= max_bits
                i, j = i[near], j[near]
                real = fp[i] != fp[j]
                sink.add(fp[i[real]], fp[j[real]])
        a, b = sink.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("g", "own", "diag", "fp", "dist").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int):
    """The fingerprint table and (fp, root, component_id) of its classes."""
    fps = store(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("_first")), "simhash-classes")
    comp = components(links(classes, max_bits), "simhash")
    rooted = (classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                     .withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return fps, rooted.select("fp", "root").join(names, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id reachable over links of at most ``max_bits`` bits, for every row."""
    fps, groups = _grouped(docs, id_col, text_col, shingle, max_bits)
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row left of each near-duplicate group: that with the
    smallest doc_id (nulls last), repeated rows included."""
    from pyspark.sql import Window

    fps, groups = _grouped(docs, id_col, text_col, shingle, max_bits)
    best = (fps.join(groups.select("fp", "root"), "fp")
               .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")).alias("m"))
               .select("m._k1", "m._k2"))
    key = ["_k1", "_k2"]
    marked = docs.select(*[docs[c] for c in docs.columns], *row_keys(docs[id_col], docs[text_col]))
    kept = marked.join(best, key, "left_semi")
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return kept.withColumn("_turn", turn).filter("_turn = 1").select(*docs.columns)
