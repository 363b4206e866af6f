"""Line dedup by winnowing over line hashes.

A document is its sequence of non-blank lines (white space collapsed), each a
128-bit hash. A gram is the shortest run of lines from a line on with
``gram`` words; a window is the grams inside the shortest run with
``least`` words. The least gram hash of every window is a fingerprint, so
any repeated run of ``least`` words or more holds a fingerprint that is
selected in each of its copies, whatever surrounds them. Positions are joined on
fingerprints that occur more than once, each occurrence is extended both ways,
line by line, over the reach of a window, and the extended runs are matched by their hashes:
an occurrence is deleted unless it is the first (by doc_id, then line). Fingerprints lie no
further apart than a window, so the extended runs cover a repeated run of any length from end to end.

Levels follow each other through the same steps, each on the lines that are left.
The first has windows of ``LEVELS[0]`` words over single lines: it takes repeated passages of
several lines and needs a fraction of all lines for it. In the last each
window is one line, and takes repeated lines that stand alone or in runs too
short for the first. As a first occurrence is never deleted, the lines left are enough to
find every later one. What goes in the end is exactly: every non-blank line
that stands earlier.

With one level of wider windows (``gram``, ``least``), what goes is the lines that lie in a run
of ``least`` words or more that stands earlier, and those that extend a repeated
fingerprint; shorter ones stay.

Matching is a grouped minimum, so a line shared by a third of all documents is
never expanded into pairs.

Null texts stay null, empty ones empty. Rows with the same doc_id and text are
the same document and get the same result. Null doc_ids count as last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import row_keys, store

MIN_WORDS = 1   # repeated runs of so many words are found for certain in the last level: any non-blank line
GRAM_WORDS = 1  # words that a fingerprint covers
LEVELS = ((GRAM_WORDS, 150), (GRAM_WORDS, MIN_WORDS))  # (gram, window) of each level, in words


def line_hashes(text: str):
    """128-bit hash (16 bytes each) and word count of the non-blank lines."""
    out, words = [], []
    for line in text.split("\n"):
        w = line.split()
        if w:
            out.append(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")))
            words.append(len(w))
    return b"".join(out), words


def run_hash(lines: bytes, a: int, b: int) -> bytes:
    """Hash of the lines a..b (b included)."""
    return xxhash.xxh3_128_digest(lines[16 * a: 16 * (b + 1)])


def _ends(words: np.ndarray, need: int) -> np.ndarray:
    """For each line the last line of the shortest run of ``need`` words from
    it; the number of lines where the text ends before."""
    total = np.concatenate([[0], np.cumsum(words)])
    return np.searchsorted(total, total[:-1] + need, side="left") - 1


def fingerprints(lines: bytes, words: list[int], gram: int = GRAM_WORDS, least: int = MIN_WORDS, gone=()):
    """Selected grams of a document: {first line: (last line, hash)}. Lines in the
    runs ``gone`` are in no gram; the lines around them count as neighbours."""
    n = len(words)
    if gone:
        left = np.ones(n, bool)
        for a, z in gone:
            left[a: z + 1] = False
        at = np.flatnonzero(left).tolist()
        kept = b"".join(lines[16 * i: 16 * i + 16] for i in at)
        return {at[a]: (at[z], h) for a, (z, h) in fingerprints(kept, [words[i] for i in at], gram, least).items()
                if at[z] - at[a] == z - a}
    if least <= 1:
        return {i: (i, run_hash(lines, i, i)) for i in range(n)}
    w = np.array(words, np.int64)
    gram_end, run_end = _ends(w, gram).tolist(), _ends(w, least).tolist()
    hashes = [run_hash(lines, i, gram_end[i]) if gram_end[i] < n else None for i in range(n)]
    chosen = {}
    for i in range(n):
        e = run_end[i]
        if e >= n:
            break
        best = i
        j = i + 1
        while j <= e and gram_end[j] <= e:
            if hashes[j] <= hashes[best]:
                best = j
            j += 1
        chosen[best] = (gram_end[best], hashes[best])
    return chosen


def extensions(words: list[int], a: int, b: int, least: int = MIN_WORDS):
    """Runs that extend lines a..b to the right and to the left, up to the
    reach of a window of ``least`` words beyond them; a..b itself first."""
    yield a, b
    got, j = 0, b + 1
    while j < len(words) and got < least:
        yield a, j
        got += words[j]
        j += 1
    got, i = 0, a - 1
    while i >= 0 and got < least:
        yield i, b
        got += words[i]
        i -= 1


def _halves(h: bytes) -> tuple[int, int]:
    return (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_k1, _k2 (the document), doc_id, lines (hashes) and words of every row."""
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), *row_keys(docs[id_col], docs[text_col]),
                      docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            got = [line_hashes(t or "") for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("_k1"), b.column("_k2"),
                pa.array([g[0] for g in got], pa.binary()),
                pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["doc_id", "_k1", "_k2", "lines", "words"])

    return src.mapInArrow(run, src.drop("_text").schema.add("lines", "binary").add("words", T.ArrayType(T.IntegerType())))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  gram: int | None = None, least: int | None = None, levels=LEVELS) -> DataFrame:
    """(_k1, _k2, runs): for each document with something to delete, the runs
    (first, last non-blank line) that stand earlier too. ``gram`` and ``least``
    ask for a single level."""
    if least is not None:
        levels = ((gram or least, least),)
    table = store(line_table(docs, id_col, text_col), "lines")
    found = None
    for gram, least in levels:
        later = later_runs(extended_runs(table, gram, least, found))
        # copies of a row are one document: their runs are the same
        part = later.groupBy("_k1", "_k2", "a").agg(F.max("z").alias("z"))
        if found is not None:
            part = part.unionAll(found.select("_k1", "_k2", F.inline("runs")))
        found = store(part.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("a", "z")).alias("runs")), "lines-found")
    return found


def later_runs(runs: DataFrame) -> DataFrame:
    """The occurrences of runs of equal hash but the first of each."""
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2", "a")
    # written, so that the join reads both sides from exchanges and a hot line can be dealt over tasks
    first = store(runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                      .filter("first <> last").select("h1", "h2", "first"), "lines-first")
    return runs.join(first, ["h1", "h2"]).filter(place > F.col("first"))


def extended_runs(table: DataFrame, gram: int, least: int, gone: DataFrame | None = None) -> DataFrame:
    """_k1, _k2, doc_id, a, z and hash of the repeated fingerprints of a line
    table and of the runs that extend them; lines in the runs ``gone`` are left out."""
    source = table.select("_k1", "_k2", "lines", "words")
    source = source.join(gone, ["_k1", "_k2"], "left") if gone is not None else source.withColumn(
        "runs", F.lit(None).cast("array<struct<a:int,z:int>>"))

    def select(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for k1, k2, lines, words, runs in zip(*(b.column(c).to_pylist() for c in ("_k1", "_k2", "lines", "words", "runs"))):
                for a, (z, h) in fingerprints(lines, words, gram, least, [(r["a"], r["z"]) for r in runs or ()]).items():
                    for col, v in zip(out, (k1, k2, a, z, *_halves(h))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2)],
                ["_k1", "_k2", "a", "z", "h1", "h2"])

    marks = store(source.mapInArrow(select, "_k1 long, _k2 long, a int, z int, h1 long, h2 long"), "lines-marks")
    shared = marks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    spots = (marks.join(shared, ["h1", "h2"], "left_semi")
                  .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("a", "z")).alias("spots")))

    def extend(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for k1, k2, doc, lines, words, spots in zip(*(b.column(c).to_pylist() for c in (
                    "_k1", "_k2", "doc_id", "lines", "words", "spots"))):
                done = set()
                for s in spots:
                    for r in extensions(words, s["a"], s["z"], least):
                        if r not in done:
                            done.add(r)
                            for col, v in zip(out, (k1, k2, doc, *r, *_halves(run_hash(lines, *r)))):
                                col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2)],
                ["_k1", "_k2", "doc_id", "a", "z", "h1", "h2"])

    return store(table.join(spots, ["_k1", "_k2"]).select("_k1", "_k2", "doc_id", "lines", "words", "spots")
                      .mapInArrow(extend, "_k1 long, _k2 long, doc_id long, a int, z int, h1 long, h2 long"),
                 "lines-runs")


def cut_lines(text: str, runs: list[tuple[int, int]]):
    """(text without the runs, numbers of the lines taken out, words taken out);
    lines are numbered from 0 with blank ones."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.split()]
    gone = {full[k] for a, z in runs for k in range(a, z + 1)}
    words = sum(len(lines[i].split()) for i in gone)
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), sorted(gone), words


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                gram: int | None = None, least: int | None = None, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from ``text_col``; with
    ``drop_emptied``, rows that lose all their words go."""
    runs = repeated_runs(docs, id_col, text_col, gram, least)
    keyed = docs.select(*[docs[c] for c in docs.columns], *row_keys(docs[id_col], docs[text_col]))
    src = keyed.join(runs, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            texts, keep = [], []
            for t, r in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if r:
                    t = cut_lines(t, [(x["a"], x["z"]) for x in r])[0]
                texts.append(t)
                keep.append(not (drop_emptied and r and not t.split()))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out if all(keep) else out.filter(pa.array(keep))

    return src.mapInArrow(run, docs.schema)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 gram: int | None = None, least: int | None = None) -> DataFrame:
    """For every row: doc_id, n_lines, n_removed, words_removed, removed (line
    numbers joined by commas) and kept_sha256 of the text that is left."""
    import hashlib

    runs = repeated_runs(docs, id_col, text_col, gram, least)
    src = (docs.select(docs[id_col].cast("long").alias("doc_id"), *row_keys(docs[id_col], docs[text_col]),
                       docs[text_col].cast("string").alias("_text"))
               .join(runs, ["_k1", "_k2"], "left").select("doc_id", "_text", "runs"))

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for t, r in zip(b.column("_text").to_pylist(), b.column("runs").to_pylist()):
                t = t or ""
                left, gone, words = cut_lines(t, [(x["a"], x["z"]) for x in r]) if r else (t, [], 0)
                row = (sum(1 for x in t.split("\n") if x.split()), len(gone), words, ",".join(map(str, gone)),
                       hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest())
                for col, v in zip(out, row):
                    col.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, t) for c, t in zip(out, types)],
                                             ["doc_id", "n_lines", "n_removed", "words_removed", "removed", "kept_sha256"])

    return src.mapInArrow(run, "doc_id long, n_lines long, n_removed long, words_removed long, "
                               "removed string, kept_sha256 string")
