"""Text retrieval.

Top-k search never forms (query, document) pair rows: the query vectors
(count checked before broadcasting) go to every task, each task keeps its
own best ``k`` per query with numpy, and a final rank over at most
``k x partitions`` candidates per query picks the global top ``k`` - the
retrieval analogue of a partial aggregation. MMR re-ranking then works
on those ``k`` candidates per query only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.expr import friendly_source

# Chunking and retrieval settings.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
FETCH_K = 20
MMR_K = 6
MMR_LAMBDA = 0.7
EMBED_DIM = 256
QUERY_BLOCK = 10_000
MEET = 1024     # queries and items of one matrix product
# Where chunks may be cut, coarsest first.
SEPARATORS = ("\n\n", "\n", " ")


def chunk_documents(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                    overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping fixed windows over the whole text (step size-overlap);
    a window is emitted only when it reaches past the previous one. Every
    other column is carried along as metadata."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text_col) - overlap) / F.lit(step))).cast("int")
    keep = [c for c in docs.columns if c != text_col]
    return (docs.filter(F.col(text_col).isNotNull())
                .select(*keep, text_col, F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk_no", "i"))
                .select(*keep, F.col("chunk_no").cast("int").alias("chunk_no"),
                        F.substring(text_col, F.col("i") * step + 1, size).alias("content")))


def _cuts(text: str, lo: int, hi: int, level: int) -> tuple[list[int], int]:
    """Where the pieces of ``text[lo:hi]`` begin at the coarsest separator from ``level`` on
    that occurs in it, and that separator's level; a separator begins the piece after it."""
    for at in range(level, len(SEPARATORS)):
        sep = SEPARATORS[at]
        found = text.find(sep, lo, hi)
        if found >= 0:
            cuts = [lo]
            while found >= 0:
                if found > lo:
                    cuts.append(found)
                found = text.find(sep, found + len(sep), hi)
            return cuts, at
    return [lo], len(SEPARATORS)


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """(start, end) of the separator-aware chunks of a text, in linear time: pieces
    between separators are put together while they fit ``size``; the next chunk begins with
    the last pieces that fit ``overlap``. A piece of ``size`` or more is cut on at finer
    separators, and without any by characters. Outer white space is cut off, what is only
    white space gives no chunk."""
    return _spans(text, 0, len(text), 0, size, overlap)


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int):
    cuts, at = _cuts(text, lo, hi, level)
    if at == len(SEPARATORS):
        # no separator left: windows of characters
        step = size - overlap
        for k in range(max(1, -(-(hi - lo - overlap) // step))):
            yield from _trimmed(text, lo + k * step, min(lo + k * step + size, hi))
        return
    first = 0
    for i, (s, e) in enumerate(zip(cuts, [*cuts[1:], hi])):
        if e - s >= size:
            if first < i:
                yield from _trimmed(text, cuts[first], s)
            yield from _spans(text, s, e, at + 1, size, overlap)
            first = i + 1
        elif e - cuts[first] > size:
            yield from _trimmed(text, cuts[first], s)
            while first < i and (s - cuts[first] > overlap or e - cuts[first] > size):
                first += 1
    if first < len(cuts):
        yield from _trimmed(text, cuts[first], hi)


def _trimmed(text: str, lo: int, hi: int):
    body = text[lo:hi]
    left = len(body) - len(body.lstrip())
    body = body.strip()
    if body:
        yield lo + left, lo + left + len(body)


def chunk_by_separators(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
                        overlap: int = CHUNK_OVERLAP, rows: int = 2048) -> DataFrame:
    """T1 at paragraph, line and word borders (``chunk_spans``) over whole texts: the
    other columns, ``chunk_no``, ``chunk_start`` (code points) and ``content``. Null texts and texts
    of white space give no row. Output batches hold ``rows`` chunks, so a long text is not
    copied out at once."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    added = [("chunk_no", "int"), ("chunk_start", "int"), ("content", "string")]
    keep = [c for c in docs.columns if c != text_col]
    if clash := {n for n, _ in added} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are written by this operator")

    def run(batches):
        for batch in batches:
            kept = batch.select(keep)
            at, no, start, content = [], [], [], []

            def flush():
                cols = [kept.column(c).take(pa.array(at, pa.int64())) for c in keep]
                return pa.RecordBatch.from_arrays(
                    [*cols, pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(content, pa.string())],
                    names=[*keep, *[n for n, _ in added]])

            for i, value in enumerate(batch.column(text_col)):
                text = value.as_py()
                for j, (s, e) in enumerate(chunk_spans(text, size, overlap) if text else ()):
                    at.append(i), no.append(j), start.append(s), content.append(text[s:e])
                    if len(at) >= rows:
                        yield flush()
                        at, no, start, content = [], [], [], []
            if at:
                yield flush()

    return docs.select(*keep, text_col).mapInArrow(
        run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
                       + [f"{n} {t}" for n, t in added]))


def fit_embedder(texts: DataFrame, text_col: str = "content", dim: int = EMBED_DIM):
    """T2 (re-aimed): tokens -> hashed term counts -> IDF -> L2 norm, all
    Spark ML. Returns a fitted PipelineModel producing ``embedding``."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim)
    idf = IDF(inputCol="__tf", outputCol="__tfidf")
    norm = Normalizer(inputCol="__tfidf", outputCol="__vec", p=2.0)
    return Pipeline(stages=[tok, tf, idf, norm]).fit(texts)


def embed(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("embedding", vector_to_array("__vec")).drop("__tok", "__tf", "__tfidf", "__vec")


def _unit(a: np.ndarray) -> np.ndarray:
    nrm = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(nrm == 0, 1.0, nrm)


def _block_topk(bq, k: int):
    """The k best items of one task for every query of a broadcast block. Queries meet items
    ``MEET`` by ``MEET``, and only pairs at or above a query's k-th best so far are sorted, so a
    task's memory does not depend on how many queries and items there are."""
    def better(held, block, x, ids):
        q, s, i, least = held
        sims = np.round(block @ x.T, 9)                # 9 digits settle float ties
        floor = least
        if len(x) > k and np.isneginf(least).any():
            ranked = np.where(np.isnan(sims), -np.inf, sims)
            floor = np.maximum(least, np.partition(ranked, len(x) - k, axis=1)[:, len(x) - k])
        at, item = np.nonzero(~(sims < floor[:, None]))     # undefined similarities come last
        if not len(at):
            return held
        q, s = np.concatenate([q, at]), np.concatenate([s, sims[at, item]])
        i = ids[item] if i is None else np.concatenate([i, ids[item]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == k - 1
        least = least.copy()
        least[q[last]] = np.where(np.isnan(s[last]), -np.inf, s[last])
        kept = rank < k
        return q[kept], s[kept], i[kept], least

    def part_topk(it):
        ids_all, Qm = bq.value
        blocks = range(0, len(ids_all), MEET)
        held = {b: (np.zeros(0, int), np.zeros(0), None, np.full(min(MEET, len(ids_all) - b), -np.inf)) for b in blocks}
        for pdf in it:
            for at in range(0, len(pdf) if held else 0, MEET):
                part = pdf.iloc[at:at + MEET]
                X = _unit(np.array([np.asarray(v, dtype=float) for v in part["v"]]))
                ids = part["id"].to_numpy()
                for b in blocks:
                    held[b] = better(held[b], Qm[b:b + MEET], X, ids)
        for b in blocks:
            q, s, i, _ = held[b]
            if len(q):
                yield pd.DataFrame({"qid": ids_all[b + q], "id": i, "similarity": s})

    return part_topk


def nearest(items: DataFrame, queries: DataFrame, k: int = FETCH_K, id_col: str = "id",
            qid_col: str = "qid", vec: str = "embedding") -> DataFrame:
    """Per query the ``k`` items with the highest cosine similarity
    (ties by item id). Returns (qid, id, similarity, rank)."""
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select(F.col(qid_col).alias("qid"), F.col(vec).alias("v"),
                              F.pmod(F.xxhash64(qid_col), F.lit(n_blocks)).alias("b"))
    id_type = dict(items.dtypes)[id_col]
    q_type = dict(queries.dtypes)[qid_col]
    cand = None
    # the query set goes to the tasks in blocks of a fixed size, each against all items
    for block in range(n_blocks):
        qpdf = numbered.filter(F.col("b") == block).toPandas()
        if qpdf.empty and n_blocks > 1:
            continue
        Q = _unit(np.array([np.asarray(v, dtype=float) for v in qpdf["v"]])) if len(qpdf) else np.zeros((0, 1))
        bq = items.sparkSession.sparkContext.broadcast((qpdf["qid"].to_numpy(), Q))
        part = (items.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
                     .mapInPandas(_block_topk(bq, k), f"qid {q_type}, id {id_type}, similarity double"))
        cand = part if cand is None else cand.unionAll(part)
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), F.asc("id"))
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumnRenamed("qid", qid_col).withColumnRenamed("id", id_col)


def mmr(candidates: DataFrame, queries: DataFrame, k: int = MMR_K, lam: float = MMR_LAMBDA,
        id_col: str = "id", qid_col: str = "qid", vec: str = "embedding") -> DataFrame:
    """T4: maximal marginal relevance over each query's candidates:
    repeatedly take argmax of lam*sim(q, d) - (1-lam)*max sim(d, chosen).
    ``candidates`` carries (qid, id, embedding); groups are ``fetch_k`` rows."""
    qv = queries.select(F.col(qid_col).alias("__q"), F.col(vec).alias("__qv"))
    data = candidates.join(qv, candidates[qid_col] == qv["__q"]).drop("__q")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col).reset_index(drop=True)
        X = _unit(np.array([np.asarray(v, dtype=float) for v in pdf[vec]]))
        q = _unit(np.asarray(pdf["__qv"].iloc[0], dtype=float)[None, :])[0]
        rel = X @ q
        chosen = [int(np.argmax(rel))]
        while len(chosen) < min(k, len(X)):
            red = (X @ X[chosen].T).max(axis=1)
            score = lam * rel - (1 - lam) * red
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))
        return pd.DataFrame({qid_col: pdf[qid_col].iloc[0], id_col: pdf[id_col].iloc[chosen].to_numpy(),
                             "mmr_rank": np.arange(1, len(chosen) + 1), "relevance": rel[chosen]})

    q_type, i_type = dict(candidates.dtypes)[qid_col], dict(candidates.dtypes)[id_col]
    return data.groupBy(qid_col).applyInPandas(
        pick, f"{qid_col} {q_type}, {id_col} {i_type}, mmr_rank int, relevance double")


def cited_sources(hits: DataFrame, qid_col: str = "qid", source_col: str = "source") -> DataFrame:
    """T5: distinct friendly labels of each query's hits, sorted."""
    return hits.groupBy(qid_col).agg(F.array_sort(F.collect_set(friendly_source(source_col))).alias("sources"))


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (one grouped average per dimension)."""
    ex = vectors.select(label, F.posexplode(vec).alias("pos", "x"))
    means = ex.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (means.groupBy(label)
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("__pm"))
                 .select(label, F.transform("__pm", lambda s: s["m"]).alias(vec)))
