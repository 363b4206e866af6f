"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to 4 letters (a blank may
stand at either end), hashed to ``BUCKETS`` presence bits. The kernel of two
texts is the size of the common set over the geometric mean of both sizes.
Landmark texts give a Nyström feature map, and one-versus-rest kernel ridge
regression is fitted on it. As the kernel is linear in the presence bits,
landmarks, map and weights fold into one (BUCKETS x languages) matrix, and
texts are scored by products of whole presence matrices with it.

The classifier is fitted on a bounded sample: ``PER_LANGUAGE`` documents a
language value, the first by a seeded hash of doc_id, of which ``LANDMARKS``
are landmarks. Each is sent to the driver as BUCKETS / 8 bytes. Every text is
scored whole, in slices that overlap by three letters.

Null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing could be learned. Rows with a null doc_id, lang or text are
not learned from. Repeated rows get equal predictions; ties go to the first
language in code-point order.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
MAX_GRAM = 4
PER_LANGUAGE = 300
LANDMARKS = 64
RIDGE = 1e-3
SEED = 11
BATCH = 64
SLICE_CHARS = 1 << 20


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def text_slices(t: str):
    """A whole text in slices of about SLICE_CHARS that end at a non-letter; a
    word longer than that is cut with an overlap of a gram less one."""
    a = 0
    while len(t) - a > SLICE_CHARS:
        z = a + SLICE_CHARS
        while z > a and t[z].isalpha() and t[z - 1].isalpha():
            z -= 1
        if z == a:
            z = a + SLICE_CHARS
            yield t[a:z]
            a = z - min(MAX_GRAM - 1, SLICE_CHARS - 1)
        else:
            yield t[a:z]
            a = z
    yield t[a:]


def presence(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) 0/1 matrix of the n-grams of each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    flat = out.reshape(-1)
    slices, owner = [], []
    for i, t in enumerate(texts):
        for part in text_slices(t):
            slices.append(part)
            owner.append(i)
    a = 0
    while a < len(slices):
        b, n = a, 0
        while b < len(slices) and (b == a or n + len(slices[b]) <= SLICE_CHARS):
            n += len(slices[b]) + 1
            b += 1
        joined = " ".join(slices[a:b]) + " "
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter((len(s) + 1 for s in slices[a:b]), np.int64, b - a)
        doc = np.repeat(np.array(owner[a:b], np.int64), lens)
        c = letter_codes()[cp]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c, doc = c[keep], doc[keep]
        c, doc = np.concatenate([[0], c]).astype(np.uint32), np.concatenate([doc[:1], doc])
        z = c != 0
        h = c.copy()
        inner = np.ones(len(c), bool)
        for n in range(1, MAX_GRAM + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            if n > 1:
                h = h[:m] * np.uint32(0x01000193) + c[n - 1:]
            if n > 2:
                inner = inner[:m] & z[n - 2: n - 2 + m]
            ok = z[:m] if n == 1 else (z[:m] | z[n - 1:]) if n == 2 else inner[:m]
            at = np.flatnonzero(ok)
            x = (h[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x = (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            first = np.where(z[at], at, np.minimum(at + 1, len(doc) - 1))  # the document of its first letter
            flat[doc[first] * BUCKETS + x] = 1.0
        a = b
    return out


def fit_ridge(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, (BUCKETS, languages) weights, bias) from packed presence rows."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    pick = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])

    def rows(at):
        x = np.unpackbits(bits[at], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    mark = rows(pick)
    kmm = (mark @ mark.T).astype(np.float64)
    val, vec = np.linalg.eigh(kmm)
    good = val > 1e-8 * val.max()
    back = vec[:, good] / np.sqrt(val[good])
    phi = np.concatenate([(rows(np.arange(a, min(a + BATCH, len(y)))) @ mark.T).astype(np.float64) @ back
                          for a in range(0, len(y), BATCH)])
    target = np.eye(len(names))[y]
    size = target.sum(axis=0)
    weight = (1.0 / size)[y]  # every language weighs the same
    weight /= weight.sum()
    bias = (weight[:, None] * target).sum(axis=0)
    centre = (weight[:, None] * phi).sum(axis=0)
    p = phi - centre
    w = np.linalg.solve(p.T @ (p * weight[:, None]) + ridge * np.eye(p.shape[1]),
                        p.T @ ((target - bias) * weight[:, None]))
    return names, (mark.T @ (back @ w)).astype(np.float32), bias - centre @ w


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, seed: int = SEED):
    """Fit on a bounded sample of the labelled rows of the learning folds."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"),
                       docs[text_col].cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & ~held_out(F.col("doc_id")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    # row_number() <= k keeps k rows a language on each task before the shuffle
    ids = (rows.select("doc_id", "lang").withColumn("_turn", order).filter(F.col("_turn") <= per_language)
               .select("doc_id", "lang").distinct())
    # a doc_id that repeats under one language counts once, with its least text hash
    chosen = (rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
                  .select("doc_id", "lang", "text"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for a in range(0, len(texts), BATCH):
                x = presence(texts[a: a + BATCH]).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, len(x)), b.column("lang").slice(a, len(x)),
                     pa.array([np.packbits(r).tobytes() if r.any() else None for r in x], pa.binary())],
                    ["doc_id", "lang", "bits"])

    schema = chosen.drop("text").schema.add("bits", "binary")
    got = (chosen.mapInArrow(run, schema).filter("bits is not null")
                 .groupBy("lang", "doc_id").agg(F.min("bits").alias("bits"))
                 .orderBy("lang", F.xxhash64(F.lit(seed), "doc_id"), "doc_id").select("lang", "bits").collect())
    if not got:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    return fit_ridge(np.stack([np.frombuffer(r["bits"], np.uint8) for r in got]), [r["lang"] for r in got])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_texts(texts: list, model):
    """(predictions, scores) of whole texts, a presence matrix at a time."""
    names, weights, bias = model
    pred, score = [], []
    for a in range(0, len(texts), BATCH):
        x = presence([t or "" for t in texts[a: a + BATCH]])
        size = x.sum(axis=1)
        if names:
            s = (x @ weights) / np.sqrt(np.maximum(size, 1))[:, None] + bias
            best = s.argmax(axis=1)
            top = np.clip(s[np.arange(len(s)), best], 0.0, 1.0)
        for i, n in enumerate(size):
            known = bool(names) and n > 0
            pred.append(names[best[i]] if known else "und")
            score.append(float(top[i]) if known else 0.0)
    return pred, score


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    src = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                      docs[text_col].cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            pred, score = score_texts(b.column("_text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, src.drop("_text").schema.add("lang_pred", "string").add("score", "double"))


def keep_identified(docs: DataFrame, model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` without rows that are ``und`` and, where ``least`` is given,
    those that score below it. Where nothing could be learned, as no row has
    a language, only null texts and texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            if shared.value[0]:
                pred, score = score_texts(texts, shared.value)
                keep = [p != "und" and (least is None or s >= least) for p, s in zip(pred, score)]
            else:
                keep = [x for a in range(0, len(texts), BATCH)
                        for x in (presence([t or "" for t in texts[a: a + BATCH]]).sum(axis=1) > 0).tolist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
