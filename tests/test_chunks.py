"""Separator-aware chunks against a plain recursion over strings."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from patronage.operators import retrieve as T


def split_at(text, sep):
    if not sep:
        return list(text)
    parts = re.split(f"({re.escape(sep)})", text)
    joined = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts), 2)]
    return [p for p in joined if p]


def put_together(pieces, size, overlap):
    done, now = [], []
    for p in pieces:
        if now and sum(map(len, now)) + len(p) > size:
            done.append("".join(now).strip())
            while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > size):
                now = now[1:]
        now = now + [p]
    done.append("".join(now).strip())
    return [d for d in done if d]


def plain(text, size, overlap, seps=("\n\n", "\n", " ", "")):
    at = next(i for i, s in enumerate(seps) if s in text)
    out, short = [], []
    for p in split_at(text, seps[at]):
        if len(p) < size or not seps[at]:
            short.append(p)
        else:
            out += put_together(short, size, overlap) + plain(p, size, overlap, seps[at + 1:])
            short = []
    return out + put_together(short, size, overlap)


def made(rng, n):
    return "".join(rng.choice(["a", "bc", "défg", "x" * 9, " ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "q" * 40]) for _ in range(n))


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 4), (25, 9), (60, 59), (1, 0), (1000, 200)])
def test_equal_to_plain_recursion(size, overlap):
    rng = random.Random(size)
    for n in [0, 1, 2, 5, 20, 80, 300]:
        for _ in range(25):
            text = made(rng, n)
            got = [text[s:e] for s, e in T.chunk_spans(text, size, overlap)]
            assert got == (plain(text, size, overlap) if text else []), repr(text)
            covered = set()
            for s, e in T.chunk_spans(text, size, overlap):
                assert 0 < e - s <= size
                covered.update(range(s, e))
            assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_long_texts_take_linear_time():
    text = "x" * 3_000_000 + ("word " * 300 + "\n\n") * 20_000
    began = time.monotonic()
    assert sum(1 for _ in T.chunk_spans(text)) > 40_000
    assert time.monotonic() - began < 60


def test_documents_equal_plain_recursion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["chunk_no"]): r["content"] for r in T.chunk_by_separators(docs).collect()}
    want = {(r["doc_id"], i): c for r in docs.collect() if r["text"] for i, c in enumerate(plain(r["text"], 1000, 200))}
    assert got == want


def test_rows(spark):
    text = "one two\n\nthree four five six\n" * 30
    df = spark.createDataFrame([(1, "s", text), (2, None, None), (3, "s", ""), (4, "t", " \n "), (1, "s", text)],
                               "doc_id long, `so urce` string, body string")
    got = T.chunk_by_separators(df, "body", 100, 30, rows=3)
    assert got.columns == ["doc_id", "so urce", "chunk_no", "chunk_start", "content"]
    want = plain(text, 100, 30)
    rows = got.groupBy("doc_id", "chunk_no", "content").count().orderBy("chunk_no").collect()
    assert [r["content"] for r in rows] == want and {r["count"] for r in rows} == {2} and {r["doc_id"] for r in rows} == {1}
    joined = got.join(df.select("doc_id", "body").distinct(), "doc_id")
    assert joined.filter(F.expr("substring(body, chunk_start + 1, length(content)) != content")).count() == 0
    assert T.chunk_by_separators(df.filter("doc_id > 9"), "body").count() == 0
    assert T.chunk_by_separators(df.select("body"), "body").count() == 2
    with pytest.raises(ValueError):
        T.chunk_by_separators(df.withColumn("chunk_no", F.lit(1)), "body")
