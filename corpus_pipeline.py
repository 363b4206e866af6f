"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing of
sources and byte-level BPE encoding and decoding, each stage on all that the one before it
kept. Counted as part of the subpackage ``patronage.llm``."""

from __future__ import annotations

import uuid

from patronage.llm import bpe, langid, lines, mixing, simhash
from patronage.llm.queries import vocabulary
from patronage.session import scratch_path


def language(spark, docs, sf_dir):
    """Documents without a recognisable language go."""
    return langid.keep_identified(docs, langid.learn(docs))


def line_dedup(spark, docs, sf_dir):
    """Later repeated runs of lines go, and documents that lose all by it."""
    return lines.dedup_lines(docs, drop_emptied=True)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents are repeated or left out so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """Token ids of every document, decoded again and held against its text."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), keep=("doc_id", "lang", "source"), verify=True)


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("source_mixing", mix_sources), ("byte_bpe", encode)]

# Language identification, tokenizers and seeded choice have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written and read again."""
    out = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
