"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.llm import (bpe, binary, hosts, langid, lattice, licences, lines, maxscore, mixing, pii, repetitions, search,
                           simhash)
from patronage.sources.tables import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark, sf_dir):
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_pii(spark, sf_dir):
    return pii.digest(pii.find_spans(read_table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark, sf_dir):
    return bpe.round_trip_digest(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op4_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op5_line_dedup(spark, sf_dir):
    return lines.dedup_report(read_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_token_binary(spark, sf_dir):
    folder = binary.write_ids(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return binary.read_ids(spark, folder)


def op8_license_scan(spark, sf_dir):
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op9_topk_search(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    asked = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, asked)


def op10_source_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "miss")


def op11_blockmax_maxscore(spark, sf_dir):
    return maxscore.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_period_runs(spark, sf_dir):
    return repetitions.run_report(read_table(spark, sf_dir, "documents"))


# The contract's rules: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    outcomes = hosts.numbered_outcomes(hosts.with_host(pages.select("url")), read_table(spark, sf_dir, "labels"))
    return hosts.judge(pages, outcomes, hosts.rule_table(spark, URL_RULES))


QUERIES = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_pii, op3_byte_bpe, op4_language_id, op5_line_dedup, op6_simhash_near_dedup,
    op7_token_binary, op8_license_scan, op9_topk_search, op10_source_mixing, op11_blockmax_maxscore, op12_period_runs,
    op13_url_filter)}
