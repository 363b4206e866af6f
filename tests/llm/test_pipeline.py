"""The pipeline's stages, each against its own input."""

import corpus_pipeline
import pytest
from patronage.llm import bpe
from patronage.llm.queries import QUERIES


def test_stages_keep_columns_and_take_effect(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "byte_bpe":
            assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run_on_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.filter("n_tokens = 0").count() == 0


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_last_stage_decodes_its_ids(spark, odd_docs, monkeypatch):
    held = {}
    monkeypatch.setattr(type(odd_docs), "mapInArrow", lambda self, f, schema: held.update(f=f, src=self) or self)
    corpus_pipeline.encode(spark, odd_docs, "")
    batches = held["src"].toArrow().to_batches()
    assert sum(b.num_rows for b in held["f"](iter(batches))) == odd_docs.count()
    right = bpe.Slice.encoded
    monkeypatch.setattr(bpe.Slice, "encoded", lambda self, ranks: (i[:-1] for i in right(self, ranks)))
    with pytest.raises(ValueError, match="decoded ids differ"):
        list(held["f"](iter(batches)))
