"""The five stages in order, each on what the one before kept."""

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import __spark_entry__ as entry
from kittally.llm import simhash
from kittally.session import cut
from llm_fixtures import empty, messy  # noqa: F401

SF = "/root/testdata/sf0.001"


tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@tables
def test_stages_on_odd_rows(spark, messy, empty):
    rows, frame = messy
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, SF)
        assert got.count() <= len(rows), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == frame.columns, name
        assert stage(spark, empty, SF).count() == 0, name


@tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts, texts = docs.columns, [docs.count()], None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] == counts[2] > 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        assert got[k].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids)


def test_near_dedup_sends_no_balls_to_the_driver(spark, monkeypatch):
    """Kept documents whose balls look smaller than the broadcast threshold are joined without a broadcast."""
    found, close = [], simhash.close_prints
    monkeypatch.setattr(simhash, "close_prints", lambda *a: found.append(close(*a)) or found[-1])
    docs = cut(spark.createDataFrame([(i, f"w{i} " * 9 + "end") for i in range(40)], "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert corpus_pipeline.simhash_near_dedup(spark, docs, SF).count() == 40
        assert ["Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in found] == [False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    mine = [q for q in entry.queries() if q.startswith("op") and q[2:].split("_")[0].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in mine) == list(range(1, 14)) and "pipeline" in entry.queries()
