"""The corpus pipeline on a small table with planted cases."""
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphdelta.llm.common import materialise

SF = "/root/testdata/sf0.01"
TOXIC = "idiot moron scum trash loser clown worthless pathetic disgusting stupid"


@pytest.fixture(scope="module")
def planted(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    clean = whole.where("lang = 'en' and n_chars between 900 and 1500").orderBy("doc_id").limit(3).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("not contains(text, '\n')").orderBy(
        F.length("text").desc()).first().text  # on one line, which line dedup leaves whole
    own = [" ".join(f"{w}x{k}" for w in clean[0].text.split()) for k in range(5)]
    words = own[1].split()
    rows = [(10_001, own[0] + "\n" + TOXIC + " " + own[0][:80]),
            (10_002, own[1]), (10_003, own[1]),
            (10_004, " ".join(words[:60] + ["changed"] + words[61:])),
            (10_005, own[2] + " " + item + " " + own[2][:60]),
            (10_006, own[3]), (10_007, None), (10_008, ""),
            (10_009, own[4] + "\n" + own[3]), (10_010, "own line here\n" + own[3])]
    more = spark.createDataFrame([(i, t, "en", "here", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    whole.select(*more.columns).union(more).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder


def test_every_stage_takes_effect(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, schema = docs.columns, docs.dtypes
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, planted))
        assert docs.columns == columns and docs.dtypes == schema
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in kept[name].values() if r.text is not None
                   and r.doc_id < 10_000)
    first, lines, near, last = kept.values()
    assert 10_001 not in first and {10_002, 10_006, 10_007, 10_008} <= first.keys()
    assert 10_003 not in lines and {10_002, 10_006, 10_009, 10_010} <= lines.keys()
    assert "\n" not in lines[10_009].text and lines[10_010].text == "own line here"
    assert lines[10_006].text == first[10_006].text
    assert 10_002 in near and 10_004 not in near
    assert 10_005 not in last and {10_002, 10_006, 10_007, 10_008} <= last.keys()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, planted).groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r.doc_id for r in pieces} == last.keys() and all(r.n == r.whole for r in pieces)


def test_one_copy_stays_when_a_stage_is_given_copies(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, planted).collect()}
    assert 10_002 in near and not {10_003, 10_004} & near and {10_007, 10_008, 10_006} <= near
