"""The pipeline's stages one after the other, each against what it was given."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from stocklens.llm.quality import text_counts
from test_bpe import library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_return_documents(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns[:len(stages[0].columns)] == stages[0].columns


def test_quality_keeps_what_passes(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    for r in stages[0].collect():
        n, _, _, _, repeated = text_counts(r["text"])
        assert (r["doc_id"] in kept) == (not (n < 20 or 100 * repeated > 30 * n))


def test_later_stages_only_choose_and_repeat(stages):
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in stages]
    assert ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    assert stages[3].count() == len(ids[3])
    most = stages[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 3


def test_encoding_of_what_is_left(stages):
    for r in stages[5].limit(40).collect():
        assert r["n_tokens"] == len(library(r["text"]))


def test_stages_on_edges(spark, edge, empty, clashing):
    for df in (edge, empty, clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
        corpus_pipeline.STAGES[-1][1](spark, df, SF).count()
