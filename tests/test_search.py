import random

import pytest

import stocklens as sl
from stocklens.sources.search import GramIndex


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("aAbB cñÑ日-") for _ in range(rng.randint(0, 9))) for _ in range(600)]
    return spark.createDataFrame([(v,) for v in [*made, *made[:50], None, "", "aaaa", "aXaXa", "100%", "a_b"]], "`la columna` string")


@pytest.fixture(scope="module")
def index(spark, values, tmp_path_factory):
    return GramIndex(spark, str(tmp_path_factory.mktemp("grams") / "i"), "la columna", 8).build(values)


@pytest.mark.parametrize("text", ["", "a", "B", "ab", "Ñ", "aaa", "AAAA", "aaaaa", " c", "日", "b-a", "ñab", "axax", "0%", "_", "zz", "bañ日", "xaxa"])
def test_equal_to_the_scan(values, index, text):
    want = [r[0] for r in sl.value_search(values, "la columna", text).collect()]
    assert [r[0] for r in index.search(text).collect()] == want
    assert [r[0] for r in index.search(text, 2).collect()] == want[:2]


def test_only_the_runs_are_read(index):
    plan = index.search("abcd")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket", "_bucket")
    assert "In(_gram, [abc,bcd])" in plan


def test_numbers_and_rebuilding(spark, tmp_path):
    numbers = spark.range(300).toDF("n")
    found = GramIndex(spark, str(tmp_path / "n"), "n").build(numbers)
    assert [r[0] for r in found.search("29").collect()] == [29, 129, 229, *range(290, 300)]
    found.build(spark.range(5).toDF("n"), "overwrite")
    assert found.search("29").count() == 0 and found.search("4").count() == 1
