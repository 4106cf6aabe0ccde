from pyspark.sql import functions as F

import stocklens as sl
from stocklens.sources.contents import column_checksums


def sums(df):
    return {r["column"]: tuple(r)[1:] for r in column_checksums(df).collect()}


def test_checksums_ignore_order_and_see_every_value(spark):
    rows = [(i, f"t{i % 5}", i / 4, None if i % 7 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, d double, n int").withColumn("at", F.timestamp_seconds("id"))
    want = sums(df)
    assert sums(df.orderBy(F.desc("id")).repartition(5)) == want and want["n"][1] == 29
    for column, value in (("t", F.lit("t9")), ("d", F.lit(77.25)), ("n", F.lit(9)), ("at", F.timestamp_seconds(F.lit(1000)))):
        other = sums(df.withColumn(column, F.when(F.col("id") == 100, value).otherwise(F.col(column))))
        assert {c for c in want if other[c] != want[c]} == {column}
    assert sums(df.unionByName(df.limit(1)))["id"] != want["id"]


def test_empty_table_and_odd_names(spark):
    assert sums(spark.createDataFrame([], "`a b` string, `x.y` double")) == {"a b": (0, 0, 0), "x.y": (0, 0, 0)}


def test_a_changed_value_of_the_same_length_fails_the_row(spark):
    part = sl.load_table(spark, "part", "/root/testdata/sf0.001", "parquet")
    changed = part.withColumn("p_retailprice", F.when(F.col("p_partkey") == 7, F.col("p_retailprice") + 0.01).otherwise(F.col("p_retailprice")))
    a, b = sums(part), sums(changed)
    assert [c for c in a if a[c] != b[c]] == ["p_retailprice"]
