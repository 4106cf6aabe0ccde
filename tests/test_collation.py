import pytest
from pyspark.sql import functions as F

import stocklens as sl
from stocklens.operators.joins import label_by_table


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([("Ab", "x", 1.0, "1%"), ("aB  ", "X ", 2.0, "1%"), ("c", "y", 0.0, "1%"), (None, "y", 3.0, None)],
                               "Referencia string, CodigoMarca string, Existencia_Total double, Descuento string")
    df = df.withColumn("Concatenar", F.concat_ws("", F.rtrim("Referencia"), "CodigoMarca"))
    return sl.collate_keys(df)


def test_groups_and_semi_joins_follow_the_collation(spark, rows):
    assert sl.positive_keys(rows).dropna().count() == 1
    assert sl.positive_items(rows).count() == 2
    assert {r["Existencia_Total"] for r in sl.stock_by_reference(rows).collect()} == {3.0, 0.0}
    flagged = {r["CodigoMarca"]: r["_dup_desc"] for r in sl.duplicate_flag(rows).collect()}
    assert flagged == {"x": True, "X ": True, "y": False}


def test_lookups_follow_the_collation(spark, rows):
    catalog = sl.collate_keys(spark.createDataFrame([("ABX", "7%")], "Concatenar string, Descuento_Catalogo string"), ["Concatenar"])
    found = sl.plain_texts(sl.with_catalog(rows, catalog))
    assert sorted(r["Descuento_Catalogo"] for r in found.filter("Descuento_Catalogo = '7%'").collect()) == ["7%", "7%"]
    last = sl.collate_keys(spark.createDataFrame([("abx ", "01/01/2024")], "Concatenar string, Fecha string"))
    assert sl.with_last_movement(rows, last).count() == 2
    rules = sl.collate_keys(spark.createDataFrame([(1, "AB", "one"), (2, "c ", "two")], "priority int, value string, label string"))
    labels = label_by_table(rows, "Referencia", rules, "of", "none").select("of").collect()
    assert sorted(r["of"] for r in labels) == ["none", "one", "one", "two"]


def test_types_and_spelling(spark, rows):
    assert "collate UTF8_LCASE_RTRIM" in rows.schema["Referencia"].dataType.simpleString()
    back = sl.plain_texts(rows)
    assert dict(back.dtypes)["Referencia"] == "string"
    assert sorted(r["Referencia"] or "" for r in back.collect()) == ["", "Ab", "aB  ", "c"]
    assert sl.collate_keys(spark.range(2)).columns == ["id"]
    assert sl.collate_tables({"t": rows})["t"].columns == rows.columns
