import random

import pytest
from pyspark.sql import functions as F

from stocklens import DEFAULT_RULES
from stocklens.functions import columns as cols
from stocklens.functions.items import (
    discount_label, item_key, normalise_promo, owner, pct_text, percent_sign, region_bucket,
    rounded_half_even, rounded_scaled, share, store_label,
)
from stocklens.functions.text import normalise_name, number_from_text, stripped
from stocklens.operators.joins import label_by_table


def one(df):
    return [r[0] for r in df.collect()]


def test_item_key_reads_null_as_empty(spark):
    df = spark.createDataFrame([(None, "B1"), ("R1", None), ("R", "B"), (None, None)], "r string, b string")
    assert one(df.select(item_key(F.col("r"), F.col("b")))) == ["B1", "R1", "RB", ""]


def test_discount_label(spark):
    pairs = [(0, 10), (10, 0), (10, 10), (10, 12), (None, 5), (100, 75), (5, None), (8, 7)]
    want = ["0%", "0%", "0%", "-20%", "%", "25%", "%", "13%"]
    for kind in ("double", "decimal(18,3)"):
        df = spark.createDataFrame([(None if p is None else str(p), None if q is None else str(q)) for p, q in pairs],
                                   "p string, q string")
        got = one(df.select(discount_label(F.col("p").cast(kind), F.col("q").cast(kind))))
        assert got == want


def test_region_and_owner_presets(spark):
    df = spark.createDataFrame([(2003,), (1,), (1029,), (1036,), (77,), (None,)], "s int")
    assert one(df.select(region_bucket(F.col("s"), DEFAULT_RULES))) == [
        "Valencia Casa Matriz", "Oriente - Sucursales", "Occidente - Sucursales", "Margarita - Sucursales",
        "Sin region", "Sin region"]
    df = spark.createDataFrame([("FAJAS",), ("BALONES",), ("fajas",), (None,)], "s string")
    assert one(df.select(owner(F.col("s"), DEFAULT_RULES))) == ["Raul", "Dairo", "Sin encargado", "Sin encargado"]


def test_label_table_equals_label_list(spark):
    ids = [i for r in DEFAULT_RULES.regions for i in r.values] + [5, 2003]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "s int")
    rules = spark.createDataFrame(
        [(n, v, r.label) for n, r in enumerate(DEFAULT_RULES.regions) for v in r.values]
        + [(99, 2003, "later rule")], "priority int, value int, label string")
    got = label_by_table(df, "s", rules, "Region", "Sin region").withColumn(
        "want", region_bucket(F.col("s"), DEFAULT_RULES)).collect()
    assert len(got) == len(ids) + 1 and all(r["Region"] == r["want"] for r in got)


def test_store_label_needs_both_parts(spark):
    df = spark.createDataFrame([("R", "S"), (None, "S"), ("R", None)], "r string, s string")
    assert one(df.select(store_label(F.col("r"), F.col("s")))) == ["R - S", None, None]


def test_rounding_is_correct_on_the_exact_value(spark):
    rng = random.Random(7)
    values = [rng.uniform(0, 100) for _ in range(3000)] + [rng.randrange(0, 100000) / 1000 for _ in range(3000)]
    values += [1.115, 2.675, 0.125, 0.375, 50.005, 100.0, 0.0, 33.335, -1.115, -0.375]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", rounded_half_even(F.col("v")).alias("r"), rounded_scaled(F.col("v")).alias("s")).collect()
    assert all(r["r"] == round(r["v"], 2) for r in rows)
    by_value = {r["v"]: (r["r"], r["s"]) for r in rows}
    assert by_value[1.115] == (1.11, 1.12) and by_value[0.125] == (0.12, 0.12)


def test_share_text(spark):
    df = spark.createDataFrame([(1.0, 800.0), (1.0, 3.0), (0.0, 5.0), (1.0, 0.0), (-1.0, -2.0), (1115.0, 100000.0)],
                               "p double, t double")
    assert one(df.select(percent_sign(share(F.col("p"), F.col("t"))))) == [
        "0.12%", "33.33%", "0.0%", "0.0%", "0.0%", "1.11%"]


def test_percent_text(spark):
    texts = ["0.5", "1.5", "2.5", "x", "", "nan", " 23 % ", "0.23", None, "1d", "-7.5%", "1e2", "inf"]
    want = ["0%", "2%", "2%", "x", "", "nan", "23%", "0%", None, "1d", "-8%", "100%", "inf"]
    assert one(spark.createDataFrame([(t,) for t in texts], "t string").select(pct_text(F.col("t")))) == want


def test_promo_flag_by_type(spark):
    texts = spark.createDataFrame([("True",), ("false",), ("1",), ("0",), ("x",), ("TRUE",), (None,)], "Promocion string")
    assert one(normalise_promo(texts)) == ["1", "0", "1", "0", "x", "TRUE", None]
    assert one(normalise_promo(spark.createDataFrame([(True,), (None,)], "Promocion boolean"))) == [1, None]
    assert one(normalise_promo(spark.createDataFrame([(7,), (0,)], "Promocion int"))) == [7, 0]


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t a b\n",)], "t string")
    assert one(df.select(stripped(F.col("t")))) == ["a b"]
    df = spark.createDataFrame([(" 5 ",), ("5.",), (".5",), ("0x1",), ("1 2",)], "t string")
    assert one(df.select(number_from_text(F.col("t")))) == [5.0, 5.0, 0.5, None, None]
    assert normalise_name("  Año_Total É ") == "anototale"
    assert normalise_name(None) == ""


def test_column_discovery():
    assert cols.stock_column(["Cantidad", "Existencia_Total"]) == "Existencia_Total"
    assert cols.stock_column(["a", "Mi Stock Actual"]) == "Mi Stock Actual"
    assert cols.stock_column(["a"]) is None
    assert cols.house_total_column(["x", "Casa_matriz_Total"]) == "Casa_matriz_Total"
    assert cols.house_total_column(["Casa Matriz Existencia"]) == "Casa Matriz Existencia"
    assert cols.subline_column(["x", " CodSubLinea"]) == " CodSubLinea"
    assert cols.year_column(["Year", "AÑO"]) == "AÑO"
    assert cols.date_columns(["Mi Fecha", "DATE", "dated"]) == ["Mi Fecha", "DATE"]


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="b"):
        cols.require(spark.range(1).toDF("a"), ["a", "b"])
