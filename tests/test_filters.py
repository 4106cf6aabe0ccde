import pytest
from pyspark.sql import functions as F

import stocklens as sl


def keys(df):
    return sorted(r["k"] for r in df.select("k").collect())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, "R0 - Casa Matriz", "B1", " Ring ", "ec", "1"),
        (2, "R1 - Sucursales", "b2", "ring", "ST", "True"),
        (3, "R2 - Sucursales", None, "RING x", None, "x"),
        (4, None, "B4", None, "zz", None),
        (5, "Sin region", "B1", "bolt", "ec", "1.0"),
    ], "k int, Region string, CodigoMarca string, Referencia string, CodigoSubLinea string, Promocion string")


def test_scope_and_region(rows):
    assert keys(sl.scope(rows, "Todo")) == [1, 2, 3, 4, 5]
    assert keys(sl.scope(rows, "Solo Sucursales")) == [2, 3]
    assert keys(sl.scope(rows, "Solo Casa Matriz")) == [1]
    assert keys(sl.by_region(rows, "R1 - Sucursales")) == [2]
    assert keys(sl.by_region(rows, "Todas")) == keys(sl.by_region(rows, None)) == [1, 2, 3, 4, 5]
    with pytest.raises(KeyError):
        sl.scope(rows, "otra")


def test_brand_and_reference(rows):
    assert keys(sl.by_brand(rows, "B1")) == [1, 5]
    assert keys(sl.by_brand(rows, "")) == [1, 2, 3, 4, 5]
    assert keys(sl.by_reference(rows, " RING ")) == [1, 2]
    assert keys(sl.by_reference(rows, "Referencia")) == [1, 2, 3, 4, 5]


def test_exclusions_keep_null(rows):
    for more in ([], [f"none {i}" for i in range(2000)]):
        assert keys(sl.exclude_brands(rows, [" b1 ", "", *more])) == [2, 3, 4]
        assert keys(sl.exclude_sublines(rows, ["EC", "st", *more])) == [3, 4]
    assert keys(sl.exclude_brands(rows, [])) == [1, 2, 3, 4, 5]
    assert keys(sl.exclude_sublines(rows.drop("CodigoSubLinea"), ["EC"])) == [1, 2, 3, 4, 5]


def test_promo_only_reads_numbers(rows, spark):
    assert keys(sl.promo_only(rows)) == [1, 5]
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, Promocion boolean")
    assert keys(sl.promo_only(flags)) == [1]


def test_exclude_year(spark):
    df = spark.createDataFrame([(1, "31/12/2023"), (2, "01/01/2024"), (3, "xx"), (4, None)], "k int, Fecha string")
    assert keys(sl.exclude_year(df, 2023)) == [2, 3, 4]
    assert keys(sl.exclude_year(df, "2024", "Fecha")) == [1, 3, 4]
    assert keys(sl.exclude_year(df, "abc")) == keys(sl.exclude_year(df, None)) == [1, 2, 3, 4]
    named = df.withColumnRenamed("Fecha", "dia")  # found by content: half of the rows parse
    assert keys(sl.exclude_year(named, 2023)) == [2, 3, 4]
    assert keys(sl.exclude_year(named.filter("k > 1"), 2024)) == [2, 3, 4]  # a third parses
    years = spark.createDataFrame([(1, "2023"), (2, "x"), (3, None)], "k int, Anio string")
    assert keys(sl.exclude_year(years, 2023)) == [2, 3]
    stamps = df.select("k", F.try_to_timestamp("Fecha", F.lit("dd/MM/yyyy")).alias("fecha_doc"))
    assert keys(sl.exclude_year(stamps, 2023)) == [2, 3, 4]
    numbers = spark.createDataFrame([(1, 5), (2, 6)], "k int, n int")
    assert keys(sl.exclude_year(numbers, 1970)) == [1, 2]


def test_stock_range(spark):
    pivot = spark.createDataFrame([(1, "1"), (2, "11"), (3, "12"), (4, "x"), (5, "0")], "k int, Casa_matriz_Total string")
    assert keys(sl.stock_range(pivot)) == [1, 2]
    base = spark.createDataFrame([(1, "A - Casa Matriz", 5.0), (2, "B - Sucursales", 5.0), (3, "A - Casa Matriz", 50.0)],
                                 "k int, Region string, Existencia_Total double")
    assert keys(sl.stock_range(base)) == [1]
    assert keys(sl.stock_range(base.select("k"))) == [1, 2, 3]


def test_value_search(rows):
    assert [r[0] for r in sl.value_search(rows, "Referencia", "RIN", 2).collect()] == [" Ring ", "RING x"]
    many = rows.sparkSession.range(12).selectExpr("'ref ' || id as Referencia")
    assert sl.value_search(many, "Referencia", "REF").count() == 12
    assert sl.value_search(rows, "Referencia", "").count() == 0
    assert sl.value_search(rows, "Referencia", "%", None).count() == 0


def test_catalog_match_partitions_the_rows(spark):
    df = spark.createDataFrame([(1, "5%", "5%"), (2, "5%", "6%"), (3, None, "5%"), (4, "5%", None)],
                               "k int, Descuento string, Descuento_Catalogo string")
    assert keys(sl.catalog_match(df, "match")) == [1]
    assert keys(sl.catalog_match(df, "mismatch")) == [2, 3, 4]
    assert keys(sl.catalog_match(df, None)) == [1, 2, 3, 4]


def test_movements_drop_unknown_and_unit_quantities(spark):
    lines = spark.createDataFrame([(1, "a", 1.0), (1, "b", -1.0), (1, "c", None), (1, "d", 2.0), (2, "e", 3.0)],
                                  "numero int, codigo_barra string, cantidad double")
    heads = spark.createDataFrame([(1, "2"), (2, "1")], "numero int, status string")
    assert [r["codigo_barra"] for r in sl.valid_movements(lines, heads).collect()] == ["d"]


def test_promo_cleared_without_stock(spark):
    schema = "k int, Existencia_Total {}, Promocion {}, Descuento {}"
    text = spark.createDataFrame([(1, "0", "1", "5%"), (2, "x", "1", "5%"), (3, "2", "1", "5%"), (4, None, None, None)],
                                 schema.format("string", "string", "string"))
    got = {r["k"]: (r["Promocion"], r["Descuento"]) for r in sl.clear_promo_without_stock(text).collect()}
    assert got == {1: ("0", "0%"), 2: ("0", "0%"), 3: ("1", "5%"), 4: ("0", "0%")}
    number = spark.createDataFrame([(1, -1.0, True, 5.0), (2, float("nan"), True, 5.0), (3, 1.0, True, 5.0)],
                                   schema.format("double", "boolean", "double"))
    got = {r["k"]: (r["Promocion"], r["Descuento"]) for r in sl.clear_promo_without_stock(number).collect()}
    assert got == {1: (False, 0.0), 2: (False, 0.0), 3: (True, 5.0)}
    assert sl.clear_promo_without_stock(text.select("k")).columns == ["k"]


def test_exclude_year_reads_usual_spellings(spark):
    texts = ["01/02/2024", "1/2/2024", "2024-02-01", "1-2-2024", "1.2.2024", "1/2/24", "1/2/2024 10:30", "2024-02-01T10:30:00",
             "01/02/2023", "sin fecha", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, Fecha string")
    assert keys(sl.exclude_year(rows, 2024, "Fecha")) == [8, 9, 10]
    assert keys(sl.exclude_year(rows, 2024, "Fecha", formats=("dd/MM/yyyy",))) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_exclude_year_reads_no_other_column_behind_a_named_date(spark):
    fails = F.when(F.col("id") >= 0, F.raise_error(F.lit("read"))).otherwise("x")
    rows = spark.range(4).select("id", fails.alias("note"), F.concat(F.lit("0"), F.col("id") + 1, F.lit("/02/2024")).alias("Fecha"))
    assert sl.exclude_year(rows, 2024).select("id").collect() == []
    assert sl.exclude_year(rows, 2023).select("id").count() == 4


def test_exclude_year_counts_rows_of_other_columns(spark):
    """No named column holds a date: half of the rows decide, repeated texts count each time."""
    rows = spark.createDataFrame([(1, "x", "a", "1/2/2024"), (2, "x", "1/2/2023", " 1/2/2024"), (3, None, "b", "z"), (4, "x", "c", None)],
                                 "k int, Fecha string, one string, two string")
    assert keys(sl.exclude_year(rows, 2024)) == [3, 4] and keys(sl.exclude_year(rows, 2023)) == [1, 2, 3, 4]
    third = rows.withColumn("three", F.when(F.col("k") > 1, F.lit("2022-05-06").cast("date")))
    assert keys(sl.exclude_year(third.drop("two"), 2022)) == [1]
    assert keys(sl.exclude_year(rows.filter("k < 0"), 2024)) == []
