import pytest
from pyspark.sql import functions as F

import stocklens as sl
from data import snapshot_frame, snapshot_row


def test_duplicates_include_null_and_partition_the_rows(spark):
    df = spark.createDataFrame([("k", "5%"), ("k", "5%"), (None, None), (None, None), ("k", "6%"), (None, "5%")],
                               "Concatenar string, Descuento string")
    flagged = sl.duplicate_flag(df)
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in flagged.collect()) == [
        ("None", "5%", False), ("None", "None", True), ("None", "None", True),
        ("k", "5%", True), ("k", "5%", True), ("k", "6%", False)]
    assert sl.dup_mode(flagged, "dup").count() + sl.dup_mode(flagged, "unique").count() == 6
    off = sl.duplicate_flag(df, enabled=False)
    assert sl.dup_mode(off, "dup").count() == 0 and sl.dup_mode(off, "unique").count() == 6
    assert sl.dup_mode(off, None).count() == 6


def test_scope_totals_treat_null_codes_as_a_group(spark):
    df = snapshot_frame(spark, [
        snapshot_row(None, "b", "A - Casa Matriz", stock=1.0), snapshot_row(None, "b", "A - Casa Matriz", stock=2.0),
        snapshot_row("r", "b", "Casa Matriz X", stock=4.0), snapshot_row("r", "b", "A - Sucursales", stock=8.0)])
    df = df.drop("Existencia_Total_CasaMatriz", "Existencia_Total_Sucursales")
    got = sorted((str(r["Referencia"]), r["Existencia_Total_CasaMatriz"], r["Existencia_Total_Sucursales"])
                 for r in sl.with_scope_totals(df).collect())
    assert got == [("None", 3.0, 0.0), ("None", 3.0, 0.0), ("r", 0.0, 8.0), ("r", 0.0, 8.0)]


def test_positive_items_drop_null_codes(spark):
    df = snapshot_frame(spark, [snapshot_row("r", stock=0.0), snapshot_row("r", stock=2.0),
                                snapshot_row("s", stock=0.0), snapshot_row(None, "b", stock=9.0)])
    assert [r["Referencia"] for r in sl.positive_items(df).collect()] == ["r", "r"]


def movement_rows(spark, rows):
    return spark.createDataFrame(rows, "Concatenar string, Referencia string, CodigoMarca string, "
                                 "NumeroTransferencia int, Fecha date").withColumn("Fecha", F.col("Fecha").cast("timestamp"))


def test_last_movement_orders_by_date_then_number(spark):
    from datetime import date
    mv = movement_rows(spark, [("ABC", "AB", "C", 1, date(2024, 2, 1)), ("ABC", "AB", "C", 2, date(2024, 2, 1)),
                               ("ABC", "AB", "C", 9, date(2023, 2, 1)), ("ABC", "AB", "C", 10, None),
                               ("ABC", "A", "BC", 3, None)])
    got = {(r["Referencia"]): (r["NumeroTransferencia"], r["Fecha"]) for r in sl.last_movement(mv).collect()}
    assert got == {"AB": (2, "01/02/2024"), "A": (3, None)}


def test_colliding_keys_multiply_rows_unless_joined_by_pair(spark):
    from datetime import date
    last = sl.last_movement(movement_rows(spark, [("ABC", "AB", "C", 1, date(2024, 2, 1)),
                                                  ("ABC", "A", "BC", 2, date(2024, 2, 2))]))
    df = snapshot_frame(spark, [snapshot_row("AB", "C"), snapshot_row("zz", "C")]).drop("Fecha")
    assert sorted(r["Fecha"] for r in sl.with_last_movement(df, last).collect()) == ["01/02/2024", "02/02/2024"]
    assert [r["Fecha"] for r in sl.with_last_movement(df, last, key="pair").collect()] == ["01/02/2024"]


def test_catalog_fallback_format_and_repeats(spark):
    df = spark.createDataFrame([("a", "5%"), ("b", "6%"), ("c", None), ("d", "7%"), ("e", "8%"), (None, "9%")],
                               "Concatenar string, Descuento string")
    catalog = spark.createDataFrame([("a", "12.5"), ("a", " 7 %"), ("b", " "), ("c", "nan"), ("d", "promo"), (None, "1%")],
                                    "Concatenar string, Descuento_Catalogo string")
    got = sorted((str(r["Concatenar"]), str(r["Descuento_Catalogo"])) for r in sl.with_catalog(df, catalog).collect())
    assert got == [("None", "9%"), ("a", "12%"), ("a", "7%"), ("b", "6%"), ("c", "None"), ("d", "promo"), ("e", "8%")]
    assert {r[2] for r in sl.with_catalog(df, None).collect()} == {""}
    with pytest.raises(ValueError):
        sl.with_catalog(df, catalog.drop("Descuento_Catalogo"))


def test_lookups_keep_misses(spark):
    items = spark.createDataFrame([("ROPA1", "B1"), ("XX", None)], "codigo_categoria string, codigo_marca string")
    names = spark.createDataFrame([("ROPA", "Ropa"), ("B1", "Marca")], "codigo string, nombre string")
    assert [r["Linea"] for r in sl.prefix_lookup(items, names).collect()] == ["Ropa", None]
    assert [r["Marca"] for r in sl.brand_lookup(items, names).collect()] == ["Marca", None]


def test_order_is_global(spark):
    df = snapshot_frame(spark, [snapshot_row(f"r{i % 7}", f"b{i % 3}") for i in range(200)] + [snapshot_row(None)])
    refs = [r["Referencia"] for r in sl.order_by_reference(df.repartition(8)).collect()]
    assert refs[0] is None and refs[1:] == sorted(refs[1:])


def test_region_choices(spark):
    df = snapshot_frame(spark, [snapshot_row(region=r) for r in ("B - Sucursales", "A - Sucursales", None, "X")])
    assert [r["Region"] for r in sl.region_choices(df, "Solo Sucursales").collect()] == [
        "Todas", "A - Sucursales", "B - Sucursales"]
    assert [r[0] for r in sl.distinct_values(df, "Region").collect()] == ["A - Sucursales", "B - Sucursales", "X"]
