import pytest
from pyspark.sql import functions as F

import stocklens as sl
from data import random_snapshot, snapshot_frame, snapshot_row


def test_region_filter_precedes_the_branch_pivot(spark):
    df = snapshot_frame(spark, random_snapshot(5))
    narrowed = sl.stock_view(df, "Solo Sucursales", region="A - Sucursales")
    direct = sl.stock_view(df.filter("Region = 'A - Sucursales'"), "Solo Sucursales")
    assert sorted(map(str, narrowed.collect())) == sorted(map(str, direct.collect()))
    house = sl.stock_view(df, "Solo Casa Matriz")
    assert sl.stock_view(df, "Solo Casa Matriz", region="A - Sucursales").count() == house.count()


def test_promotions_of_rows_without_stock_do_not_reach_the_view(spark):
    df = snapshot_frame(spark, [snapshot_row("r", stock=0.0, promo=1, discount="50%", store="T1"),
                                snapshot_row("r", stock=2.0, promo=0, discount="0%", store="T2")])
    rows = sl.stock_view(df, "Solo Sucursales").collect()
    assert [(r["Promocion"], r["Descuento"], r["Sucursal_Total"]) for r in rows] == [(0, "0%", 2.0)]
    assert sl.stock_view(df, "Solo Sucursales", promo_only=True).count() == 0


def test_view_columns_and_catalog_modes(spark):
    df = snapshot_frame(spark, random_snapshot(6))
    catalog = spark.createDataFrame([("r1b1", "5"), ("r2b1", None)], "Concatenar string, Descuento_Catalogo string")
    view = sl.stock_view(df, "Todo", catalog)
    at = view.columns.index("Descuento")
    assert view.columns[at + 1] == "Descuento_Catalogo" and view.columns[-1] == "_dup_desc"
    both = sl.stock_view(df, "Todo", catalog, only_match=True, only_mismatch=True)
    match = sl.stock_view(df, "Todo", catalog, only_match=True)
    mismatch = sl.stock_view(df, "Todo", catalog, only_mismatch=True)
    assert both.count() == view.count() == match.count() + mismatch.count()


def test_reference_search_equals_filtering_the_full_view(spark):
    df = snapshot_frame(spark, random_snapshot(7) + [snapshot_row(" R1 ", "b9"), snapshot_row("r1b", "1")])
    full = sl.by_reference(sl.stock_view(df, "Todo"), "R1")
    got = sl.stock_view(df, "Todo", columns=[c for c in full.columns if " - " in c], reference=" r1 ")
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect())) and full.count() > 1


def test_unknown_filters_are_refused(spark):
    with pytest.raises(TypeError):
        sl.stock_view(snapshot_frame(spark, [snapshot_row()]), "Todo", colour="red")


def test_reference_filter_equals_a_filter_after_the_pivot(spark):
    """Also where the key does not begin with the reference, and for columns the item lacks."""
    rows = snapshot_frame(spark, random_snapshot(9)).withColumn("Concatenar", F.concat(F.lit("x-"), "Concatenar"))
    got = sl.stock_view(rows, "Solo Sucursales", reference="r1")
    kept = sl.Snapshot(lambda: rows)
    after = kept.view("Solo Sucursales", reference="r1")
    assert got.columns == after.columns and got.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, after.collect()))
    whole = sl.stock_view(rows, "Solo Sucursales")
    assert whole.columns == got.columns
    kept.release()


def test_year_column_comes_before_the_date(spark):
    rows = snapshot_frame(spark, random_snapshot(9)).withColumn("Año", F.lit(2020))
    all_rows = sl.stock_view(rows, "Solo Sucursales").count()
    assert sl.stock_view(rows, "Solo Sucursales", exclude_year=2024).count() == all_rows
    assert sl.stock_view(rows, "Solo Sucursales", exclude_year=2020).count() == 0
