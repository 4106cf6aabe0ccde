"""Plans and hot keys: what must hold when the data no longer fits one task."""

import contextlib
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import stocklens as sl
from data import SNAPSHOT_DDL
from stocklens.operators.joins import label_by_table
from workload import registry as reg
from workload.fixtures import BRANCH_STORES, HOUSE_REGIONS, RULES, STATUSES, STORE_LABELS, fixture_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@contextlib.contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def no_broadcast(spark, **more):
    return settings(spark, spark__sql__autoBroadcastJoinThreshold="-1",
                    spark__sql__adaptive__autoBroadcastJoinThreshold="-1", **more)


def skew_settings(spark):
    """Shuffled joins only, with limits low enough for a small hot key."""
    return no_broadcast(
        spark, spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__forceOptimizeSkewedJoin="false")


@pytest.fixture(scope="module")
def hot_rows(spark):
    """30,000 snapshot rows, a third of them of one item with one discount."""
    ids = spark.range(0, 30000, 1, 16)
    hot = F.col("id") < 10000
    made = {
        "Referencia": F.when(hot, "hot").otherwise(F.concat(F.lit("r"), F.col("id") / 4)),
        "CodigoMarca": F.lit("b"), "Descuento": F.lit("5%"), "Promocion": F.lit(1),
        "Region": F.when(F.col("id") % 2 == 0, "A - Casa Matriz").otherwise("A - Sucursales"),
        "NombreTienda": F.concat(F.lit("T"), F.col("id") % 10), "Existencia_Total": F.lit(1.0),
        "Nombre": F.sha2(F.col("id").cast("string"), 512), "Fecha": F.lit("01/02/2024"),
    }
    names = [c.split()[0] for c in SNAPSHOT_DDL.split(", ")]
    base = ids.select(*[c.alias(n) for n, c in made.items()]).withColumn(
        "Concatenar", F.concat("Referencia", "CodigoMarca"))
    return base.select(*[F.col(n) if n in base.columns else F.lit(None).cast("string").alias(n) for n in names])


def run_final(df):
    """Rows and the final adaptive plan."""
    rows = df.collect()
    return rows, plan(df)


def test_hot_item_is_split_for_scope_totals(spark, hot_rows):
    source = hot_rows.drop("Existencia_Total_CasaMatriz", "Existencia_Total_Sucursales")
    with skew_settings(spark):
        rows, final = run_final(sl.with_scope_totals(source))
    assert "skew=true" in final
    assert len(rows) == 30000
    hot = [r for r in rows if r["Referencia"] == "hot"]
    assert len(hot) == 10000
    assert {(r["Existencia_Total_CasaMatriz"], r["Existencia_Total_Sucursales"]) for r in hot} == {(5000.0, 5000.0)}


def test_hot_item_is_split_for_the_stock_test(spark, hot_rows):
    with skew_settings(spark):
        rows, final = run_final(sl.positive_items(hot_rows))
    assert "skew=true" in final and len(rows) == 30000


def test_hot_code_is_split_for_long_rule_lists(spark, hot_rows):
    rules = hot_rows.select(F.lit(1).alias("priority"), F.col("Referencia").alias("value"),
                            F.concat(F.lit("x "), "Referencia").alias("label"))
    with skew_settings(spark):
        rows, final = run_final(label_by_table(hot_rows, "Referencia", rules, "out", "none"))
    assert "skew=true" in final and all(r["out"] == f"x {r['Referencia']}" for r in rows) and len(rows) == 30000


def test_hot_duplicates_are_split(spark, hot_rows):
    with skew_settings(spark):
        rows, final = run_final(sl.duplicate_flag(hot_rows))
    assert "skew=true" in final
    assert len(rows) == 30000 and sum(r["_dup_desc"] for r in rows if r["Referencia"] == "hot") == 10000


def test_hot_item_is_split_for_the_last_movement(spark, hot_rows):
    last = hot_rows.groupBy("Concatenar", "Referencia", "CodigoMarca").agg(F.max("Fecha").alias("Fecha"))
    with skew_settings(spark):
        rows, final = run_final(sl.with_last_movement(hot_rows.drop("Fecha"), last))
    assert "skew=true" in final and len(rows) == 30000


def test_hot_item_is_split_for_attributes(spark, hot_rows):
    with skew_settings(spark):
        rows, final = run_final(sl.pivot_branches(hot_rows, ["T1", "T3"]))
    hot = [r for r in rows if r["Referencia"] == "hot"]
    assert "skew=true" in final and len(hot) == 5000
    assert {(r["T1"], r["Sucursal_Total"]) for r in hot} == {(1000.0, 5000.0)}


def test_hot_transfer_is_split(spark):
    lines = spark.range(0, 30000, 1, 16).select(
        F.when(F.col("id") < 10000, 0).otherwise(F.col("id")).cast("int").alias("numero"),
        F.sha2(F.col("id").cast("string"), 512).alias("codigo_barra"), F.lit(2.0).alias("cantidad"))
    heads = spark.range(0, 30000, 1, 16).select(F.col("id").cast("int").alias("numero"), F.lit("2").alias("status"))
    with skew_settings(spark):
        rows, final = run_final(sl.valid_movements(lines, heads))
    assert "skew=true" in final and len(rows) == 30000


def test_hot_item_in_the_snapshot(spark):
    """A third of the facts and of the transfers belong to one item."""
    ids = spark.range(0, 30000, 1, 16).withColumn("item", F.when(F.col("id") < 10000, 0).otherwise(F.col("id") % 500))
    tables = {
        "fact_stock": ids.select(
            F.col("item").alias("item_id"), (F.col("id") % 7).alias("store_id"), F.lit(1.0).alias("existencia"),
            F.lit(10.0).alias("precio_detal"), F.lit(8.0).alias("precio_promocion"),
            (F.col("id") % 2).cast("int").alias("promocion"), F.lit("F").alias("status")),
        "dim_item": spark.range(500).select(
            F.col("id").alias("item_id"), F.lit(1).alias("category_id"), *[
                F.concat(F.lit(c), F.col("id")).alias(c) for c in (
                    "referencia", "codigo_marca", "codigo_barra", "nombre_marca", "nombre", "fabricante",
                    "nombre_categoria")]),
        "dim_category": spark.range(1).select(F.lit(1).alias("category_id"), *[
            F.lit("c").alias(c) for c in ("codigo_sublinea", "nombre_sublinea", "nombre_categoria_principal")]),
        "dim_store": spark.range(7).select(F.col("id").alias("store_id"), F.col("id").cast("string").alias("nombre_tienda")),
        "movement_line": ids.select(F.col("id").alias("numero"), F.lit(5).alias("cantidad"),
                                    F.concat(F.lit("codigo_barra"), "item").alias("codigo_barra")),
        "movement_header": ids.select(F.col("id").alias("numero"), F.lit("2").alias("status"), F.lit(1).alias("codigo_recibe"),
                                      F.timestamp_seconds(F.col("id") * 1000).alias("fecha")),
        "destination": spark.range(1).select(F.lit(1).alias("codigo")),
        "op_category": spark.range(1).select(F.lit("k").alias("codigo"), F.lit("k").alias("nombre")),
        "maker": spark.range(1).select(F.lit("m").alias("codigo"), F.lit("m").alias("nombre")),
    }
    tables["op_item"] = tables["dim_item"].select(
        "codigo_barra", "referencia", "codigo_marca", "nombre", F.lit("k").alias("codigo_categoria"),
        F.lit("m").alias("codigo_fabricante"))
    assert sl.stock_cells(tables["fact_stock"]).filter("item_id = 0").count() == 14
    rules = sl.StockRules(regions=(sl.LabelRule("A - Casa Matriz", (0,)),), owners=())
    with skew_settings(spark):
        rows = sl.stock_snapshot(tables, rules).collect()
    hot = [r for r in rows if r["Referencia"] == "referencia0"]
    per_item = 20000 / 500
    assert len(hot) == 14 and sum(r["Existencia_Total"] for r in hot) == 10000 + per_item
    assert sum(r["Existencia_Total"] for r in rows) == 30000
    house = sum(r["Existencia_Total"] for r in hot if r["NombreTienda"] == "0")
    assert {r["Existencia_Total_CasaMatriz"] for r in hot} == {house}
    latest = datetime(1970, 1, 1) + timedelta(seconds=29500 * 1000)  # transfer 29500 is the item's last
    assert {r["Fecha"] for r in hot} == {latest.strftime("%d/%m/%Y")} and {r["Descuento"] for r in rows} == {"20%"}


def test_latest_rows_are_cut_before_the_shuffle(spark):
    mv = sl.movements(fixture_tables(spark, SF), STATUSES, lookups=False)
    # In this order from the top: the final limit, the shuffle, the limit of each task.
    nodes = [line.strip(" +-:") for line in plan(sl.last_movement(mv)).splitlines()]
    limits = [i for i, n in enumerate(nodes) if n.startswith("WindowGroupLimit")]
    assert [nodes[i].rsplit(", ", 1)[-1] for i in limits] == ["Final", "Partial"]
    assert any(n.startswith("Exchange") for n in nodes[limits[0]:limits[1]])


def test_facts_are_combined_before_their_only_shuffle(spark):
    with no_broadcast(spark):
        text = plan(reg.rows(spark, SF))
    assert "Window" not in text
    assert "HashAggregate" in text and "SortAggregate" not in text
    # every shuffle on the store alone reads sums per item and store or the store dimension, and no texts
    for at in re.finditer(r"Exchange hashpartitioning\(store_id#\d+, \d+\)", text):
        below = text[at.end():at.end() + 1500].split("Exchange", 1)[0]
        assert "nombre" not in below.split("nombre_tienda")[0]
        assert "existencia" not in below or "sum(existencia" in below
    # text columns of the items are not part of the grouped keys
    keys = re.search(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[sum\(existencia", text).group(1)
    assert re.sub(r"#\d+L?", "", keys) == "item_id, store_id, promocion, status"


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    tables = fixture_tables(spark, SF)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(str(tmp_path / name))
    stored = {n: spark.read.parquet(str(tmp_path / n)) for n in tables}
    text = plan(sl.stock_snapshot(stored, RULES, statuses=STATUSES, unique_items=True))
    assert "GreaterThanOrEqual(existencia,0.0)" in text and "EqualTo(status,F)" in text
    assert "ReadSchema: struct<item_id:bigint,store_id:int,existencia:double>" in text
    view = sl.pivot_main_house(reg.rows(spark, SF), HOUSE_REGIONS)
    view.write.mode("overwrite").parquet(str(tmp_path / "snap_view"))
    reg.rows(spark, SF).write.mode("overwrite").parquet(str(tmp_path / "snap"))
    text = plan(sl.pivot_branches(spark.read.parquet(str(tmp_path / "snap")), BRANCH_STORES))
    assert "StringContains(Region,Sucursales)" in text
    assert "ReadSchema: struct<Concatenar:string,Region:string,NombreTienda:string,Existencia_Total:double>" in text


@pytest.mark.parametrize("name", [
    "q1_stock_snapshot", "v1_pivot_all_stores", "v4_pivot_main_house_share", "q2_stock_view",
    "q2_stock_view_all_stores", "q3_discount_audit", "n1_item_totals_by_scope", "n3_duplicate_flag",
    "j3_movement_join", "s3_load_catalog_files"])
def test_no_python_and_no_cross_products(spark, name):
    with no_broadcast(spark):
        text = plan(reg.QUERIES[name](spark, SF))
    assert not re.search(r"Python|CartesianProduct|NestedLoop", text)
    assert "SinglePartition" not in text.replace("Subquery", "") or name == "v4_pivot_main_house_share"


def test_unhinted_joins(spark):
    for name in ("q1_stock_snapshot", "q2_stock_view", "j8_catalog_left_join"):
        logical = reg.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "ResolvedHint" not in logical


def test_first_attributes_sort_distinct_rows_only(spark):
    """A minimum of texts is a sort aggregate: no sort may see the rows of the snapshot before a hash made them distinct."""
    rows = spark.createDataFrame([], SNAPSHOT_DDL)
    with no_broadcast(spark, spark__sql__adaptive__enabled="false"):
        for df in (sl.item_attributes(rows), sl.pivot_all_stores(rows, ["A - Casa Matriz - T1"])):
            lines = plan(df).splitlines()
            minima = [i for i, line in enumerate(lines) if "min(struct" in line or "min(named_struct" in line]
            assert minima and any("HashAggregate" in line and "count" in line for line in lines[minima[-1] + 1:])
