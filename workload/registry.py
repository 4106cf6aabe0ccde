"""Every operator and pipeline as a callable over a folder of test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stocklens as sl
from stocklens.functions.items import (
    discount_label, item_key, normalise_promo, owner, pct_text, percent_sign, region_bucket, share,
    store_label,
)
from stocklens.names import (
    BRANCH_TOTAL, HOUSE_TOTAL, VIEW_ALL, VIEW_BRANCHES, VIEW_HOUSE,
)
from stocklens.operators.aggregates import label_stock
from stocklens.operators.filters import positive_total
from stocklens.session import scratch_path
from stocklens.sources.catalog import as_catalog, load_catalog

from .fixtures import (
    BASE_TABLES, BRANCH_STORES, HOUSE_REGIONS, RULES, STATUSES, STORE_LABELS, WIDE_LABELS, fixture_tables,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MOVEMENT_COLUMNS = ("Concatenar", "CodigoBarra", "Referencia", "CodigoMarca", "Cantidad",
                    "NumeroTransferencia", "Fecha")
EXCLUDED_BRANDS = ("brand#1", " Brand#12 ", "BRAND#20")
EXCLUDED_SUBLINES = ("ec", "ST ")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ------------------------------------------------------------

def snapshot(spark: SparkSession, sf: str, **kw) -> DataFrame:
    # Bar codes are unique in the fixture, so no two items share a description.
    return sl.stock_snapshot(fixture_tables(spark, sf), RULES, statuses=STATUSES, unique_items=True, **kw)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot as the views read it; their result does not depend on its order."""
    return snapshot(spark, sf, ordered=False)


def shared_items(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables with the texts of every odd item replaced by those of the item before it."""
    tables = fixture_tables(spark, sf)
    items = tables["dim_item"]
    texts = [c for c in items.columns if c != "item_id"]
    even = items.withColumnRenamed("item_id", "_even").filter("_even % 2 = 0")
    own = items.filter("item_id % 2 = 0 or item_id = 1")
    odd = items.filter("item_id % 2 = 1 and item_id > 1").select("item_id", (F.col("item_id") - 1).alias("_even"))
    return {**tables, "dim_item": own.unionByName(odd.join(even, "_even").select("item_id", *texts))}


def store_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled stock per item and store, before totals and movements."""
    return label_stock(sl.stock_by_item_store(fixture_tables(spark, sf)), RULES).select(
        "Concatenar", F.col("referencia").alias("Referencia"),
        F.col("codigo_marca").alias("CodigoMarca"), F.col("codigo_barra").alias("CodigoBarra"),
        "Region", F.col("nombre_tienda").alias("NombreTienda"),
        F.col("existencia").alias("Existencia_Total"), F.col("promocion").alias("Promocion"),
        F.col("status").alias("Status"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    listed = fixture_tables(spark, sf)["discount_catalog"]
    return as_catalog(listed.toDF("Concatenar", " % Descuento "))


def v1(spark, sf):
    return sl.pivot_all_stores(rows(spark, sf), STORE_LABELS)


def v2(spark, sf):
    return sl.pivot_branches(rows(spark, sf), BRANCH_STORES)


def v3(spark, sf):
    return sl.pivot_main_house(rows(spark, sf), HOUSE_REGIONS)


def trimmed(df: DataFrame, *extra: str) -> DataFrame:
    """Item, brand and totals of a view: enough to tell its rows apart."""
    return df.select("Concatenar", "CodigoMarca", "Descuento", "Promocion", *extra)


# --- scans, sources, sinks ----------------------------------------------------

@query
def s1_load_snapshot_sources(spark, sf):
    tables = sl.load_sources(spark, sf, "parquet", BASE_TABLES)
    sums = [sl.column_checksums(df).select(F.lit(n).alias("tabla"), F.col("column").alias("columna"), F.col("rows").alias("filas"),
                                           F.col("nulls").alias("nulos"), F.col("checksum").alias("suma"))
            for n, df in tables.items()]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out


@query
def s2_load_table(spark, sf):
    return sl.load_table(spark, "part", sf, "parquet")


@query
def s3_load_catalog_files(spark, sf):
    path = scratch_path(spark, "catalog")
    listed = fixture_tables(spark, sf)["discount_catalog"]
    key, percent = F.col("concatenar").alias(" Concatenar "), F.col("pct_descuento").alias("% Descuento")
    note = F.lit("x;y").alias("nota")
    first = F.pmod(F.crc32(F.col("concatenar").cast("binary")), F.lit(2)) == 0
    for part, columns in ((first, (F.lit("2024").alias("campaña"), key, note, percent)),
                          (~F.coalesce(first, F.lit(False)), (percent, note, key))):
        (listed.filter(part).select(*columns)
               .write.mode("append").option("header", True).option("sep", ";").csv(path))
    return as_catalog(load_catalog(spark, path))


@query
def s3_catalog_cells_over_lines(spark, sf):
    """Catalog files whose notes hold separators, quotes and line breaks."""
    path = scratch_path(spark, "catalog-notes")
    listed = fixture_tables(spark, sf)["discount_catalog"]
    key, percent = F.col("concatenar").alias("Concatenar"), F.col("pct_descuento").alias("% Descuento")
    lines = F.pmod(F.crc32(F.col("concatenar").cast("binary")), F.lit(7)).cast("int")
    note = F.concat(F.lit('5" ; '), F.repeat(F.lit('uno; "dos"\n'), lines), F.lit("fin")).alias("nota")
    (listed.select(note, key, percent).write.option("header", True).option("sep", ";").option("escape", '"').csv(path))
    return as_catalog(load_catalog(spark, path))


@query
def s3_catalog_workbooks(spark, sf):
    """The catalog written as workbooks and imported from them."""
    path = scratch_path(spark, "catalog-books")
    listed = fixture_tables(spark, sf)["discount_catalog"].repartition(3)
    sl.write_workbooks(listed.select(F.lit("x;\ny").alias("nota"), F.col("pct_descuento").alias("% Descuento"),
                                     F.col("concatenar").alias(" Concatenar ")), path)
    return as_catalog(load_catalog(spark, path, fmt="workbook"))


@query
def s4_catalog_contract(spark, sf):
    return catalog(spark, sf)


@query
def s5_export_view(spark, sf):
    path = scratch_path(spark, "view")
    sl.export_view(v3(spark, sf), path, "parquet")
    return spark.read.parquet(path)


@query
def s5_export_workbook(spark, sf):
    """The main-house view exported as workbooks and read back: texts as they are, sums as numbers."""
    path = scratch_path(spark, "view-books")
    view = v3(spark, sf)
    sl.export_view(view, path, "workbook")
    cells = sl.read_workbooks(spark, path).filter("row > 0")
    return cells.select(*[F.get("cells", F.lit(i)).cast(kind).alias(n) for i, (n, kind) in enumerate(view.dtypes)])


@query
def s6_export_columns(spark, sf):
    return sl.export_columns(v1(spark, sf), ["CodigoMarca", "Concatenar", HOUSE_TOTAL],
                             [STORE_LABELS[0], STORE_LABELS[-1], BRANCH_TOTAL])


@query
def s7_discount_report(spark, sf):
    view = sl.with_catalog(v3(spark, sf), catalog(spark, sf))
    return sl.discount_report(view.withColumnRenamed("Concatenar", "Conoatenar"))


@query
def s8_snapshot_cache(spark, sf):
    shared = sl.Snapshot(lambda: rows(spark, sf))
    path = scratch_path(spark, "kept-views")
    for step in ("first", "again"):
        for name, view, columns, total in (("branches", VIEW_BRANCHES, BRANCH_STORES, BRANCH_TOTAL),
                                           ("house", VIEW_HOUSE, HOUSE_REGIONS, HOUSE_TOTAL)):
            made = shared.view(view, columns=columns)
            (made.select(F.lit(step).alias("carga"), F.lit(name).alias("vista"), "Concatenar", "CodigoMarca", "Descuento",
                         F.col(total).alias("total")).write.mode("append").parquet(path))
        shared.refresh()
    shared.release()
    return spark.read.parquet(path)


def changed_stock(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with three more pieces in every fact of one item in a hundred."""
    more = F.when(F.col("item_id") % 100 == 7, F.col("existencia") + 3).otherwise(F.col("existencia"))
    return {**tables, "fact_stock": tables["fact_stock"].withColumn("existencia", more)}


@query
def s8_refresh_by_change(spark, sf):
    """Views kept on files, after a refresh that finds one item in a hundred changed."""
    state = {"tables": fixture_tables(spark, sf)}
    kept = sl.KeptSnapshot(
        spark, scratch_path(spark, "kept-snapshot"),
        lambda: sl.stock_snapshot(state["tables"], RULES, statuses=STATUSES, unique_items=True, ordered=False),
        {"all": (VIEW_ALL, STORE_LABELS), "branches": (VIEW_BRANCHES, BRANCH_STORES), "house": (VIEW_HOUSE, HOUSE_REGIONS)}, ranges=32)
    kept.refresh()
    state["tables"] = changed_stock(state["tables"])
    kept.refresh()
    parts = [kept.pivot(name).select(F.lit(name).alias("vista"), "Concatenar", "CodigoMarca", "Descuento", "Promocion",
                                     F.col(total).alias("total"))
             for name, total in (("all", BRANCH_TOTAL), ("branches", BRANCH_TOTAL), ("house", HOUSE_TOTAL))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def s8_stored_by_item(spark, sf):
    """Snapshot and catalog stored by item: a flagged view with the catalog, without a shuffle by item."""
    name = f"by_item_{uuid.uuid4().hex}"
    stored = sl.store_by_item(rows(spark, sf), f"{name}_rows", 8)
    listed = sl.store_by_item(catalog(spark, sf), f"{name}_catalog", 8)
    return sl.stock_view(stored, VIEW_BRANCHES, listed, BRANCH_STORES, flag_duplicates=True, colocated=True)


@query
def v_all_views_one_pass(spark, sf):
    """All three views from one scan of the snapshot."""
    path = scratch_path(spark, "view-parts")
    sl.stock_and_attributes(rows(spark, sf)).write.parquet(path)
    views = sl.pivot_views(spark.read.parquet(path), {
        VIEW_ALL: STORE_LABELS, VIEW_BRANCHES: BRANCH_STORES, VIEW_HOUSE: HOUSE_REGIONS})
    named = (("all", VIEW_ALL, STORE_LABELS[0]), ("all_last", VIEW_ALL, BRANCH_TOTAL),
             ("branches", VIEW_BRANCHES, BRANCH_TOTAL), ("house", VIEW_HOUSE, HOUSE_TOTAL))
    parts = [views[view].select(F.lit(n).alias("vista"), *sl.names.FIXED_ATTRIBUTES, F.col(f"`{column}`").alias("cantidad"))
             for n, view, column in named]
    return reduce(DataFrame.unionByName, parts)


# --- projections and derived columns ------------------------------------------

@query
def p1_item_key(spark, sf):
    items = sl.brand_lookup(fixture_tables(spark, sf)["dim_item"],
                            fixture_tables(spark, sf)["brand_lookup"])
    return items.select("item_id", item_key(F.col("referencia"), F.col("codigo_marca")).alias("Concatenar"),
                        item_key(F.col("referencia"), F.col("Marca")).alias("con_nombre"))


@query
def p2_region_bucket(spark, sf):
    fact = fixture_tables(spark, sf)["fact_stock"]
    return (fact.select("store_id", region_bucket(F.col("store_id"), RULES).alias("Region"))
                .groupBy("store_id", "Region").agg(F.count(F.lit(1)).alias("filas")))


@query
def p3_discount_label(spark, sf):
    fact = fixture_tables(spark, sf)["fact_stock"]
    label = discount_label(F.col("precio_detal"), F.col("precio_promocion"))
    missing = discount_label(F.when(F.col("promocion") == 0, F.col("precio_detal")), F.col("precio_promocion"))
    return fact.select("item_id", "store_id", "precio_detal", "precio_promocion",
                       label.alias("Descuento"), missing.alias("sin_precio"))


@query
def p4_owner_assignment(spark, sf):
    items = sl.item_dimension(fixture_tables(spark, sf))
    return items.select("item_id", "nombre_sublinea",
                        owner(F.col("nombre_sublinea"), RULES).alias("Encargado"))


@query
def p5_store_column_label(spark, sf):
    return store_rows(spark, sf).select(
        "CodigoBarra", "Promocion", "Status",
        store_label(F.col("Region"), F.col("NombreTienda")).alias("etiqueta"))


@query
def p6_share_of_row_total(spark, sf):
    house, branch = F.col("Existencia_Total_CasaMatriz"), F.col("Existencia_Total_Sucursales")
    return (rows(spark, sf).select("Referencia", "CodigoMarca", house, branch).distinct()
            .withColumn("casa", percent_sign(share(house, house + branch)))
            .withColumn("sucursales", percent_sign(share(branch, house + branch))))


@query
def p7_share_of_global_total(spark, sf):
    totals = sl.stock_by_reference(store_rows(spark, sf))
    own = sl.global_share(totals, "Existencia_Total", out="parte")
    return sl.global_share(own, "Existencia_Total", 1000000.0, out="parte_dada")


@query
def p8_promo_flag_normalise(spark, sf):
    fact = fixture_tables(spark, sf)["fact_stock"]
    flag = (F.when(F.col("status") == "F", F.when(F.col("promocion") == 1, "true").otherwise("False"))
             .otherwise(F.concat_ws(" ", F.col("promocion").cast("string"), F.lit("x"))))
    return normalise_promo(fact.select("item_id", "store_id", "status", flag.alias("Promocion")))


@query
def p9_null_promo_without_stock(spark, sf):
    return sl.clear_promo_without_stock(rows(spark, sf)).select(
        "Concatenar", "CodigoBarra", "NombreTienda", "Status", "Existencia_Total", "Promocion", "Descuento")


@query
def p10_catalog_percent_format(spark, sf):
    part = sl.load_table(spark, "part", sf, "parquet")
    text = (F.when(F.col("p_size") < 10, F.col("p_brand"))
             .otherwise(F.concat((F.col("p_size") / 4).cast("string"), F.lit(" %"))))
    return part.select("p_partkey", text.alias("texto"), pct_text(text).alias("porcentaje"))


# --- filters ------------------------------------------------------------------

@query
def f1_nonnegative_stock(spark, sf):
    return sl.nonnegative_stock(fixture_tables(spark, sf)["fact_stock"])


@query
def f2_view_scope(spark, sf):
    return sl.scope(store_rows(spark, sf), VIEW_HOUSE)


@query
def f3_region_equals(spark, sf):
    return sl.by_region(sl.scope(store_rows(spark, sf), VIEW_BRANCHES), "R1 - Sucursales")


@query
def f4_brand_equals(spark, sf):
    return trimmed(sl.by_brand(v1(spark, sf), "Brand#12"), HOUSE_TOTAL, BRANCH_TOTAL)


@query
def f5_reference_equals(spark, sf):
    return trimmed(sl.by_reference(v1(spark, sf), " Red WIDGET "), "Referencia", HOUSE_TOTAL, BRANCH_TOTAL)


@query
def f6_exclude_brands(spark, sf):
    return trimmed(sl.exclude_brands(v1(spark, sf), EXCLUDED_BRANDS), HOUSE_TOTAL, BRANCH_TOTAL)


@query
def f7_exclude_sublines(spark, sf):
    return trimmed(sl.exclude_sublines(v1(spark, sf), EXCLUDED_SUBLINES), "CodigoSubLinea", HOUSE_TOTAL)


@query
def f8_promo_only(spark, sf):
    return trimmed(sl.promo_only(v3(spark, sf)), HOUSE_TOTAL)


@query
def f9_exclude_year(spark, sf):
    return sl.exclude_year(rows(spark, sf), "2001").select(
        "Concatenar", "CodigoBarra", "NombreTienda", "Promocion", "Status", "Fecha")


@query
def f9_exclude_year_spellings(spark, sf):
    """Order dates in four spellings, one of them no date."""
    day, turn = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    spelled = (F.when(turn == 0, F.date_format(day, "dd/MM/yyyy")).when(turn == 1, F.date_format(day, "d/M/yyyy"))
                .when(turn == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("sin fecha"))
    orders = sl.load_table(spark, "orders", sf, "parquet").select("o_orderkey", spelled.alias("Fecha"))
    return sl.exclude_year(orders, 1996, "Fecha")


@query
def f10_main_house_stock_range(spark, sf):
    return trimmed(sl.stock_range(v1(spark, sf)), HOUSE_TOTAL)


@query
def f11_value_search(spark, sf):
    return sl.value_search(rows(spark, sf), "Referencia", "RING")


@query
def f11_gram_search(spark, sf):
    """The same search, and shorter ones, on an index of letter runs."""
    index = sl.GramIndex(spark, scratch_path(spark, "grams"), "Referencia").build(rows(spark, sf))
    found = [index.search(text).select(F.lit(text).alias("texto"), "Referencia") for text in ("RING", "in", "G", "ring ")]
    return reduce(DataFrame.unionByName, found)


@query
def f12_catalog_match(spark, sf):
    view = sl.with_catalog(v3(spark, sf), catalog(spark, sf))
    return trimmed(sl.catalog_match(view, "match"), "Descuento_Catalogo", HOUSE_TOTAL)


@query
def f12_catalog_mismatch(spark, sf):
    view = sl.with_catalog(v3(spark, sf), catalog(spark, sf))
    return trimmed(sl.catalog_match(view, "mismatch"), "Descuento_Catalogo", HOUSE_TOTAL)


@query
def f13_duplicates_only(spark, sf):
    return trimmed(sl.dup_mode(sl.duplicate_flag(v2(spark, sf)), "dup"), "_dup_desc", BRANCH_TOTAL)


@query
def f13_unique_only(spark, sf):
    return trimmed(sl.dup_mode(sl.duplicate_flag(v2(spark, sf)), "unique"), "_dup_desc", BRANCH_TOTAL)


@query
def f14_drop_empty_rows(spark, sf):
    per_item = store_rows(spark, sf).groupBy("Concatenar").agg(
        F.sum(F.when(F.col("Region").contains("Casa Matriz"), F.col("Existencia_Total")).otherwise(0)).alias(HOUSE_TOTAL),
        F.sum(F.when(F.col("Region").contains("Sucursales"), F.col("Existencia_Total")).otherwise(0)).alias(BRANCH_TOTAL))
    kept = sl.drop_empty_rows(per_item, HOUSE_TOTAL, BRANCH_TOTAL)
    return kept.withColumn("en_casa", F.col(HOUSE_TOTAL) > 0)


@query
def f14_positive_total(spark, sf):
    per_item = sl.scope(store_rows(spark, sf), VIEW_HOUSE).groupBy("Concatenar").agg(
        F.sum("Existencia_Total").alias(HOUSE_TOTAL))
    return positive_total(per_item, HOUSE_TOTAL)


@query
def f15_movement_filter(spark, sf):
    t = fixture_tables(spark, sf)
    return sl.valid_movements(t["movement_line"], t["movement_header"], STATUSES)


# --- joins --------------------------------------------------------------------

@query
def j1_star_join(spark, sf):
    return sl.star_join(fixture_tables(spark, sf)).select(
        "item_id", "store_id", "referencia", "codigo_marca", "codigo_barra", "nombre_sublinea",
        "nombre_categoria_principal", "nombre_tienda", "existencia", "precio_detal",
        "precio_promocion", "promocion", "status")


@query
def j2_positive_items_semi(spark, sf):
    return sl.positive_items(store_rows(spark, sf))


@query
def j3_movement_join(spark, sf):
    return sl.movements(fixture_tables(spark, sf), STATUSES).select(
        *MOVEMENT_COLUMNS, "Nombre", "Fabricante", "CategoriaCodigo", "CategoriaNombre", "Marca", "Linea")


@query
def j4_prefix_lookup(spark, sf):
    t = fixture_tables(spark, sf)
    return sl.prefix_lookup(t["op_item"], t["line_lookup"]).select("codigo_barra", "codigo_categoria", "Linea")


@query
def j5_brand_lookup(spark, sf):
    t = fixture_tables(spark, sf)
    return sl.brand_lookup(t["op_item"], t["brand_lookup"]).select("codigo_barra", "codigo_marca", "Marca")


@query
def j6_last_movement_join(spark, sf):
    last = sl.last_movement(sl.movements(fixture_tables(spark, sf), STATUSES, lookups=False))
    return sl.with_last_movement(store_rows(spark, sf), last)


@query
def j7_attributes_with_pivot(spark, sf):
    snap = rows(spark, sf)
    totals = snap.groupBy("Concatenar").agg(F.sum("Existencia_Total").alias("total"))
    return sl.attributes_with_totals(sl.item_attributes(snap, one_per_item=False), totals)


@query
def j8_catalog_left_join(spark, sf):
    view = sl.with_catalog(v1(spark, sf), catalog(spark, sf))
    return trimmed(view, "Descuento_Catalogo", HOUSE_TOTAL)


# --- aggregations and pivots --------------------------------------------------

@query
def a1_stock_by_item_store(spark, sf):
    return sl.stock_by_item_store(fixture_tables(spark, sf))


@query
def a1_stock_by_shared_item(spark, sf):
    """Two items of one bar code are one item: the default path of A1."""
    return sl.stock_by_item_store(shared_items(spark, sf))


def other_spelling(name: str):
    """A text in lower case with a blank behind it: the same key to the warehouse's database."""
    return F.concat(F.lower(name), F.lit("  ")).alias(name)


@query
def k19_collated_shared_item(spark, sf):
    """A1 over items whose descriptions differ in case and trailing blanks alone."""
    tables = shared_items(spark, sf)
    texts = [c for c, kind in tables["dim_item"].dtypes if kind == "string"]
    respelled = tables["dim_item"].select("item_id", *[
        F.when((F.col("item_id") % 2 == 1) & (F.col("item_id") > 1), other_spelling(c)).otherwise(F.col(c)).alias(c) for c in texts])
    stock = sl.plain_texts(sl.stock_by_item_store(sl.collate_tables({**tables, "dim_item": respelled})))
    return stock.select(*[F.upper(F.rtrim(c)).alias(c) if kind == "string" else c for c, kind in stock.dtypes])


@query
def k19_collated_view(spark, sf):
    """J2, J6, J8, P4: movements, rules, categories and catalog spell their keys in another way than the items."""
    tables = fixture_tables(spark, sf)
    items, lines = tables["op_item"], tables["dim_category"]
    keys = ("codigo_barra", "codigo_marca", "codigo_categoria", "codigo_fabricante")
    # A blank behind the reference would stand inside the item key, where it counts.
    tables["op_item"] = items.select(*[other_spelling(c) if c in keys else c for c in items.columns]).withColumn(
        "referencia", F.lower("referencia"))
    tables["dim_category"] = lines.select(*[other_spelling(c) if c in ("category_id", "nombre_sublinea") else c for c in lines.columns])
    listed = catalog(spark, sf).withColumn("Concatenar", other_spelling("Concatenar"))
    rows = sl.stock_snapshot(sl.collate_tables(tables), RULES, statuses=STATUSES, unique_items=True, ordered=False)
    view = sl.plain_texts(sl.stock_view(rows, VIEW_HOUSE, sl.collate_keys(listed, ["Concatenar"]), HOUSE_REGIONS, flag_duplicates=True))
    return view.withColumn("Linea", F.upper(F.rtrim("Linea")))


@query
def a2_positive_keys(spark, sf):
    return sl.positive_keys(store_rows(spark, sf))


@query
def a3_stock_by_reference(spark, sf):
    return sl.stock_by_reference(rows(spark, sf))


@query
def a4_first_attributes(spark, sf):
    return sl.item_attributes(rows(spark, sf))


@query
def a4_distinct_attributes(spark, sf):
    return sl.item_attributes(sl.scope(rows(spark, sf), VIEW_BRANCHES), one_per_item=False)


@query
def a5_distinct_values(spark, sf):
    return sl.distinct_values(rows(spark, sf), "Referencia")


@query
def a5_region_choices(spark, sf):
    return sl.region_choices(store_rows(spark, sf), VIEW_BRANCHES)


@query
def v1_pivot_all_stores(spark, sf):
    return v1(spark, sf)


@query
def v1_pivot_many_columns(spark, sf):
    """More than 80 columns: the stores once for each status and promotion flag."""
    split = F.concat_ws("/", "NombreTienda", "Status", "Promocion")
    return sl.pivot_all_stores(rows(spark, sf).withColumn("NombreTienda", split), WIDE_LABELS).select(
        "Concatenar", HOUSE_TOTAL, BRANCH_TOTAL, *[F.col(f"`{c}`") for c in WIDE_LABELS])


@query
def v2_pivot_branches(spark, sf):
    return v2(spark, sf)


@query
def v3_pivot_main_house(spark, sf):
    return v3(spark, sf)


@query
def v4_pivot_main_house_share(spark, sf):
    return sl.pivot_main_house_share(rows(spark, sf), columns=HOUSE_REGIONS)


# --- per-group values ---------------------------------------------------------

@query
def n1_item_totals_by_scope(spark, sf):
    return sl.with_scope_totals(store_rows(spark, sf))


@query
def n2_last_movement(spark, sf):
    mv = sl.movements(fixture_tables(spark, sf), STATUSES, lookups=False)
    return sl.last_movement(mv.select(*MOVEMENT_COLUMNS))


@query
def n3_duplicate_flag(spark, sf):
    return trimmed(sl.duplicate_flag(v3(spark, sf)), "Linea", "Encargado", "_dup_desc", HOUSE_TOTAL)


@query
def o1_order_by_reference(spark, sf):
    return sl.order_by_reference(store_rows(spark, sf))


# --- end-to-end ---------------------------------------------------------------

@query
def q1_stock_snapshot(spark, sf):
    return snapshot(spark, sf)


@query
def q1_stock_snapshot_shared_item(spark, sf):
    """The default path of Q1 over items that share descriptions."""
    return sl.stock_snapshot(shared_items(spark, sf), RULES, statuses=STATUSES, ordered=False).select(
        "Referencia", "CodigoBarra", "NombreTienda", "Promocion", "Status", "Existencia_Total", "Descuento",
        "Existencia_Total_CasaMatriz", "Existencia_Total_Sucursales", "Fecha")


@query
def q2_stock_view(spark, sf):
    return sl.stock_view(
        rows(spark, sf), VIEW_BRANCHES, catalog(spark, sf), BRANCH_STORES,
        exclude_brands=EXCLUDED_BRANDS, exclude_sublines=EXCLUDED_SUBLINES, exclude_year=2001,
        promo_only=True, flag_duplicates=True)


@query
def q2_stock_view_all_stores(spark, sf):
    return sl.stock_view(
        rows(spark, sf), VIEW_ALL, catalog(spark, sf), STORE_LABELS,
        exclude_brands=EXCLUDED_BRANDS, exclude_year=2001, stock_range=(1, 500),
        only_mismatch=True, flag_duplicates=True, dup_mode="unique")


@query
def q2_stock_view_reference(spark, sf):
    return sl.stock_view(rows(spark, sf), VIEW_HOUSE, None, HOUSE_REGIONS,
                         reference="red widget", flag_duplicates=True, dup_mode="dup")


@query
def q3_discount_audit(spark, sf):
    return sl.discount_audit(rows(spark, sf), catalog(spark, sf), HOUSE_REGIONS)
