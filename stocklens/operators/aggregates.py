"""Grouped aggregates over the star join and the snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require
from ..functions.items import item_key, owner, region_bucket
from ..functions.text import quoted
from ..names import (
    ALL_REGIONS, BRANCH_WORD, FIXED_ATTRIBUTES, HOUSE_WORD, ITEM_KEY, REGION, STOCK,
)
from ..rules import StockRules
from .filters import nonnegative_stock, scope

# Item side of the snapshot grain; the other grain columns are the store, the
# promotion flag and the status.
ITEM_COLUMNS = (
    "referencia", "codigo_marca", "codigo_barra", "nombre_marca", "nombre",
    "fabricante", "codigo_sublinea", "nombre_sublinea",
    "nombre_categoria_principal", "nombre_categoria",
)
FLAGS = ("promocion", "status")


def _measures() -> list[Column]:
    return [F.sum("existencia").alias("existencia"),
            F.max("precio_detal").alias("precio_detal"),
            F.max("precio_promocion").alias("precio_promocion")]


def stock_cells(fact: DataFrame) -> DataFrame:
    """Facts summed per item, store, promotion and status by surrogate key.

    Sums and maxima compose, so this runs before the dimension joins: repeated
    facts of a hot item collapse on the map side, and afterwards an item has at
    most one row per store and flag pair.
    """
    return fact.groupBy("item_id", "store_id", *FLAGS).agg(*_measures())


def canonical_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One id per distinct item description.

    Returns ``(item_id, canon_id)`` for every item row and one row of
    descriptions per ``canon_id``.  Grouping facts by this id equals grouping
    them by all description columns, without shuffling those columns.
    """
    described = items.groupBy(*ITEM_COLUMNS).agg(F.min("item_id").alias("canon_id"))
    twin = {c: f"_d_{c}" for c in ITEM_COLUMNS}
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(t)) for c, t in twin.items()])
    ids = items.join(described.withColumnsRenamed(twin), same).select("item_id", "canon_id")
    return ids, described


def described_stock(fact: DataFrame, items: DataFrame, unique: bool) -> tuple[DataFrame, DataFrame]:
    """Stock per item, store, promotion and status on keys alone, and the item
    descriptions those keys stand for, both under ``canon_id``.

    Items with one description are one item: their cells are summed again under
    a common id.  ``unique=True`` states that there are none and saves that step; if
    the statement is wrong, such items keep rows of their own.
    """
    cells = stock_cells(fact)
    if unique:
        keyed = items.select(F.col("item_id").alias("canon_id"), *ITEM_COLUMNS)
        return cells.withColumnRenamed("item_id", "canon_id"), keyed
    ids, described = canonical_items(items)
    merged = cells.join(ids, "item_id").groupBy("canon_id", "store_id", *FLAGS).agg(*_measures())
    return merged, described


def stock_by_item_store(tables: dict[str, DataFrame], unique_items: bool = False) -> DataFrame:
    """Stock, highest price and highest promotion price per snapshot grain:
    item description, store, promotion and status.  Store ids are unique."""
    items = tables["dim_item"].join(tables["dim_category"], "category_id")
    stock, described = described_stock(
        nonnegative_stock(tables["fact_stock"]), items, unique_items)
    return stock.join(tables["dim_store"], "store_id").join(described, "canon_id").drop("canon_id")


def label_stock(df: DataFrame, rules: StockRules) -> DataFrame:
    """Item key, region and owner labels next to the source columns."""
    return df.withColumns({
        ITEM_KEY: item_key(F.col("referencia"), F.col("codigo_marca")),
        REGION: region_bucket(F.col("store_id"), rules),
        "Encargado": owner(F.col("nombre_sublinea"), rules),
    })


def scope_sums(stock: Column, region: Column) -> list[Column]:
    """Main-house and branch stock, told apart by the end of the region label."""
    return [
        F.sum(F.when(region.endswith(HOUSE_WORD), stock).otherwise(0)).alias("Existencia_Total_CasaMatriz"),
        F.sum(F.when(region.endswith(BRANCH_WORD), stock).otherwise(0)).alias("Existencia_Total_Sucursales"),
    ]


def stock_by_reference(df: DataFrame) -> DataFrame:
    """Total stock per reference; rows without a reference are left out."""
    return (df.filter(F.col("Referencia").isNotNull())
              .groupBy("Referencia").agg(F.sum(STOCK).alias(STOCK)))


def item_attributes(df: DataFrame, one_per_item: bool = True,
                    attributes=FIXED_ATTRIBUTES) -> DataFrame:
    """Attribute rows of the items: all distinct ones, or the smallest per item.

    "Smallest" compares the attributes in order with NULL first.  A minimum of texts sorts
    its rows, so it is taken over the distinct ones, which a hash finds.
    """
    require(df, attributes)
    rows = df.filter(F.col(ITEM_KEY).isNotNull()).select(*attributes)
    if not one_per_item:
        return rows.distinct()
    # Spark leaves out a plain distinct() below a minimum; a condition on its count stays.
    rows = rows.groupBy(*attributes).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    rest = [a for a in attributes if a != ITEM_KEY]
    return (rows.groupBy(ITEM_KEY).agg(F.min(F.struct(*rest)).alias("_first"))
                .select(*[F.col(a) if a == ITEM_KEY else F.col("_first")[a].alias(a)
                          for a in attributes]))


def distinct_values(df: DataFrame, col: str, view: str | None = None) -> DataFrame:
    """Sorted distinct values of a column, without NULL."""
    if view is not None:
        df = scope(df, view)
    return df.select(quoted(col)).dropna().distinct().orderBy(quoted(col))


def region_choices(df: DataFrame, view: str) -> DataFrame:
    """Choices of the region filter: the catch-all entry, then the regions of a view."""
    head = df.sparkSession.range(1).select(F.lit(0).alias("orden"), F.lit(ALL_REGIONS).alias(REGION))
    tail = distinct_values(df, REGION, view).select(F.lit(1).alias("orden"), REGION)
    return head.unionByName(tail).orderBy("orden", REGION)
