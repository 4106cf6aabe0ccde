"""Joins of the star schema, the transfer movements and the discount catalog.

Only the store dimension of the star join is broadcast by hint, behind a count.  Elsewhere Spark broadcasts a side when its estimated
or, with adaptive execution, its measured size is below the session threshold;
otherwise both sides are shuffled and oversized partitions of a hot key are
split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require
from ..functions.items import item_key, pct_text
from ..functions.text import quoted, stripped
from ..names import CATALOG_DISCOUNT, DISCOUNT, ITEM_KEY, STOCK
from .filters import nonnegative_stock, valid_headers, valid_lines

Tables = dict[str, DataFrame]
MAX_BROADCAST_STORES = 10_000


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join rows with one row per group, NULL keys matching NULL.

    The null-safe comparison also gives the join a shuffle of its own on both
    sides.  Were the groups' aggregate shuffle reused, adaptive execution could
    not split the rows of a hot group.
    """
    twin = {k: f"_group_{i}" for i, k in enumerate(keys)}
    same = [quoted(k).eqNullSafe(F.col(t)) for k, t in twin.items()]
    return df.join(groups.withColumnsRenamed(twin), reduce(Column.__and__, same), how).drop(*twin.values())


def attach_group_values(df: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    """Put per-group aggregates on every row of the group.

    The groups are aggregated first (combined on the map side, so a hot group
    shrinks before it is shuffled) and joined back; a window would hold the
    whole group in one task.
    """
    groups = df.groupBy(*[quoted(k) for k in keys]).agg(*values)
    return join_groups(df, groups, keys, "inner")


def label_by_table(df: DataFrame, key: str, rules: DataFrame, out: str, default: str) -> DataFrame:
    """Label a code from rules too long for literals: the first rule wins.

    ``rules`` has columns ``priority, value, label``; codes without a rule, and
    NULL, get ``default``.
    """
    first = (rules.filter(F.col("value").isNotNull()).groupBy(F.col("value").alias(key))
                  .agg(F.min_by("label", "priority").alias("_rule_label")))
    return (join_groups(df, first, [key], "left")
            .withColumn(out, F.coalesce("_rule_label", F.lit(default))).drop("_rule_label"))


def item_dimension(tables: Tables) -> DataFrame:
    """Items with their category; items without a category drop out."""
    return tables["dim_item"].join(tables["dim_category"], "category_id")


def star_join(tables: Tables, fact: DataFrame | None = None,
              items: DataFrame | None = None) -> DataFrame:
    """Stock facts with item, category and store attributes, stock >= 0 only.

    Stores are few and hold most facts each, so they are broadcast if a count, which
    reads no further than the bound, finds at most MAX_BROADCAST_STORES; more of them
    are many keys and join by shuffle.
    """
    fact = nonnegative_stock(tables["fact_stock"]) if fact is None else fact
    items = item_dimension(tables) if items is None else items
    stores = tables["dim_store"]
    if stores.limit(MAX_BROADCAST_STORES + 1).count() <= MAX_BROADCAST_STORES:
        stores = F.broadcast(stores)
    return fact.join(items, "item_id").join(stores, "store_id")


def positive_items(df: DataFrame, stock: str = STOCK) -> DataFrame:
    """Rows of items having stock somewhere; rows with a NULL code drop out."""
    return join_groups(df, positive_keys(df, stock).dropna(), ["Referencia", "CodigoMarca"], "left_semi")


def positive_keys(df: DataFrame, stock: str = STOCK) -> DataFrame:
    """Distinct (reference, brand) pairs with positive stock in some row."""
    return df.filter(quoted(stock) > 0).select("Referencia", "CodigoMarca").distinct()


def prefix_lookup(df: DataFrame, categories: DataFrame, code: str = "codigo_categoria",
                  out: str = "Linea") -> DataFrame:
    """Line name: the category whose code is the first four characters."""
    lines = categories.select(F.col("codigo").alias("_line_code"), F.col("nombre").alias(out))
    return (df.join(lines, F.substring(quoted(code), 1, 4) == F.col("_line_code"), "left")
              .drop("_line_code"))


def brand_lookup(df: DataFrame, brands: DataFrame, code: str = "codigo_marca",
                 out: str = "Marca") -> DataFrame:
    names = brands.select(F.col("codigo").alias("_brand_code"), F.col("nombre").alias(out))
    return df.join(names, quoted(code) == F.col("_brand_code"), "left").drop("_brand_code")


def movements(tables: Tables, statuses=("2",), excluded_qty=(1, -1),
              lookups: bool = True) -> DataFrame:
    """Transfer lines with item, category, header, destination and maker.

    All filters sit below the joins.  ``lookups=False`` leaves out the brand and
    line names, which no later step of the snapshot reads.
    """
    lines = valid_lines(tables["movement_line"], excluded_qty)
    headers = (valid_headers(tables["movement_header"], statuses)
               .withColumnRenamed("status", "estado"))
    destinations = tables["destination"].select(F.col("codigo").alias("codigo_recibe"))
    items = tables["op_item"]
    categories = tables["op_category"].select(
        F.col("codigo").alias("codigo_categoria"), F.col("nombre").alias("CategoriaNombre"))
    makers = tables["maker"].select(
        F.col("codigo").alias("codigo_fabricante"), F.col("nombre").alias("Fabricante"))
    found = (lines.join(headers, "numero")
                  .join(destinations, "codigo_recibe")
                  .join(items, "codigo_barra")
                  .join(categories, "codigo_categoria")
                  .join(makers, "codigo_fabricante"))
    if lookups:
        found = brand_lookup(found, tables["brand_lookup"])
        found = prefix_lookup(found, tables.get("line_lookup", tables["op_category"]))
    named = {
        ITEM_KEY: item_key(F.col("referencia"), F.col("codigo_marca")),
        "CodigoBarra": F.col("codigo_barra"),
        "Referencia": F.col("referencia"),
        "CodigoMarca": F.col("codigo_marca"),
        "Nombre": F.col("nombre"),
        "Fabricante": F.col("Fabricante"),
        "CategoriaCodigo": F.substring("codigo_categoria", 1, 4),
        "CategoriaNombre": F.col("CategoriaNombre"),
        "Cantidad": F.col("cantidad"),
        "NumeroTransferencia": F.col("numero"),
        "Fecha": F.col("fecha"),
    }
    optional = {"Marca": "Marca", "Linea": "Linea",
                "Correccion": "correccion", "Observacion": "observacion"}
    named.update({out: F.col(src) for out, src in optional.items() if src in found.columns})
    return found.select(*[c.alias(n) for n, c in named.items()])


def with_last_movement(df: DataFrame, last: DataFrame, key: str = "concatenar") -> DataFrame:
    """Snapshot rows with the date of the item's latest movement.

    ``key="concatenar"`` joins on the concatenated item key, where different
    (reference, brand) pairs may collide and multiply rows; ``key="pair"`` joins
    on the pair itself.
    """
    on = [ITEM_KEY] if key == "concatenar" else ["Referencia", "CodigoMarca"]
    return df.join(last.select(*on, "Fecha"), on, "inner")


def attributes_with_totals(attributes: DataFrame, totals: DataFrame, colocated: bool = False) -> DataFrame:
    """Attribute rows with the totals of their item; all rows of an item repeat them.

    ``colocated`` states that both sides come from rows stored by item (``sources.layout``):
    they are joined where they lie.  Neither side has a NULL item.
    """
    if colocated:
        return attributes.join(totals, ITEM_KEY, "left")
    return join_groups(attributes, totals, [ITEM_KEY], "left")


def with_catalog(df: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Add the catalog discount, falling back to the row's own where it is blank.

    Several catalog rows for one item multiply its rows.  The text is formatted
    as whole percent; without a catalog the column is empty text.
    """
    if catalog is None or ITEM_KEY not in df.columns:
        return df.withColumn(CATALOG_DISCOUNT, F.lit(""))
    require(catalog, [ITEM_KEY, CATALOG_DISCOUNT])
    listed = F.col(CATALOG_DISCOUNT).cast("string")
    blank = F.coalesce(stripped(listed).isin("", "nan", "NaN"), F.lit(True))
    own = F.col(DISCOUNT).cast("string") if DISCOUNT in df.columns else F.lit("")
    return (df.join(catalog.select(ITEM_KEY, CATALOG_DISCOUNT), ITEM_KEY, "left")
              .withColumn(CATALOG_DISCOUNT, pct_text(F.when(blank, own).otherwise(listed))))
