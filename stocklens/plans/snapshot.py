"""The stock snapshot: item x store x promotion state with the last movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import discount_label, item_key, region_bucket
from ..names import SNAPSHOT_COLUMNS
from ..operators.aggregates import (
    described_stock, label_stock, scope_sums,
)
from ..operators.filters import DAY_FIRST, nonnegative_stock, valid_headers, valid_lines
from ..operators.groups import order_by_reference
from ..operators.joins import Tables, item_dimension
from ..rules import StockRules

_PAIR = ["referencia", "codigo_marca"]


def pair_totals(tables: Tables, items: DataFrame, rules: StockRules) -> DataFrame:
    """Main-house and branch stock per (reference, brand), positive pairs only.

    Sums three columns of the facts per item and store, so only these cells meet the
    stores, and per item before it meets the item dimension.  Stock is never negative here, so a pair is positive exactly when
    one of its facts is.
    """
    fact = nonnegative_stock(tables["fact_stock"]).select("item_id", "store_id", "existencia")
    house, branch = scope_sums(F.col("existencia"), region_bucket(F.col("store_id"), rules))
    cells = fact.groupBy("item_id", "store_id").agg(F.sum("existencia").alias("existencia"))
    per_item = (cells.join(tables["dim_store"].select("store_id"), "store_id")
                    .groupBy("item_id")
                    .agg(house, branch, F.max("existencia").alias("_highest")))
    return (per_item.join(items.select("item_id", *_PAIR), "item_id")
                    .groupBy(*_PAIR)
                    .agg(F.sum("Existencia_Total_CasaMatriz").alias("Existencia_Total_CasaMatriz"),
                         F.sum("Existencia_Total_Sucursales").alias("Existencia_Total_Sucursales"),
                         F.max("_highest").alias("_highest"))
                    .filter("_highest > 0").drop("_highest"))


def last_movement_dates(tables: Tables, statuses=("2",), excluded_qty=(1, -1)) -> DataFrame:
    """Date of the latest transfer per (reference, brand).

    Only the date of the latest row is kept, and that is the greatest date; so a
    maximum per bar code, then per pair, replaces the ordered window, and lookups
    that can at most repeat rows become semi joins.
    """
    headers = valid_headers(tables["movement_header"], statuses).join(
        tables["destination"], F.col("codigo_recibe") == F.col("codigo"), "left_semi")
    per_code = (valid_lines(tables["movement_line"], excluded_qty).select("numero", "codigo_barra")
                .join(headers.select("numero", "fecha"), "numero")
                .groupBy("codigo_barra").agg(F.max("fecha").alias("fecha")))
    items = (tables["op_item"]
             .join(tables["op_category"], F.col("codigo_categoria") == F.col("codigo"), "left_semi")
             .join(tables["maker"], F.col("codigo_fabricante") == F.col("codigo"), "left_semi"))
    return (per_code.join(items.select("codigo_barra", *_PAIR), "codigo_barra")
                    .groupBy(*_PAIR).agg(F.max("fecha").alias("fecha")))


def stock_snapshot(tables: Tables, rules: StockRules, *, key: str = "concatenar",
                   statuses=("2",), excluded_qty=(1, -1), ordered: bool = True,
                   unique_items: bool = False) -> DataFrame:
    """The 21-column snapshot.

    Facts are summed on keys alone, before any join, and the cells once more under one
    id per item description unless ``unique_items`` states that no two items share one.
    Totals and movement dates are worked out per (reference, brand) and attached to the
    item descriptions.  The cells meet the stores before they meet the texts, so the wide
    text columns join last.
    """
    items = item_dimension(tables)
    stock, described = described_stock(
        nonnegative_stock(tables["fact_stock"]), items, unique_items)
    moved = last_movement_dates(tables, statuses, excluded_qty).select(
        F.col("referencia").alias("_mov_ref"), F.col("codigo_marca").alias("_mov_brand"),
        F.date_format("fecha", DAY_FIRST).alias("Fecha"))
    if key == "pair":
        same = (F.col("referencia") == F.col("_mov_ref")) & (F.col("codigo_marca") == F.col("_mov_brand"))
    else:
        # Different pairs may share a concatenated key; each one repeats the rows.
        same = (item_key(F.col("referencia"), F.col("codigo_marca"))
                == item_key(F.col("_mov_ref"), F.col("_mov_brand")))
    wanted = pair_totals(tables, items, rules).join(moved, same).drop("_mov_ref", "_mov_brand")
    rows = label_stock(stock.join(tables["dim_store"], "store_id")
                            .join(described.join(wanted, _PAIR), "canon_id"), rules)
    named = {
        "Referencia": F.col("referencia"), "CodigoBarra": F.col("codigo_barra"),
        "NombreMarca": F.col("nombre_marca"), "CodigoMarca": F.col("codigo_marca"),
        "Nombre": F.col("nombre"), "Fabricante": F.col("fabricante"),
        "CodigoSubLinea": F.col("codigo_sublinea"), "Linea": F.col("nombre_sublinea"),
        "NombreCategoriaPrincipal": F.col("nombre_categoria_principal"),
        "NombreCategoria": F.col("nombre_categoria"),
        "Descuento": discount_label(F.col("precio_detal"), F.col("precio_promocion")),
        "NombreTienda": F.col("nombre_tienda"), "Existencia_Total": F.col("existencia"),
        "Promocion": F.col("promocion"), "Status": F.col("status"),
    }
    result = rows.select(*[named.get(c, F.col(c)).alias(c) for c in SNAPSHOT_COLUMNS])
    return order_by_reference(result) if ordered else result
