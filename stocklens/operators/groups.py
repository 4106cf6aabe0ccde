"""Per-group values on every row, latest row per group, and output order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import DISCOUNT, DUPLICATE_FLAG, ITEM_KEY, REGION, STOCK
from .aggregates import scope_sums
from .filters import DAY_FIRST
from .joins import attach_group_values, join_groups

PAIR = ("Referencia", "CodigoMarca")


def with_scope_totals(df: DataFrame) -> DataFrame:
    """Main-house and branch stock of the item on each of its rows."""
    return attach_group_values(df, PAIR, *scope_sums(F.col(STOCK), F.col(REGION)))


def last_movement(mv: DataFrame) -> DataFrame:
    """Latest transfer per item, by date, then number, then the other columns.

    Spark keeps only the first row per item in each map task before the shuffle,
    so a hot item costs one row per task.
    """
    ties = [c for c in mv.columns if c not in (*PAIR, "Fecha", "NumeroTransferencia")]
    latest = Window.partitionBy(*PAIR).orderBy(
        F.desc("Fecha"), F.desc("NumeroTransferencia"), *[F.asc(c) for c in ties])
    return (mv.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")
              .withColumn("Fecha", F.date_format("Fecha", DAY_FIRST)))


def duplicate_flag(df: DataFrame, enabled: bool = True, colocated: bool = False) -> DataFrame:
    """True on every row whose (item, discount) occurs more than once; NULLs are equal.

    Over rows stored by item, ``colocated`` counts them in place, in one scan without a
    shuffle of their own.
    """
    if not enabled or ITEM_KEY not in df.columns or DISCOUNT not in df.columns:
        return df.withColumn(DUPLICATE_FLAG, F.lit(False))
    key = [ITEM_KEY, DISCOUNT]
    if colocated:
        return df.withColumn(DUPLICATE_FLAG, F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1)
    repeated = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    return (join_groups(df, repeated, key, "left")
            .withColumn(DUPLICATE_FLAG, F.col("_n").isNotNull()).drop("_n"))


def order_by_reference(df: DataFrame) -> DataFrame:
    """Global order by reference.  The grain columns break ties, so the range
    partitioning can cut through a reference that holds many rows."""
    ties = [c for c in ("CodigoMarca", "CodigoBarra", "NombreTienda", "Promocion", "Status")
            if c in df.columns]
    return df.orderBy("Referencia", *ties)
