"""Order-free checksums of a table's columns, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted


def canonical_text(col: Column, kind: T.DataType) -> Column:
    """A value as text: fractions in whole hundredths, times to the second in ISO form."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.round(col * 100).cast("bigint").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def column_checksums(df: DataFrame) -> DataFrame:
    """A row (column, rows, nulls, checksum) for each column of ``df``, in one pass.

    The checksum is the sum of the first 32 bits of the MD5 of every value's canonical
    text, so rows may come in any order but a changed, missing or repeated value shows.
    Nulls add nothing and are counted.  Columns of nested types are not supported.
    """
    parts = []
    for i, field in enumerate(df.schema.fields):
        text = canonical_text(quoted(field.name), field.dataType)
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
        parts += [F.count(quoted(field.name)).alias(f"n{i}"), F.coalesce(F.sum(bits), F.lit(0)).alias(f"s{i}")]
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = F.array(*[F.struct(F.lit(name).alias("column"), F.col("rows"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                              F.col(f"s{i}").alias("checksum")) for i, name in enumerate(df.columns)])
    return sums.select(F.inline(rows))
