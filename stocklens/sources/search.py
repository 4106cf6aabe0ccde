"""Search while typing: a table of short letter runs to the values that hold them.

A value holds a text of three letters or more only if it holds each of the text's
three-letter runs, so a search reads the rows of those runs, keeps values that have all of
them and verifies these exactly.  Runs of one and two letters are kept as well, for texts
as short.  The runs are dealt to folders by hash and sorted, so the scan of a search is
pruned to a few row groups of a few folders, however many values there are.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted

LONGEST = 3
GRAM, VALUE, BUCKET = "_gram", "_value", "_bucket"


def grams(text: Column) -> Column:
    """The distinct runs of one to ``LONGEST`` characters of a text."""
    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.char_length(text) - size + 1)
        return F.when(F.char_length(text) >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(k) for k in range(1, LONGEST + 1)]))


class GramIndex:
    """The distinct values of a column, found by any part of their text, ignoring case.

    Equal to ``operators.filters.value_search`` on the column that it was built from.  NULL
    is no value; empty values hold no text.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, buckets: int = 64):
        self.spark, self.path, self.column, self.buckets = spark, path, column, buckets

    def build(self, df: DataFrame, mode: str = "errorifexists") -> GramIndex:
        """Write the runs of all distinct values; a run that most values have is written by several tasks."""
        values = df.select(quoted(self.column).alias(VALUE)).filter(F.col(VALUE).isNotNull()).distinct()
        rows = values.select(VALUE, F.explode(grams(F.lower(F.col(VALUE).cast("string")))).alias(GRAM))
        rows = rows.withColumn(BUCKET, (F.crc32(F.col(GRAM).cast("binary")) % self.buckets).cast("int"))
        (rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, GRAM, VALUE)
             .write.mode(mode).partitionBy(BUCKET).parquet(self.path))
        return self

    def search(self, text: str, n: int | None = None) -> DataFrame:
        """Values that contain ``text``, in order: all, or the first ``n``."""
        table = self.spark.read.parquet(self.path)
        low = text.lower()
        wanted = sorted({low} if len(low) <= LONGEST else {low[i:i + LONGEST] for i in range(len(low) - LONGEST + 1)})
        buckets = sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % self.buckets for g in wanted})
        rows = table.filter(F.col(BUCKET).isin(buckets) & F.col(GRAM).isin(wanted) & F.lit(bool(text)))
        if len(low) > LONGEST:
            rows = (rows.groupBy(VALUE).agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") == len(wanted))
                        .filter(F.contains(F.lower(F.col(VALUE).cast("string")), F.lit(low))))
        hits = rows.select(F.col(VALUE).alias(self.column)).orderBy(quoted(self.column))
        return hits if n is None else hits.limit(n)
