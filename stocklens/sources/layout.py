"""Tables stored by item, so that views need no shuffle by item."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..names import ITEM_KEY


def store_by_item(df: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as a table in ``buckets`` of the item key's hash, in sorted files, and read it back.

    Adaptive execution deals the rows to as many writers as their size needs, so what a
    writer sorts does not grow with the bucket; a large bucket has several files.

    Aggregates, windows and joins by item then run where the rows lie; pass
    ``colocated=True`` to the views and the duplicate flag.  Two tables join without a
    shuffle if they have the same number of buckets.  All rows of an item share a bucket,
    and a bucket is one task: this suits the snapshot, in which an item has a row for each
    store and flags, and not tables with a hot item.  Rows with a NULL item share one, too.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A multiple of the buckets: a partition then lies in one bucket, so writers make few files.
    (df.hint("rebalance", -(-partitions // buckets) * buckets, ITEM_KEY).write.mode(mode).bucketBy(buckets, ITEM_KEY).sortBy(ITEM_KEY)
       .format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)
