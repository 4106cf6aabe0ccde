"""Shards of near-equal size from sampled splitters.

Keys are drawn with a chance that grows with the size of their row, so quantiles of the
sample cut the key order into ranges of about equal size.  The true size of every range is
then summed up; a range that holds too much is cut again by a sample of its own rows on
the whole key, which ends in a number of the row's own, so that even one key's rows can be
parted.  Whole ranges, in order, make the shards.

What the driver holds are the draws and the ranges, ``DRAWS`` for each range, and there are
``RANGES`` ranges for each shard or one for each ``RANGE_BYTES``, whichever is more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

SHARDS = 16
RANGES = 128                 # for each shard, at least
RANGE_BYTES = 2 ** 30        # of a range, at most on average
DRAWS = 16                   # for each range
OVERFULL = 2                 # times the mean size of a range

Key = tuple


def _sortable(values: Sequence) -> Key:
    """A key with null before all values."""
    return tuple((0, 0) if v is None else (1, v) for v in values)


def draws(rows: DataFrame, rate: float, seed: int) -> Column:
    """How often a row is drawn: its size times ``rate``, rounded up or down by a hash of row and seed."""
    unit = F.pmod(F.xxhash64(F.lit(seed), "k.row"), F.lit(2 ** 30)) / F.lit(float(2 ** 30))
    return F.floor(F.col("k.size") * F.lit(rate) + unit)


def splitters(sample: list[tuple[Key, int]], count: int) -> list[Key]:
    """``count`` - 1 quantiles of weighted keys, repeated ones once: the last keys of the ranges."""
    sample.sort()
    total = np.cumsum([n for _, n in sample])
    if not len(total):
        return []
    wanted = np.arange(1, count) * (total[-1] / count)
    return sorted({sample[i][0] for i in np.searchsorted(total, wanted, side="left")})


def range_of(bounds: list[Key], columns: Sequence[Column]) -> Column:
    """Number of the range of a key: of the bounds below it.  A bound that is shorter than a key covers all keys it begins."""
    padded = [_padded(b, len(columns)) for b in bounds]

    @F.arrow_udf("long")
    def find(*key: pa.Array) -> pa.Array:
        rows = zip(*[values.to_pylist() for values in key], strict=True)
        return pa.array([bisect_left(padded, _sortable(row)) for row in rows], pa.int64())

    return find(*columns)


def _padded(bound: Key, length: int) -> Key:
    return bound if len(bound) == length else (*bound, (2, 0))


def shard(docs: DataFrame, group: Sequence[str], order: Sequence[str] = (), size: str = "size", shards: int = SHARDS,
          ranges_per_shard: int = RANGES, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with a column ``placed``: struct(shard int, slot long, range long).

    ``group`` and ``order`` are columns of whole numbers, dates or texts.  Rows lie in the
    order of both; shards are stretches of it of near-equal sum of ``size``, and ``slot``
    counts a shard's rows from 0.  A boundary falls between two groups unless one group's
    rows are more than ``OVERFULL`` times a range; such a group is cut between two rows,
    so a hot group spreads over as many shards as it fills.

    Null keys go first, null sizes count as 0.  Rows of equal keys are told apart by the
    place where they were read; which of them comes first does not matter to the sums.  A
    single row is never cut, so few large rows give uneven shards and fewer rows than
    shards leave some empty.  An empty table gives no rows.  If ``docs`` has a column
    ``placed``, the new one gets underscores in front.  The rows are stored once.
    """
    names = [*group, *order]
    x, out = fresh(docs, "k"), fresh(docs, "placed")
    parts = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    keyed = docs.withColumn(x, F.struct(
        *parts, F.monotonically_increasing_id().alias("row"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size")))
    keyed = stored(keyed, "shard-keys")
    fields = [f"c{i}" for i in range(len(names))] + ["row"]
    rows = keyed.select(F.col(x).alias("k"))
    total, n_rows = rows.agg(F.sum("k.size"), F.count(F.lit(1))).first()
    total = total or 0
    wanted = max(shards * ranges_per_shard, -(-total // RANGE_BYTES))
    full = OVERFULL * max(total / wanted, 1)

    def sampled(of: DataFrame, columns: list[str], salt: int) -> list[tuple[Key, int]]:
        times = draws(of, DRAWS * wanted / max(total, 1), salt)
        drawn = of.select(*[f"k.{c}" for c in columns], *(["range"] if "range" in of.columns else []), times.alias("times"))
        return drawn.filter("times > 0").collect()

    lead = fields[:len(group)]
    bounds = splitters([(_sortable(r[:-1]), r[-1]) for r in sampled(rows, lead, seed)], wanted)
    while True:
        ranged = rows.withColumn("range", range_of(bounds, [F.col(f"k.{c}") for c in fields]))
        sums = ranged.groupBy("range").agg(F.sum("k.size").alias("size"), F.max("k.size").alias("largest"),
                                           F.count(F.lit(1)).alias("rows")).orderBy("range").collect()
        over = {r["range"]: -(-r["size"] * wanted // max(total, 1)) for r in sums if r["size"] - r["largest"] > full}
        if not over:
            break
        seed += 1
        within: dict[int, list] = {}
        for r in sampled(ranged.filter(F.col("range").isin(list(over))), fields, seed):
            within.setdefault(r["range"], []).append((_sortable(r[:len(fields)]), r["times"]))
        fresh_bounds = {b for at, found in within.items() for b in splitters(found, int(over[at]) + 1)}
        bounds = sorted({*bounds, *fresh_bounds}, key=lambda b: _padded(b, len(fields)))

    shard_of, offset, before, taken = {}, {}, 0, {}
    for r in sums:
        at = min(shards - 1, int((2 * before + r["size"]) * shards // max(2 * total, 1)))
        shard_of[r["range"]], offset[r["range"]] = at, taken.get(at, 0)
        taken[at] = taken.get(at, 0) + r["rows"]
        before += r["size"]
    known = sorted(shard_of)
    table = docs.sparkSession.createDataFrame(
        [(i, shard_of[i], offset[i]) for i in known], "range long, shard int, offset long")
    place = fresh(docs, "range")
    ranged = keyed.withColumn(place, range_of(bounds, [F.col(f"{x}.{c}") for c in fields]))
    order_in = Window.partitionBy(place).orderBy(*[F.col(f"{x}.{c}").asc_nulls_first() for c in fields])
    ranged = ranged.withColumn(out, F.row_number().over(order_in) - 1)
    table = table.select(F.col("range").alias("_r"), "shard", F.col("offset").alias("_o"))
    joined = ranged.alias("a").join(table.alias("t"), F.col(f"a.{place}") == F.col("t._r"))
    placed = F.struct(F.col("t.shard").alias("shard"), (F.col("t._o") + F.col(f"a.{out}")).alias("slot"), F.col(f"a.{place}").alias("range"))
    return joined.select(*[F.col(f"a.`{c}`") for c in docs.columns], placed.alias(out))


def write_shards(placed: DataFrame, path: str, column: str = "placed", fmt: str = "parquet") -> None:
    """Write ``shard``'s rows, a folder for each shard with files of consecutive slots, each sorted.

    Rows are dealt by ranges of (shard, slot), so a large shard is written by many tasks.
    """
    flat = placed.select("*", f"{column}.shard", f"{column}.slot").drop(column)
    (flat.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
         .write.partitionBy("shard").format(fmt).save(path))
