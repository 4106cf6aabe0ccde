"""Mixing sources to target weights.

Every source gets a word budget by weight.  Its documents are put into a
hash-random order, prefix sums of their sizes are taken over that order, and the
order is cut where the budget is spent; a budget above the source's size takes
whole epochs first.

Hash-random keys make the order splittable: the key's leading part is a bucket, so
the prefix sum is a sum over the source's earlier buckets (few rows) plus a running
sum inside one bucket.  No task holds a source.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
KEY_BITS = 60


def random_key(*ids: Column, seed: int = 0) -> Column:
    """A 60-bit hash-random number of the given columns; null counts as empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Budget per source from rows of (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of
    all sizes.  A target stops at ``max_epochs`` times its source's size and the
    excess goes to the others by weight until none is above: in order of cap per
    weight, a source is capped while what is left per weight reaches its cap.
    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = totals.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    before = (Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
                    .rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.select(
        "*", F.sum(F.col("source_size").cast("double")).over(whole).alias("all_words"),
        F.sum("weight").over(whole).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    capped = ranked.withColumn(
        "capped", (F.col("all_words") - F.col("cap_before")) * F.col("weight")
        >= F.col("cap") * (F.col("all_weight") - F.col("weight_before")))
    left_words = F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole)
    left_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(whole)
    return capped.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(
            F.col("weight") * left_words / F.when(left_weight > 0, left_weight)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0,
        cut: str = "words") -> DataFrame:
    """The rows of ``docs`` (doc_id, text or size, source, ...) with a column ``mix``:
    struct(size, source_size, target, taken, copies).

    ``taken`` is the number of words the mix takes of the row, repeats counted.
    ``cut="words"`` spends each budget to the word (rounded down), so the row at the
    cut gives part of its words; ``cut="documents"`` takes that row whole when at least
    half of it fits.  ``copies`` is the number of whole copies.

    An integer column ``size`` counts as the size when there is no ``text``.  Null and
    empty texts have size 0 and take 0.  Null sources are one source, the last.  Rows
    with equal doc_id and size are interchangeable; null doc_ids share one key.  An
    empty table gives no rows.  If ``docs`` has a column ``mix``, the new one gets
    underscores in front.
    """
    if cut not in ("words", "documents"):
        raise ValueError(f"cut must be 'words' or 'documents', not {cut!r}")
    size = word_count(F.col("text")) if "text" in docs.columns else F.coalesce("size", F.lit(0)).cast("long")
    key = random_key(F.col("doc_id"), seed=seed)
    narrow = stored(docs.select("source", size.alias("size"), key.alias("key")), "mix-sizes")
    buckets = max(1, isqrt(narrow.count()))   # as many buckets as rows in one, so both stay small

    def bucket(of: Column) -> Column:
        return F.shiftright(F.shiftright(of, KEY_BITS - 30) * F.lit(buckets).cast("long"), 30)

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("source", bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("size"))
    offsets = (sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
                   .alias("o").join(source_targets(narrow, weights, max_epochs).alias("t"),
                                    F.col("o.source").eqNullSafe(F.col("t.source")))
                   .select(F.struct("o.source", "o.bucket", "o.offset", "t.source_size", "t.target").alias("b")))

    x = fresh(docs, "x")
    rows = docs.withColumn(x, F.struct(size.alias("size"), key.alias("key"), bucket(key).alias("bucket")))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("b.source"))
                     & (F.col(f"{x}.bucket") == F.col("b.bucket")))
    inside = (Window.partitionBy("source", f"{x}.bucket")
                    .orderBy(f"{x}.key", F.col("doc_id"), f"{x}.size")
                    .rowsBetween(Window.unboundedPreceding, -1))
    before = fresh(docs, "before")
    rows = rows.withColumn(before, F.col("b.offset") + F.coalesce(F.sum(f"{x}.size").over(inside), F.lit(0)))
    n, whole = F.col(f"{x}.size"), F.col("b.source_size")
    budget = F.floor("b.target")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(0)
    rest = budget - epochs * whole - F.col(before)
    if cut == "words":
        part = F.greatest(F.lit(0), F.least(n, rest))
    else:
        part = F.when(rest * 2 >= n, F.when(rest > 0, n).otherwise(0)).otherwise(0)
    taken = (epochs * n + part).cast("long")
    copies = F.when(n > 0, F.floor(taken / n)).otherwise(0).cast("int")
    out = F.struct(n.alias("size"), whole.alias("source_size"), F.col("b.target").alias("target"),
                   taken.alias("taken"), copies.alias("copies"))
    return rows.select(*docs.columns, out.alias(fresh(docs, "mix")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, one row per copy, whole documents only.

    Rows without words have no copies and are not in the mix.
    """
    mixed = mix(docs, cut="documents", **options)
    column = fresh(docs, "mix")
    copy = fresh(docs, "copy")
    return (mixed.filter(F.col(f"{column}.copies") > 0)
                 .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{column}.copies"))))
                 .select(*docs.columns))
