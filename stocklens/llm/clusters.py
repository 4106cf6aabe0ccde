"""Exact k-means on integer vectors, with norm-of-sum bounds.

A vector keeps the distance to its centroid and to the nearest other one as they were when
last evaluated, with the round of that.  All earlier centroids are retained, so a stored
bound is loosened by the norm of a centroid's total displacement since then; summed drifts
of the single rounds would be longer.  A vector whose loosened bounds still part its
centroid from all others stays; the rest are scanned against all centroids.

Vectors stay in their partitions.  A round writes them with their bounds to the shared
folder and aggregates only those that moved, so what is shuffled is one row of sums for
each centroid and task; the driver sees centroids alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
LARGEST = 2 ** 27            # of a component; squared distances of 64 components then fit 63 bits
EXACT_SUM = 2 ** 50          # products summed below this are exact in floating point
SLACK = 1e-9                 # share of the bounds that rounding may cost, many times over
STATE = "cluster int, previous int, upper double, upper_round int, lower double, lower_round int"


# --- inside tasks -----------------------------------------------------------------

def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each vector and a column for each centroid."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if int(most) ** 2 * x.shape[1] <= EXACT_SUM:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


class Bounds:
    """The assignment of one round, from the centroids of this and of all earlier rounds."""

    def __init__(self, history: np.ndarray):
        self.round, self.centroids = len(history) - 1, history[-1]
        self.moved = np.sqrt(((history - self.centroids).astype(np.float64) ** 2).sum(2))
        # The largest displacement of any centroid but the vector's own, for each round of evaluation.
        others = np.repeat(self.moved[:, None, :], len(self.centroids), axis=1)
        others[:, np.arange(len(self.centroids)), np.arange(len(self.centroids))] = 0
        self.others_moved = others.max(axis=2)

    def assign(self, x, cluster, upper, upper_round, lower, lower_round) -> int:
        """Bring the state of the vectors ``x`` up to this round in place; the number of full scans."""
        new = cluster < 0
        at = np.where(new, 0, cluster)
        drop = self.others_moved[np.where(new, 0, lower_round), at]
        near, far = upper + self.moved[np.where(new, 0, upper_round), at], lower - drop
        unsure = new | ~(near + SLACK * (near + lower + drop) < far)
        again = np.flatnonzero(unsure & ~new)
        upper[again] = np.sqrt(own_distances(x[again], self.centroids, cluster[again]))
        upper_round[again] = self.round
        far, edge = far[again], SLACK * (upper[again] + lower[again] + drop[again])
        unsure[again] = ~(upper[again] + edge < far)
        scan = np.flatnonzero(unsure)
        if len(scan):
            distances = squared_distances(x[scan], self.centroids)
            cluster[scan] = distances.argmin(axis=1)           # the first of equal ones
            upper[scan] = np.sqrt(distances[np.arange(len(scan)), cluster[scan]])
            distances[np.arange(len(scan)), cluster[scan]] = np.iinfo(np.int64).max
            second = distances.min(axis=1)
            lower[scan] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second))
            upper_round[scan] = lower_round[scan] = self.round
        return len(scan)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(np.int64)


def round_of(history: np.ndarray, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over Arrow batches of vectors with their state; the last gives distances instead."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            old = {name: batch.column(name).to_numpy(zero_copy_only=False).copy() for name in (
                "cluster", "upper", "upper_round", "lower", "lower_round")}
            previous = old["cluster"].copy()
            bounds.assign(x, **old)
            if last:
                out = {"vec_id": batch.column("vec_id"), "cluster": old["cluster"],
                       "distance": own_distances(x, bounds.centroids, old["cluster"])}
            else:
                out = {"vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "cluster": old["cluster"],
                       "previous": previous, **{k: old[k] for k in ("upper", "upper_round", "lower", "lower_round")}}
            yield pa.RecordBatch.from_pydict(out)
    return run


# --- rounds (Spark) ---------------------------------------------------------------

def integer_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows of ``df`` (vec_id, embedding) that have ``dimensions`` finite components.

    A component x becomes the integer floor(scale * x).  Rows whose embedding is null, of
    another length or has a null, infinite or not-a-number component are left out, and so
    are those with a component beyond ``LARGEST``, as their distances fit no long.
    """
    def scaled(x: Column) -> Column:
        return x.cast("double") * scale

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(scaled(x)) & (F.abs(scaled(x)) <= LARGEST)

    whole = (F.size("embedding") == dimensions) & F.forall("embedding", usable)
    return df.filter(F.coalesce(whole, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(scaled(x)).cast("int")).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = "2:") -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of salt and id, in that order; of equal ids the smaller vector goes first."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([r["vector"] for r in found], dtype=np.int64)


def _changes(state: DataFrame, dimensions: int):
    """Count and component sums that each centroid gains, from the vectors that moved."""
    moved = state.filter("cluster <> previous").select("vector", F.explode(F.array(
        F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("previous").alias("at"), F.lit(-1).alias("sign")))).alias("to")).filter("to.at >= 0")
    sums = [F.sum((F.get("vector", F.lit(i)) * F.col("to.sign")).cast("long")).alias(f"s{i}") for i in range(dimensions)]
    return moved.groupBy("to.at").agg(F.sum("to.sign").alias("n"), *sums).collect()


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            scale: int = SCALE, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector of ``integer_vectors(df)``, and the final centroids.

    ``rounds`` times all vectors go to the nearest centroid (the smaller number of equal
    ones) and every centroid with vectors moves to floor(sum / count) of them; then they
    are assigned once more.  ``distance`` is squared.  Fewer vectors than ``k`` give as
    many centroids; an empty table gives no rows.  Null and repeated ids keep their rows.
    Other columns of ``df`` are not carried.
    """
    vectors = integer_vectors(df, dimensions, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    start = vectors.selectExpr("vec_id", "vector", "-1 as cluster", "-1 as previous", "0.0d as upper", "0 as upper_round",
                               "0.0d as lower", "0 as lower_round")
    state = stored(start, "cluster-vectors")
    now = first_centroids(state, k, salt)
    if not len(now):
        return state.selectExpr("vec_id", "cluster", "0L as distance"), now
    history, counts, sums = [now], [0] * len(now), [[0] * dimensions for _ in now]
    for _ in range(rounds):
        state = stored(state.mapInArrow(round_of(np.stack(history), False), f"vec_id {kind}, vector array<int>, {STATE}"),
                       "cluster-round")
        for row in _changes(state, dimensions):
            counts[row["at"]] += row["n"]
            sums[row["at"]] = [a + b for a, b in zip(sums[row["at"]], row[2:], strict=True)]
        now = np.array([[s // n for s in total] if n else old for total, n, old in zip(
            sums, counts, history[-1].tolist(), strict=True)], dtype=np.int64)
        history.append(now)
        if (now == history[-2]).all():           # nothing moves any more
            break
    placed = state.mapInArrow(round_of(np.stack(history), True), f"vec_id {kind}, cluster int, distance long")
    return stored(placed, "cluster-final"), now


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``placed`` with cluster_inertia, inertia (sums of the distances) and centroid_sha256.

    A sum that fits no long is null.  One row for each centroid passes through the driver.
    """
    spark = placed.sparkSession
    total = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["cluster"]: int(r["s"]) for r in total}
    whole = sum(found.values())
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    rows = [(i, *[s if s < 2 ** 63 else None for s in (found.get(i, 0), whole)], t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    table = table.withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return placed.join(F.broadcast(table), "cluster") if rows else placed.join(table, "cluster")
