"""A snapshot and its views kept as files by key range and refreshed where they changed.

The hash of the item key deals rows to ranges.  A refresh writes the newly loaded snapshot
by range, takes an order-free digest of each range from these files and compares it with the
kept one; ranges that are equal stay in their old files and the new ones are deleted, and only
the changed part of each view is worked out again, from its rows alone.  A view row depends
on the rows of its own item, so this equals a full reload; sums that add and subtract changes
would gather rounding errors over refreshes.

Files are never changed: a refresh writes new folders and then one small log table that
names the folder of every range, so a reader sees the old state or the new one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..names import ITEM_KEY, VIEW_ALL, VIEWS
from ..operators.pivots import pivot_views, stock_and_attributes
from ..plans.view import ViewFilters, prepare_rows, refine_view
from .tables import strip_columns
from .workbooks import exists, located

RANGE, VERSION = "_range", "_version"


class RangedTable:
    """Rows kept by ranges of a key's hash, each range in the folder of the version that wrote it."""

    def __init__(self, spark: SparkSession, path: str, key: str, ranges: int):
        self.spark, self.path, self.key, self.ranges = spark, path.rstrip("/"), key, ranges
        self.schema: StructType | None = None
        self.places: dict[int, tuple[int, int, str]] = {}
        self.version = 0
        self._load_log()

    def range_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.ranges)).cast("int")

    def _load_log(self) -> None:
        """The latest complete state: a row per range, or none."""
        try:
            log = self.spark.read.parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return
        last = log.agg(F.max(VERSION)).first()[0]
        rows = log.filter(F.col(VERSION) == last).collect()
        if {r["ranges"] for r in rows} - {self.ranges}:
            raise ValueError(f"{self.path} is kept in {rows[0]['ranges']} ranges, not {self.ranges}")
        self.version, self.schema = last, StructType.fromJson(json.loads(next(r["schema"] for r in rows if r["schema"])))
        self.places = {r["at"]: (r["written"], r["rows"], r["digest"]) for r in rows if r["at"] is not None}

    def digests(self, df: DataFrame) -> dict[int, tuple[int, str]]:
        """Rows and order-free digest of every range that has rows; what reaches the driver is bounded by the ranges."""
        # The halves of the hash are summed alone: a range of two billion rows still fits a long.
        bits = F.xxhash64(*[df[c] for c in df.columns], F.lit(1))
        halves = [F.sum(bits.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(bits, 32))]
        found = df.groupBy(self.range_of(df[self.key]).alias("at")).agg(
            F.count(F.lit(1)).alias("rows"), F.concat_ws("/", *[h.cast("string") for h in halves]).alias("digest")).collect()
        return {r["at"]: (r["rows"], r["digest"]) for r in found}

    def changed(self, digests: Mapping[int, tuple[int, str]]) -> list[int]:
        """Ranges whose digest is not the kept one."""
        kept = {at: p[1:] for at, p in self.places.items()}
        return sorted(at for at in {*kept, *digests} if kept.get(at) != digests.get(at))

    def replace(self, df: DataFrame, ranges: Sequence[int], digests: Mapping[int, tuple[int, str]] | None = None) -> None:
        """Put ``df`` in the place of all rows of ``ranges``; without ``digests`` none are kept.

        Adaptive execution packs small ranges together and splits large ones, so a hot
        key's range is written by several tasks.
        """
        number = self.version + 1
        self._write(df, number)
        if digests is None:
            counted = self._files(df.schema).filter(F.col(VERSION) == number).groupBy(RANGE).count().collect()
            digests = {r[RANGE]: (r["count"], "") for r in counted}
        self._commit(number, df.schema, ranges, digests)

    def renew(self, df: DataFrame) -> list[int]:
        """Put ``df`` in the place of all rows; the list of ranges that changed.

        ``df`` runs once: its rows are written by range and the digests taken from the files.
        A range with the kept digest stays where it is, and its new files are deleted again.
        """
        number, known = self.version + 1, self.schema is not None
        self._write(df, number)
        written = self._files(df.schema).filter(F.col(VERSION) == number).drop(VERSION, RANGE)
        digests = self.digests(written)
        changed = self.changed(digests) if known else sorted(digests)
        if changed or not known:
            self._commit(number, df.schema, changed, digests)
        self._discard(number, {*digests} - {*changed})
        return changed

    def _write(self, df: DataFrame, number: int) -> None:
        rows = df.withColumn(RANGE, self.range_of(df[self.key]))
        (rows.hint("rebalance", RANGE).write.mode("overwrite").partitionBy(RANGE)
             .parquet(f"{self.path}/data/{VERSION}={number}"))

    def _commit(self, number: int, schema: StructType, ranges: Iterable[int], digests: Mapping[int, tuple[int, str]]) -> None:
        self.schema = schema
        places = {at: p for at, p in self.places.items() if at not in set(ranges)}
        places |= {at: (number, *digests[at]) for at in ranges if at in digests}
        self._write_log(number, places)
        self.version, self.places = number, places

    def _discard(self, number: int, ranges: Iterable[int]) -> None:
        """Delete files that no log names; where the file system is not known here they wait for the next write or ``vacuum``."""
        try:
            files, root = located(f"{self.path}/data")
            for at in ranges:
                folder = f"{root}/{VERSION}={number}/{RANGE}={at}"
                if exists(files, folder):
                    files.delete_dir(folder)
        except (OSError, ValueError):
            return

    def _write_log(self, number: int, places: Mapping[int, tuple[int, int, str]]) -> None:
        schema = self.schema.json()
        rows = [(at, *p, self.ranges, schema if i == 0 else None) for i, (at, p) in enumerate(sorted(places.items()))]
        log = self.spark.createDataFrame(rows or [(None, None, None, None, self.ranges, schema)],
                                         "at int, written int, rows long, digest string, ranges int, schema string")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/{VERSION}={number}")

    def _files(self, schema: StructType | None = None) -> DataFrame:
        fields = StructType([*(schema or self.schema).fields]).add(VERSION, IntegerType()).add(RANGE, IntegerType())
        return self.spark.read.schema(fields).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    def read(self, ranges: Iterable[int] | None = None) -> DataFrame:
        """The current rows, of some ranges or all; only their folders are listed in the scan."""
        if self.schema is None:
            raise ValueError(f"nothing is kept in {self.path}")
        wanted = set(self.places) if ranges is None else set(ranges) & set(self.places)
        by_version: dict[int, list[int]] = {}
        for at in sorted(wanted):
            by_version.setdefault(self.places[at][0], []).append(at)
        if not by_version:
            return self.spark.createDataFrame([], self.schema)
        here = [(F.col(VERSION) == v) & F.col(RANGE).isin(at) for v, at in sorted(by_version.items())]
        return self._files().filter(reduce(Column.__or__, here)).drop(VERSION, RANGE)

    def vacuum(self) -> None:
        """Delete the folders that no range of the current state uses; older readers must be done."""
        files, root = located(f"{self.path}/data")
        used = {(p[0], at) for at, p in self.places.items()}
        for number in range(1, self.version + 1):
            for at in range(self.ranges):
                folder = f"{root}/{VERSION}={number}/{RANGE}={at}"
                if (number, at) not in used and exists(files, folder):
                    files.delete_dir(folder)


class KeptSnapshot:
    """A snapshot with pivot views on files, refreshed by what changed.

    ``views`` maps a name to (view, pivot columns); the columns are fixed, as they are part
    of a view's schema.  A new object on the same path goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], DataFrame],
                 views: Mapping[str, tuple[str, Sequence[str]]], ranges: int = 256):
        for name, (view, columns) in views.items():
            if view not in VIEWS or columns is None:
                raise ValueError(f"view {name!r} needs a view name and its pivot columns")
        self._load, self._views, self._parts, self.refreshed = load, dict(views), f"{path}/parts", []
        self.rows = RangedTable(spark, f"{path}/rows", ITEM_KEY, ranges)
        self.kept = {name: RangedTable(spark, f"{path}/view-{i}", ITEM_KEY, ranges) for i, name in enumerate(sorted(views))}

    def refresh(self) -> list[int]:
        """Load again and replace the changed ranges of the snapshot and of every view; the list of them.

        The load runs once, see ``RangedTable.renew``.  A refresh that stopped half way is made
        good by the next: a view that is behind its rows is told by its own version.
        """
        changed = self.rows.renew(strip_columns(self._load()))
        self._follow()
        self.refreshed = changed
        return changed

    def _follow(self) -> None:
        """Bring the views up to the rows: their ranges whose rows were written after the view's last version.

        What the views need of these rows is worked out in one scan and written in between.
        """
        late: dict[tuple[int, ...], list[str]] = {}
        for name, table in self.kept.items():
            if table.schema is None or table.version < self.rows.version:
                behind = sorted({at for at, p in self.rows.places.items() if p[0] > table.version}
                                | {at for at in table.places if at not in self.rows.places})
                late.setdefault(tuple(behind), []).append(name)
        for behind, names in late.items():
            parts = stock_and_attributes(prepare_rows(self.rows.read(behind), VIEW_ALL, ViewFilters()))
            parts.write.mode("overwrite").parquet(self._parts)
            kept = self.rows.spark.read.schema(parts.schema).parquet(self._parts)
            for name in names:
                view, columns = self._views[name]
                table = self.kept[name]
                table.version = self.rows.version - 1         # a view has the version of its rows
                table.replace(pivot_views(kept, {view: columns})[view], behind)

    def snapshot(self) -> DataFrame:
        return self.rows.read()

    def pivot(self, name: str) -> DataFrame:
        return self.kept[name].read()

    def view(self, name: str, catalog: DataFrame | None = None, **filters) -> DataFrame:
        """A filtered view on the kept pivot; choices that precede the pivot are refused."""
        flt = ViewFilters(**filters)
        if flt.region or flt.exclude_year is not None:
            raise ValueError("region and year filters precede the pivot: use plans.view.stock_view")
        return refine_view(self.pivot(name), catalog, flt)

    def vacuum(self) -> None:
        for table in (self.rows, *self.kept.values()):
            table.vacuum()
