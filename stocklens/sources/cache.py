"""Keeping a loaded snapshot, and the views derived from it, for reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..names import VIEW_ALL
from ..operators.pivots import PIVOTS
from ..plans.view import ViewFilters, prepare_rows, refine_view
from .tables import strip_columns


class Snapshot:
    """A snapshot loaded once and shared by every view until it is refreshed.

    Blocks spill to executor disks; blocks lost with an executor are recomputed
    from the sources.  At most ``max_views`` views are kept, the oldest goes first, and a
    change of the excluded year drops them all.
    """

    def __init__(self, load: Callable[[], DataFrame], level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
                 max_views: int = 8):
        self._load = load
        self._level = level
        self._data: DataFrame | None = None
        self._views: dict[tuple, DataFrame] = {}
        self._year: str | None = None
        self._max_views = max_views

    def persist(self) -> DataFrame:
        """The snapshot, loaded and kept on first use."""
        if self._data is None:
            self._data = strip_columns(self._load()).persist(self._level)
        return self._data

    def pivot(self, view: str = VIEW_ALL, exclude_year=None,
              columns: Sequence[str] | None = None) -> DataFrame:
        """A pivot view, kept per view and column list while the excluded year stays."""
        year = None if exclude_year is None else str(exclude_year).strip()
        if year != self._year:
            self.clear_views()
            self._year = year
        key = (view, None if columns is None else tuple(columns))
        if key not in self._views:
            while len(self._views) >= self._max_views:
                self._views.pop(next(iter(self._views))).unpersist()
            rows = prepare_rows(self.persist(), view, ViewFilters(exclude_year=exclude_year))
            self._views[key] = PIVOTS[view](rows, columns).persist(self._level)
        return self._views[key]

    def view(self, view: str = VIEW_ALL, catalog: DataFrame | None = None,
             columns: Sequence[str] | None = None, **filters) -> DataFrame:
        """A filtered view on the kept pivot; see ``plans.view.ViewFilters``."""
        flt = ViewFilters(**filters)
        if flt.region:
            raise ValueError("a region filter precedes the pivot: use plans.view.stock_view")
        return refine_view(self.pivot(view, flt.exclude_year, columns), catalog, flt)

    def clear_views(self) -> None:
        for kept in self._views.values():
            kept.unpersist()
        self._views.clear()

    def refresh(self) -> DataFrame:
        """Load again; the old snapshot and every view made from it are dropped."""
        self.release()
        return self.persist()

    def release(self) -> None:
        self.clear_views()
        if self._data is not None:
            self._data.unpersist()
            self._data = None
