"""The filtered stock view and the discount audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import year_column
from ..functions.items import normalise_promo
from ..functions.text import backticked
from ..names import CATALOG_DISCOUNT, DISCOUNT, VIEW_ALL, VIEW_BRANCHES, VIEW_HOUSE
from ..operators import filters as f
from ..operators.groups import duplicate_flag
from ..operators.joins import with_catalog
from ..operators.pivots import PIVOTS
from ..sources.sinks import discount_report


@dataclass(frozen=True)
class ViewFilters:
    """Filter choices of a view; every default means "no filter"."""

    region: str | None = None
    brand: str | None = None
    reference: str | None = None
    exclude_brands: Sequence[str] = ()
    exclude_sublines: Sequence[str] = ()
    promo_only: bool = False
    stock_range: tuple[float, float] | None = None
    flag_duplicates: bool = False
    dup_mode: str | None = None
    only_match: bool = False
    only_mismatch: bool = False
    exclude_year: int | str | None = None
    date_col: str | None = "Fecha"
    date_formats: Sequence[str] = f.DATE_FORMATS
    colocated: bool = False      # the snapshot is stored by item, see sources.layout

    @property
    def catalog_mode(self) -> str | None:
        """Both or neither catalog choice means no filter."""
        if self.only_match == self.only_mismatch:
            return None
        return "match" if self.only_match else "mismatch"


def prepare_rows(snapshot: DataFrame, view: str, flt: ViewFilters) -> DataFrame:
    """Steps that must precede the pivot."""
    rows = f.scope(snapshot, view)
    if view == VIEW_BRANCHES:
        rows = f.by_region(rows, flt.region)
    # A year column comes before any date column.
    dated = flt.date_col in rows.columns and year_column(rows.columns) is None
    rows = f.exclude_year(rows, flt.exclude_year, flt.date_col if dated else None, flt.date_formats)
    return f.clear_promo_without_stock(rows)


def refine_view(pivot: DataFrame, catalog: DataFrame | None, flt: ViewFilters) -> DataFrame:
    """Steps that follow the pivot, in their fixed order."""
    rows = f.by_brand(pivot, flt.brand)
    rows = f.by_reference(rows, flt.reference)
    rows = f.exclude_brands(rows, flt.exclude_brands)
    rows = f.exclude_sublines(rows, flt.exclude_sublines)
    if flt.promo_only:
        rows = f.promo_only(rows)
    if flt.stock_range is not None:
        rows = f.stock_range(rows, *flt.stock_range)
    rows = with_catalog(rows, catalog)
    rows = rows.select(*view_order(rows.columns))
    rows = f.catalog_match(rows, flt.catalog_mode)
    rows = normalise_promo(rows)
    rows = duplicate_flag(rows, flt.flag_duplicates, flt.colocated)
    return f.dup_mode(rows, flt.dup_mode)


def view_order(names: Sequence[str]) -> list[str]:
    """Names quoted for ``select``, the catalog discount right after the discount."""
    rest = [n for n in names if n != CATALOG_DISCOUNT]
    if CATALOG_DISCOUNT in names:
        at = rest.index(DISCOUNT) + 1 if DISCOUNT in rest else len(rest)
        rest.insert(at, CATALOG_DISCOUNT)
    return [backticked(n) for n in rest]


def stock_view(snapshot: DataFrame, view: str = VIEW_ALL, catalog: DataFrame | None = None,
               columns: Sequence[str] | None = None, **filters) -> DataFrame:
    """A pivot view with any set of filters; see :class:`ViewFilters`."""
    flt = ViewFilters(**filters)
    pivot = PIVOTS[view](prepare_rows(snapshot, view, flt), columns, colocated=flt.colocated)
    return refine_view(pivot, catalog, flt)


def discount_audit(snapshot: DataFrame, catalog: DataFrame,
                   columns: Sequence[str] | None = None, **filters) -> DataFrame:
    """Items of the main house whose discount differs from the catalog."""
    view = stock_view(snapshot, VIEW_HOUSE, catalog, columns, only_mismatch=True, **filters)
    return discount_report(view)
