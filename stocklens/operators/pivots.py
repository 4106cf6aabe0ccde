"""Pivots of stores or regions into columns.

Each view joins attribute rows with one wide row of sums per item.  The two
sides read different columns, and both shrink to item level before they are
shuffled.  The column list is part of the schema: pass it, or resolve it from the
store dimension, to avoid a pass over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require
from ..functions.items import percent_sign, region_bucket, rounded_half_even, rounded_scaled, share, store_label
from ..functions.text import backticked, quoted, text_literal
from ..names import (
    BRANCH_SHARE, BRANCH_TOTAL, BRANCH_WORD, FIXED_ATTRIBUTES, HOUSE_SHARE, HOUSE_TOTAL,
    HOUSE_WORD, ITEM_KEY, REGION, STOCK, STORE, VIEW_ALL, VIEW_BRANCHES, VIEW_HOUSE,
)
from ..rules import StockRules
from .aggregates import item_attributes
from .filters import drop_empty_rows, positive_total, scope
from .joins import attributes_with_totals

WIDTH = 64       # sums of one aggregate


def distinct_labels(df: DataFrame, label: Column) -> list[str]:
    """Labels present in the data, sorted; bounded like Spark's own pivot."""
    bound = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = (df.select(label.alias("_label")).filter("_label is not null")
               .distinct().limit(bound + 1).collect())
    if len(found) > bound:
        raise ValueError(f"more than {bound} pivot columns")
    return sorted(r["_label"] for r in found)


def store_columns(stores: DataFrame, rules: StockRules, view: str) -> list[str]:
    """Pivot columns of a view from the store dimension (one row per store)."""
    region, store = region_bucket(F.col("store_id"), rules), F.col("nombre_tienda")
    if view == VIEW_HOUSE:
        return distinct_labels(stores, F.when(region.contains(HOUSE_WORD), region))
    if view == VIEW_BRANCHES:
        return distinct_labels(stores, F.when(region.contains(BRANCH_WORD), store))
    return _house_then_branch(distinct_labels(stores, store_label(region, store)))


def _house_then_branch(labels) -> list[str]:
    house = sorted(x for x in labels if HOUSE_WORD in x)
    return house + sorted(x for x in labels if BRANCH_WORD in x and x not in house)


def item_sums(df: DataFrame, label: Column, labels: Sequence[str],
              totals: Mapping[str, Column]) -> DataFrame:
    """One row per item: a stock sum per label (0 where absent) and named totals.

    ``totals`` maps a name to the condition, over ``_label``, of the rows it sums.
    Sums are combined on the map side and shuffled once, by item.  Every row meets every
    sum of its aggregate, so columns are cut into groups of ``WIDTH``, joined by item.
    """
    clash = {ITEM_KEY, *totals} & set(labels)
    if clash:
        raise ValueError(f"pivot columns clash with other columns: {sorted(clash)}")
    rows = (df.filter(F.col(ITEM_KEY).isNotNull())
              .select(ITEM_KEY, STOCK, label.alias("_label"))
              .filter("_label is not null"))
    sums = [F.sum(F.when(cond, F.col(STOCK))).alias(n) for n, cond in totals.items()]
    # SQL text: one call per column when the plan is built
    sums += [F.expr(f"sum(case when _label = {text_literal(v)} then {STOCK} end) as {backticked(v)}")
             for v in labels]
    groups = [rows.groupBy(ITEM_KEY).agg(*sums[at:at + WIDTH]) for at in range(0, len(sums), WIDTH)]
    return reduce(lambda a, b: a.join(b, ITEM_KEY), groups).na.fill(0)


def _needed(df: DataFrame, *extra: str) -> None:
    require(df, (*FIXED_ATTRIBUTES, REGION, STOCK, *extra))


def pivot_all_stores(df: DataFrame, columns: Sequence[str] | None = None, colocated: bool = False) -> DataFrame:
    """One row per item: each store of the main house and the branches, both
    totals and their shares; items without stock on either side drop out."""
    _needed(df, STORE)
    return _all_stores(df, df, columns)


def _all_stores(df: DataFrame, described: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The view from rows of stock and rows of attributes, which can be the same."""
    label = store_label(F.col(REGION), F.col(STORE))
    columns = _house_then_branch(distinct_labels(df, label) if columns is None else columns)
    sums = item_sums(df, label, columns, {
        BRANCH_TOTAL: F.col("_label").contains(BRANCH_WORD),
        HOUSE_TOTAL: F.col("_label").contains(HOUSE_WORD)})
    sums = drop_empty_rows(sums, HOUSE_TOTAL, BRANCH_TOTAL)
    house, branch = F.col(HOUSE_TOTAL), F.col(BRANCH_TOTAL)
    return (item_attributes(described, one_per_item=True).join(sums, ITEM_KEY)
            .select(*FIXED_ATTRIBUTES, *[backticked(c) for c in columns], BRANCH_TOTAL, HOUSE_TOTAL,
                    percent_sign(share(house, house + branch)).alias(HOUSE_SHARE),
                    percent_sign(share(branch, house + branch)).alias(BRANCH_SHARE)))


def _scoped_pivot(rows: DataFrame, described: DataFrame, label: str, total: str, columns: Sequence[str] | None,
                  one_per_item: bool, colocated: bool = False) -> DataFrame:
    """A view from rows of stock and rows of attributes of one scope, which can be the same."""
    columns = distinct_labels(rows, quoted(label)) if columns is None else sorted(columns)
    sums = item_sums(rows, quoted(label), columns, {total: F.lit(True)})
    joined = attributes_with_totals(item_attributes(described, one_per_item), sums, colocated)
    return joined.select(*FIXED_ATTRIBUTES, *[backticked(c) for c in columns], total)


def pivot_branches(df: DataFrame, columns: Sequence[str] | None = None,
                   one_per_item: bool = False, colocated: bool = False) -> DataFrame:
    """Branch stores as columns; attribute rows of an item repeat its sums.

    ``colocated``: the rows are stored by item, see ``sources.layout``.
    """
    _needed(df, STORE)
    rows = scope(df, VIEW_BRANCHES)
    return positive_total(_scoped_pivot(rows, rows, STORE, BRANCH_TOTAL, columns, one_per_item, colocated), BRANCH_TOTAL)


def pivot_main_house(df: DataFrame, columns: Sequence[str] | None = None,
                     one_per_item: bool = False, colocated: bool = False) -> DataFrame:
    """Main-house regions as columns; attribute rows of an item repeat its sums.

    ``colocated``: the rows are stored by item, see ``sources.layout``.
    """
    _needed(df)
    rows = scope(df, VIEW_HOUSE)
    return positive_total(_scoped_pivot(rows, rows, REGION, HOUSE_TOTAL, columns, one_per_item, colocated), HOUSE_TOTAL)


def pivot_main_house_share(df: DataFrame, total: float | None = None,
                           columns: Sequence[str] | None = None,
                           one_per_item: bool = False, colocated: bool = False) -> DataFrame:
    """Main-house view with every row's share of the global (or a given) total."""
    _needed(df)
    rows = scope(df, VIEW_HOUSE)
    view = _scoped_pivot(rows, rows, REGION, HOUSE_TOTAL, columns, one_per_item, colocated)
    return _with_share(view, HOUSE_TOTAL, _house_total(df, one_per_item) if total is None else total)


def _house_total(df: DataFrame, one_per_item: bool) -> Column:
    """Sum over the rows of the main-house view, worked out at item level: an item's
    total counts once for each of its attribute rows."""
    rows = scope(df, VIEW_HOUSE).filter(F.col(ITEM_KEY).isNotNull())
    per_item = rows.groupBy(ITEM_KEY).agg(F.sum(STOCK).alias("_total"))
    if not one_per_item:
        repeats = rows.select(*FIXED_ATTRIBUTES).distinct().groupBy(ITEM_KEY).agg(F.count(F.lit(1)).alias("_rows"))
        per_item = per_item.join(repeats, ITEM_KEY).select((F.col("_total") * F.col("_rows")).alias("_total"))
    return per_item.agg(F.sum("_total")).scalar()


def global_share(df: DataFrame, col: str, total: float | None = None,
                 out: str = HOUSE_SHARE) -> DataFrame:
    """A column as percent text of its sum over all rows, or of a given total.

    The sum is a scalar subquery: partial sums per task, one number back.
    """
    return _with_share(df, col, df.agg(F.sum(quoted(col))).scalar() if total is None else total, out)


def _with_share(df: DataFrame, col: str, whole: Column | float, out: str = HOUSE_SHARE) -> DataFrame:
    """Shares of a computed sum round as arrays do, those of a given number correctly."""
    rounded = rounded_scaled if isinstance(whole, Column) else rounded_half_even
    whole = whole if isinstance(whole, Column) else F.lit(whole)
    part = rounded(quoted(col).cast("double") / F.nullif(whole, F.lit(0)) * 100)
    return df.withColumn(out, F.when(whole > 0, percent_sign(part)).otherwise("0%"))


def stock_and_attributes(df: DataFrame) -> DataFrame:
    """What all views need of the snapshot, by one grouping-sets aggregate over one scan.

    Rows with ``_set`` 0 hold the stock of an item, region and store; rows with ``_set`` 1 a
    distinct attribute row, and whether branch rows or main-house rows have it.  NULL items
    are left out, as every view does.
    """
    _needed(df, STORE)
    cells, attributes = [ITEM_KEY, REGION, STORE], list(FIXED_ATTRIBUTES)
    keys = [*attributes, REGION, STORE]
    made = (df.filter(F.col(ITEM_KEY).isNotNull()).groupingSets([cells, attributes], *keys)
              .agg(F.grouping(REGION).alias("_set"), F.sum(STOCK).alias(STOCK), *[
                  F.max(F.coalesce(F.col(REGION).contains(word), F.lit(False))).alias(flag)
                  for word, flag in ((BRANCH_WORD, "_branch"), (HOUSE_WORD, "_house"))]))
    return made


def pivot_views(parts: DataFrame, columns: Mapping[str, Sequence[str] | None]) -> dict[str, DataFrame]:
    """The pivot views, by name, that ``columns`` lists, from the rows of ``stock_and_attributes``.

    Keep ``parts`` in between (written, or persisted): it is far smaller than the snapshot
    and every view reads it twice.
    """
    cells, described = parts.filter("_set = 0").select(ITEM_KEY, REGION, STORE, STOCK), parts.filter("_set = 1")

    def view(name: str) -> DataFrame:
        if name == VIEW_ALL:
            return _all_stores(cells, described, columns[name])
        label, total, flag = (STORE, BRANCH_TOTAL, "_branch") if name == VIEW_BRANCHES else (REGION, HOUSE_TOTAL, "_house")
        return positive_total(_scoped_pivot(scope(cells, name), described.filter(flag), label, total, columns[name], False), total)

    return {name: view(name) for name in columns}


PIVOTS = {VIEW_ALL: pivot_all_stores, VIEW_BRANCHES: pivot_branches, VIEW_HOUSE: pivot_main_house}
