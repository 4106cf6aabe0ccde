"""Row filters over the snapshot and its views.

A filter whose column is absent, or whose argument is empty, returns its input
unchanged, so filters compose without checks by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    date_columns, house_total_column, require, stock_column, subline_column, year_column,
)
from ..functions.text import number_or_null, quoted, stripped
from ..names import (
    ALL_REGIONS, BRANCH_WORD, CATALOG_DISCOUNT, DISCOUNT, DUPLICATE_FLAG, HOUSE_WORD,
    PROMO, REGION, VIEW_ALL, VIEW_BRANCHES, VIEW_HOUSE,
)

DAY_FIRST = "dd/MM/yyyy"
# Spellings a date text may have, day first; the first that fits counts.
DATE_FORMATS = ("d/M/yyyy[ H:mm[:ss]]", "yyyy-M-d[ H:mm[:ss]]", "yyyy-M-d'T'H:mm[:ss]",
                "d-M-yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d/M/yy")
_DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


def nonnegative_stock(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("existencia") >= 0)


def scope(df: DataFrame, view: str) -> DataFrame:
    """Rows of one view; rows without a region belong only to the full view."""
    word = {VIEW_ALL: None, VIEW_BRANCHES: BRANCH_WORD, VIEW_HOUSE: HOUSE_WORD}[view]
    if word is None or REGION not in df.columns:
        return df
    return df.filter(F.col(REGION).contains(word))


def by_region(df: DataFrame, region: str | None) -> DataFrame:
    if not region or region == ALL_REGIONS or REGION not in df.columns:
        return df
    return df.filter(F.col(REGION) == region)


def by_brand(df: DataFrame, code) -> DataFrame:
    if code in (None, "") or "CodigoMarca" not in df.columns:
        return df
    return df.filter(F.col("CodigoMarca").cast("string") == str(code))


def clean_reference(reference) -> str:
    """Search text as compared: trimmed, lower case, placeholder word dropped."""
    text = "" if reference is None else str(reference).strip().lower()
    return "" if text == "referencia" else text


def by_reference(df: DataFrame, reference) -> DataFrame:
    wanted = clean_reference(reference)
    if not wanted or "Referencia" not in df.columns:
        return df
    return df.filter(F.lower(stripped(F.col("Referencia").cast("string"))) == wanted)


def _exclude(df: DataFrame, name: str, codes: Iterable[str] | None) -> DataFrame:
    wanted = sorted({c.strip().upper() for c in (codes or []) if c and c.strip()})
    if not wanted:
        return df
    return df.filter(~F.coalesce(F.upper(quoted(name).cast("string")).isin(wanted), F.lit(False)))


def exclude_brands(df: DataFrame, codes: Iterable[str] | None) -> DataFrame:
    """Drop brands of the list, ignoring case; rows without a brand stay."""
    if "CodigoMarca" not in df.columns:
        return df
    return _exclude(df, "CodigoMarca", codes)


def exclude_sublines(df: DataFrame, codes: Iterable[str] | None) -> DataFrame:
    name = subline_column(df.columns)
    return df if name is None else _exclude(df, name, codes)


def promo_only(df: DataFrame) -> DataFrame:
    """Rows whose promotion flag reads as the number 1."""
    if PROMO not in df.columns:
        return df
    if isinstance(df.schema[PROMO].dataType, T.BooleanType):
        return df.filter(F.col(PROMO))
    return df.filter(number_or_null(df, PROMO) == 1)


def _read_date(text: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _year_of(df: DataFrame, name: str, formats: Sequence[str]) -> Column:
    if isinstance(df.schema[name].dataType, _DATED):
        return F.year(quoted(name))
    return F.year(_read_date(stripped(quoted(name).cast("string")), formats))


def _probe_date_column(df: DataFrame, formats: Sequence[str]) -> str | None:
    """The first column named as a date that holds one, else the first other with dates in half of the rows.

    A named column is read up to its first date.  Reading a text that is no date costs a
    failure for each format, so the others are read only if no named column holds a date.
    """
    named = date_columns(df.columns)
    for c in named:
        if not df.filter(_year_of(df, c, formats).isNotNull()).isEmpty():
            return c
    others = [f.name for f in df.schema if isinstance(f.dataType, (*_DATED, T.StringType)) and f.name not in named]
    dates = _rows_with_dates(df, others, formats) if others else {}
    return next((c for c in others if c in dates and dates[c][1] / dates[c][0] >= 0.5), None)


def _rows_with_dates(df: DataFrame, names: Sequence[str], formats: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Rows, and rows with a date, by column, from one pass; each distinct text is read once."""
    def cell(i: int, name: str) -> Column:
        text = not isinstance(df.schema[name].dataType, _DATED)
        return F.struct(F.lit(i).alias("at"),
                        (stripped(quoted(name).cast("string")) if text else F.lit(None).cast("string")).alias("text"),
                        (F.lit(False) if text else quoted(name).isNotNull()).alias("dated"))

    values = (df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(names)])))
                .groupBy("at", "text", "dated").agg(F.count(F.lit(1)).alias("n")))
    hit = F.col("dated") | _read_date(F.col("text"), formats).isNotNull()
    found = values.groupBy("at").agg(F.sum("n").alias("rows"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("dates")).collect()
    return {names[r["at"]]: (r["rows"], r["dates"]) for r in found}


def exclude_year(df: DataFrame, year, date_col: str | None = None,
                 formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Drop the rows of one year; rows whose date has none of the spellings stay.

    Without ``date_col`` the column is found by name (a year column, then date
    columns) and content, which costs a pass up to the first date of a column so named; only
    if there is none, one aggregate over all texts.
    """
    try:
        wanted = int(str(year).strip())
    except (TypeError, ValueError):
        return df
    if date_col is None:
        by_year = year_column(df.columns)
        if by_year is not None:
            found = number_or_null(df, by_year)
            return df.filter(F.coalesce(found != wanted, F.lit(True)))
        date_col = _probe_date_column(df, formats)
        if date_col is None:
            return df
    return df.filter(F.coalesce(_year_of(df, date_col, formats) != wanted, F.lit(True)))


def stock_range(df: DataFrame, lo: float = 1, hi: float = 11) -> DataFrame:
    """Main-house stock between two bounds, both included."""
    name = house_total_column(df.columns)
    if name is None:
        if REGION in df.columns:
            df = df.filter(F.col(REGION).contains(HOUSE_WORD))
        name = stock_column(df.columns)
        if name is None:
            return df
    return df.filter(number_or_null(df, name).between(lo, hi))


def value_search(df: DataFrame, col: str, text: str, n: int | None = None) -> DataFrame:
    """Distinct values of a column containing a text, ignoring case, in order: all, or the first ``n``."""
    require(df, [col])
    if not text:
        return df.select(quoted(col)).filter(F.lit(False))
    hits = (df.select(quoted(col))
              .filter(F.contains(F.lower(quoted(col).cast("string")), F.lit(text.lower())))
              .distinct().orderBy(quoted(col)))
    return hits if n is None else hits.limit(n)


def catalog_match(df: DataFrame, mode: str | None) -> DataFrame:
    """``"match"`` / ``"mismatch"`` of own and catalog discount; NULL is a mismatch."""
    if mode is None or DISCOUNT not in df.columns or CATALOG_DISCOUNT not in df.columns:
        return df
    same = F.coalesce(
        F.col(DISCOUNT).cast("string") == F.col(CATALOG_DISCOUNT).cast("string"), F.lit(False))
    return df.filter(same if mode == "match" else ~same)


def dup_mode(df: DataFrame, mode: str | None) -> DataFrame:
    """Keep ``"dup"`` or ``"unique"`` rows by the duplicate flag."""
    if mode is None:
        return df
    return df.filter(F.col(DUPLICATE_FLAG) if mode == "dup" else ~F.col(DUPLICATE_FLAG))


def drop_empty_rows(df: DataFrame, *totals: str) -> DataFrame:
    """Drop rows whose totals are all zero."""
    empty = F.lit(True)
    for t in totals:
        empty = empty & (quoted(t) == 0)
    return df.filter(~empty)


def positive_total(df: DataFrame, total: str) -> DataFrame:
    return df.filter(quoted(total) > 0)


def valid_lines(lines: DataFrame, excluded_qty=(1, -1)) -> DataFrame:
    """Transfer lines whose quantity is known and not one of the excluded ones."""
    return lines.filter(~F.col("cantidad").isin(list(excluded_qty)))


def valid_headers(headers: DataFrame, statuses=("2",)) -> DataFrame:
    return headers.filter(F.col("status").isin(list(statuses)))


def valid_movements(lines: DataFrame, headers: DataFrame, statuses=("2",),
                    excluded_qty=(1, -1)) -> DataFrame:
    """Transfer lines with their headers, both filtered before the join."""
    return valid_lines(lines, excluded_qty).join(valid_headers(headers, statuses), "numero")


def clear_promo_without_stock(df: DataFrame, stock_col: str | None = None) -> DataFrame:
    """Zero the promotion and discount of rows without stock, keeping the style
    (text or number) of the discount column."""
    stock_col = stock_col or stock_column(df.columns)
    if stock_col is None:
        return df
    no_stock = F.coalesce(number_or_null(df, stock_col), F.lit(0)) <= 0
    zeroed = {}
    for name, text_zero in ((PROMO, "0"), (DISCOUNT, "0%")):
        if name in df.columns:
            kind = df.schema[name].dataType
            zero = F.lit(text_zero) if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
            zeroed[name] = F.when(no_stock, zero).otherwise(quoted(name))
    return df.withColumns(zeroed)
