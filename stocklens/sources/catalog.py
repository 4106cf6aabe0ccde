"""Discount catalogs: delimited files or workbooks whose header sits at an unknown row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import require
from ..functions.text import quoted, stripped
from ..names import CATALOG_DISCOUNT, CATALOG_PERCENT, ITEM_KEY
from .tables import strip_columns
from .workbooks import read_workbooks

# --- fixed values: words that mark the two catalog columns -------------------
KEY_WORD = "concatenar"
PERCENT_WORD = "descuento"

MAX_ROW_LINES = 32_768      # lines of one row; a cell of a workbook holds no more than 32,767 characters


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their number within the file, from 0, and the split they begin in.

    Files are read in splits.  A line's place in its split comes from the row
    ids, which grow along a split; the split sizes, one row each, are summed up
    to give the first number of every split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count("value").alias("n"))
                   .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
                   .drop("n"))
    return (lines.join(splits, ["file", "split"])
                 .select("file", "split", (F.col("row") - F.col("first") + F.col("offset")).alias("line"), "value"))


# --- rows over several lines ---------------------------------------------------
#
# A quote opens a cell only at the cell's start and closes it unless doubled.  Whether the
# end of a line lies inside a quoted cell depends on whether its start does, so a line is
# a function from that bit to that bit: it keeps, sets or flips it.  Such functions compose,
# first within a split, then over the splits of a file, wherever the file is cut.  Regular
# expressions use possessive repeats alone, so they are linear and need no stack.

def _quoted_cell() -> str:
    return r'"[^"]*+(?:""[^"]*+)*+"'


def _cell(sep: str) -> str:
    """A separator with the closed cell behind it."""
    s = _escaped(sep)
    return rf"{s}(?:\s*+{_quoted_cell()}[^{s}]*+|(?!\s*+\")[^{s}]*+)"


def _escaped(sep: str) -> str:
    if len(sep) != 1 or sep in '"\n\r':
        raise ValueError(f"a separator is one character, not {sep!r}")
    return f"\\x{{{ord(sep):x}}}"


def line_ends(value: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell if it starts outside, and if it starts inside of one."""
    def left_open(text: Column) -> Column:
        return F.regexp_replace(text, f"^(?:{_cell(sep)})*+", "") != ""

    opening = r'^[^"]*+(?:""[^"]*+)*+"' + f"[^{_escaped(sep)}]*+"
    plain = ~F.contains(value, F.lit('"'))
    outside = F.when(plain, False).otherwise(left_open(F.concat(F.lit(sep), value)))
    inside = F.when(plain | ~value.rlike(opening), True).otherwise(left_open(F.regexp_replace(value, opening, "")))
    return outside, inside


def quoted_spans(lines: DataFrame, sep: str = ";") -> DataFrame:
    """(file, first, last): the rows that a quoted line break spreads over several of ``lines`` (file, split, line, value).

    Only lines that may change the state are shuffled, without their text.  A quote that is
    never closed fails the read, and so does a row of more than ``MAX_ROW_LINES`` lines;
    the error names file and line.
    """
    outside, inside = line_ends(F.col("value"), sep)
    turns = (lines.select("file", "split", "line", outside.cast("int").alias("outside"), inside.cast("int").alias("inside"))
                  .filter("outside = 1 or inside = 0"))
    sets, flips = F.col("outside") == F.col("inside"), F.when(F.col("outside") > F.col("inside"), 1).otherwise(0)
    earlier = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # The state that a line sets, seen through the flips before it, holds until the next one that sets.
    turns = turns.withColumn("flips", flips).withColumn("odd", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    turns = turns.withColumn("seen", F.when(sets, (F.col("outside") + F.col("odd")) % 2))
    turns = turns.withColumn("known", F.last("seen", ignorenulls=True).over(earlier))

    splits = turns.groupBy("file", "split").agg(
        (F.sum("flips") % 2).alias("odd"), F.max(F.when(F.col("seen").isNotNull(), F.struct("line", "seen")))["seen"].alias("seen"))
    splits = splits.withColumn("sets", F.col("seen").isNotNull()).withColumn("end", (F.col("seen") + F.col("odd")) % 2)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("turned", F.coalesce(F.sum(F.when(~F.col("sets"), F.col("odd"))).over(before), F.lit(0)) % 2)
    last_set = F.last(F.when(F.col("sets"), (F.col("end") + F.col("turned")) % 2), ignorenulls=True).over(before)
    starts = splits.select("file", "split", ((F.coalesce(last_set, F.lit(0)) + F.col("turned")) % 2).alias("start"))

    state = (F.coalesce("known", "start") + F.col("odd")) % 2
    borders = (turns.join(starts, ["file", "split"]).withColumn("state", state)
                    .filter(F.when(F.col("state") == 0, F.col("outside") == 1).otherwise(F.col("inside") == 0)))
    borders = borders.select("file", "split", "line", "state", F.lead("line").over(
        Window.partitionBy("file", "split").orderBy("line")).alias("next"))
    following = borders.groupBy("file", "split").agg(F.min("line").alias("first")).select(
        "file", "split", F.lead("first").over(Window.partitionBy("file").orderBy("split")).alias("later"))
    spans = borders.filter("state = 0").join(following, ["file", "split"])
    last = F.coalesce("next", "later")

    def failed(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(what), (F.col("line") + 1).cast("string"), F.lit(" of "), "file"))

    return spans.select("file", F.col("line").alias("first"), F.when(
        last.isNull(), failed("a quote is not closed after line ")).when(
        last - F.col("line") >= MAX_ROW_LINES, failed(f"a row of over {MAX_ROW_LINES} lines after line ")).otherwise(
        last).cast("bigint").alias("last"))


def joined_rows(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, value): one row for each row of the files, numbered by its first line.

    Lines of one row are joined by a line feed.  Only those lines are grouped.
    """
    parts = spans.select("file", "first", F.explode(F.sequence("first", "last")).alias("line"))
    alone = lines.join(parts, ["file", "line"], "left_anti").select("file", "line", "value")
    pieces = F.array_sort(F.collect_list(F.struct("line", "value")))
    several = (lines.join(parts, ["file", "line"]).groupBy("file", "first")
                    .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
                    .select("file", F.col("first").alias("line"), "value"))
    return alone.unionByName(several)


def row_lines(spans: DataFrame, rows: dict[str, int]) -> DataFrame:
    """For files with rows over several lines, the line where the row of a given number begins, by column name.

    Only the first spans of a file count, as many as the largest number.
    """
    order = Window.partitionBy("file").orderBy("first")
    top = spans.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(rows.values()))
    extra = F.col("last") - F.col("first")
    top = top.withColumn("extra", extra).withColumn("row", F.col("first") - F.coalesce(
        F.sum(extra).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return top.groupBy("file").agg(*[
        (F.lit(k) + F.coalesce(F.sum(F.when(F.col("row") < k, F.col("extra"))), F.lit(0))).alias(name) for name, k in rows.items()])


def _cells(value: Column, sep: str) -> Column:
    """Cells of a delimited row, whatever their number; blank cells are NULL.

    A separator or line break inside a quoted cell is part of it.
    """
    found = F.regexp_extract_all(F.concat(F.lit(sep), value), F.lit(f"{_cell(sep)}|{_escaped(sep)}[^{_escaped(sep)}]*+"), F.lit(0))

    def clean(cell: Column) -> Column:
        text = stripped(F.substring(cell, 2, 2 ** 31 - 1))
        whole = text.rlike(f"^{_quoted_cell()}$")
        bare = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.nullif(stripped(F.when(whole, bare).otherwise(text)), F.lit(""))

    return F.transform(found, clean)


def _marked(cells: Column, *words: str) -> Column:
    """Positions (from 0) of the cells holding any of the words."""
    places = F.transform(cells, lambda c, i: F.when(
        F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False)), i))
    return F.filter(places, lambda i: i.isNotNull())


def load_catalog(spark: SparkSession, path: str, header_row: int | None = None,
                 scan_rows: int = 50, fallback: tuple[int, int] = (0, 6),
                 sep: str = ";", fmt: str = "text", sheet: str | int = 0) -> DataFrame:
    """Catalog rows of every file under ``path`` as ``Concatenar``, ``% Descuento``.

    ``fmt="text"`` reads files delimited by ``sep``, whose quoted cells may hold line
    breaks; ``fmt="workbook"`` reads a ``sheet``, by name or number from 0, of workbooks.

    The header of a file is its first row, within ``scan_rows``, having a cell
    with each marker word, or row ``header_row`` (from 0).  Of its cells the first two
    marked ones count, or those at the ``fallback`` positions, and the two columns are
    told apart by their exact names.  A file without a header or without both names
    fails the read; the error names it.
    """
    given = scan_rows if header_row is None else header_row
    if fmt == "workbook":
        rows = read_workbooks(spark, path, sheet).select("file", F.col("row").alias("line"), "cells")
        cells, near_top, given_line = F.col("cells"), F.col("line") < scan_rows, F.lit(given)
        tops = rows
    elif fmt == "text":
        lines = numbered_lines(spark, path)
        spans = quoted_spans(lines, sep)
        rows, cells = joined_rows(lines, spans), _cells(F.col("value"), sep)
        tops = rows.join(row_lines(spans, {"scan_end": scan_rows, "given": given}), "file", "left")
        near_top, given_line = F.col("line") < F.coalesce("scan_end", F.lit(scan_rows)), F.coalesce("given", F.lit(given))
    else:
        raise ValueError(f"fmt must be 'text' or 'workbook', not {fmt!r}")
    wanted = near_top if header_row is None else near_top | (F.col("line") == given_line)
    tops = tops.select("file", "line", F.when(wanted, cells).alias("cells"), near_top.alias("near_top"),
                       (F.lit(False) if header_row is None else F.col("line") == given_line).alias("given"))
    found = F.col("near_top") & F.coalesce((F.size(_marked(F.col("cells"), KEY_WORD)) > 0)
                                           & (F.size(_marked(F.col("cells"), PERCENT_WORD)) > 0), F.lit(False))
    order = F.when(found | F.col("given"), F.struct(~found, "line"))
    heads = tops.groupBy("file").agg(F.min_by(F.struct("line", "cells"), order).alias("head"))
    marked = _marked(F.col("head.cells"), KEY_WORD, PERCENT_WORD)
    places = F.when(F.size(marked) >= 2, F.slice(marked, 1, 2)).otherwise(F.array(*[F.lit(i) for i in fallback]))
    heads = heads.withColumn("places", places)

    def place(name: str) -> Column:
        at = F.filter("places", lambda i: F.coalesce(F.get("head.cells", i) == name, F.lit(False)))
        missing = F.raise_error(F.concat(F.lit(f"no column '{name}' in the header of "), "file"))
        return F.coalesce(F.get(at, F.lit(0)), missing.cast("int"))

    no_header = F.raise_error(F.concat(F.lit(f"no header in the first {scan_rows} lines of "), "file"))
    heads = heads.select("file", F.coalesce("head.line", no_header.cast("bigint")).alias("head_line"),
                         place(ITEM_KEY).alias("key_at"), place(CATALOG_PERCENT).alias("percent_at"))
    body = rows.join(heads, "file").filter(F.col("line") > F.col("head_line"))
    body = body.select("key_at", "percent_at", cells.alias("cells"))
    picked = body.select(F.get("cells", F.col("key_at")).alias(ITEM_KEY),
                         F.get("cells", F.col("percent_at")).alias(CATALOG_PERCENT))
    return picked.dropna("all")


def as_catalog(df: DataFrame) -> DataFrame:
    """Catalog contract: both columns must exist; the percent column is renamed."""
    df = strip_columns(df)
    require(df, (ITEM_KEY, CATALOG_PERCENT))
    return df.select(ITEM_KEY, quoted(CATALOG_PERCENT).cast("string").alias(CATALOG_DISCOUNT))
