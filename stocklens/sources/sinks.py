"""Writing views and preparing report columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import require
from ..functions.text import quoted
from ..names import CATALOG_DISCOUNT, DISCOUNT, ITEM_KEY
from .workbooks import EmptyViewError, exists, listed, located, write_workbooks

# --- fixed values: words that mark a branch or main-house column -------------
BRANCH_COLUMN_WORDS = ("Casa Matriz", "Sucursal")


def export_view(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists",
                **options) -> str:
    """Write the whole view with a header in one job; an empty view is refused and leaves nothing behind.

    Rows are counted while they are written to a staging folder beside ``path``; the commit
    moves the files into place, replaces what was there (``mode="overwrite"``) or adds to it
    (``"append"``), or removes them if there are none.  Nothing is kept on executors.
    ``fmt="workbook"`` writes workbooks, see ``sources.workbooks``.
    """
    if fmt == "workbook":
        return write_workbooks(df, path, mode, **options)
    if mode not in ("errorifexists", "error", "append", "overwrite"):
        raise ValueError(f"mode must be errorifexists, append or overwrite, not {mode!r}")
    files, target = located(path.rstrip("/"))
    if mode.startswith("error") and exists(files, target):
        raise FileExistsError(f"{path} already exists")
    suffix = f"_staging-{uuid.uuid4().hex}"
    counted = Observation("export")
    writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.options(**options)
    if fmt == "csv":
        writer = writer.option("header", True)
    try:
        writer.format(fmt).save(path.rstrip("/") + suffix)
        if not counted.get.get("rows"):
            raise EmptyViewError("no rows to export")
        move_files(files, target + suffix, target, replace=mode == "overwrite")
    finally:
        if exists(files, target + suffix):
            files.delete_dir(target + suffix)
    return path


def move_files(files, source: str, target: str, replace: bool) -> None:
    """Move all files below ``source`` to ``target``, the marker of success last; then delete older ones if ``replace``."""
    old = listed(files, target, recursive=True) if replace else []
    found = sorted(listed(files, source, recursive=True), key=lambda f: f.endswith("/_SUCCESS"))
    for f in found:
        place = target + f[len(source):]
        files.create_dir(place.rsplit("/", 1)[0], recursive=True)
        files.move(f, place)
    moved = {target + f[len(source):] for f in found}
    for f in old:
        if f not in moved:
            files.delete_file(f)


def split_columns(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Data columns and branch columns of a view."""
    branch = [n for n in names if any(w in n for w in BRANCH_COLUMN_WORDS)]
    return [n for n in names if n not in branch], branch


def export_columns(df: DataFrame, data_cols: Iterable[str], branch_cols: Iterable[str]) -> DataFrame:
    """The chosen columns in view order, as text, NULL as empty text."""
    data, branch = split_columns(df.columns)
    data_cols, branch_cols = set(data_cols), set(branch_cols)
    if not data_cols & set(data) or not branch_cols & set(branch):
        raise ValueError("choose at least one data column and one branch column")
    wanted = (data_cols & set(data)) | (branch_cols & set(branch))
    return df.select(*[_as_text(c) for c in df.columns if c in wanted])


def discount_report(df: DataFrame) -> DataFrame:
    """Item key, own discount and catalog discount, NULL as empty text."""
    if ITEM_KEY not in df.columns and "Conoatenar" in df.columns:
        df = df.withColumnRenamed("Conoatenar", ITEM_KEY)
    report = (ITEM_KEY, DISCOUNT, CATALOG_DISCOUNT)
    require(df, report)
    return df.select(*[_as_text(c) for c in report])


def _as_text(name: str):
    return F.coalesce(quoted(name).cast("string"), F.lit("")).alias(name)
