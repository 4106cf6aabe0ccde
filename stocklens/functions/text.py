"""Text and number helpers as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def backticked(name: str) -> str:
    """Column name for SQL text and ``select``, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """Text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """Reference a column literally, whatever characters its name holds."""
    return F.col(backticked(name))


def stripped(col: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes only blanks)."""
    return F.btrim(col, F.lit(WHITESPACE))


def joined(*cols) -> Column:
    """Concatenate with NULL read as the empty text."""
    return F.concat_ws("", *cols)


def number_from_text(col: Column) -> Column:
    """Decimal text as a double, anything else (also ``nan``) as NULL."""
    text = stripped(col)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_or_null(df: DataFrame, name: str) -> Column:
    """Lenient numeric reading of a column, chosen by its declared type."""
    kind = df.schema[name].dataType
    col = quoted(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(kind, T.NumericType):
        return col
    if isinstance(kind, T.BooleanType):
        return col.cast("int")
    if isinstance(kind, T.StringType):
        return number_from_text(col)
    return F.lit(None).cast("double")


def normalise_name(name: str | None) -> str:
    """Column name in lower case without blanks, underscores and accents."""
    text = unicodedata.normalize("NFKD", (name or "").strip().lower())
    return "".join(ch for ch in text if ch not in " _" and not unicodedata.combining(ch))
