"""Text keys compared as the warehouse's database compares them.

Case and trailing blanks do not tell keys apart there.  Spark carries a collation in the
type of a column, so collated keys need no operators of their own: joins, semi joins,
groups, distinct values and rule lists follow it.  Both sides of a comparison must be
collated, hence whole table sets are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted

COLLATION = "UTF8_LCASE_RTRIM"
PLAIN = "UTF8_BINARY"


def collate_keys(df: DataFrame, columns: Iterable[str] | None = None, collation: str = COLLATION) -> DataFrame:
    """``df`` with its text columns, all or those of the given names, under a collation.

    Values keep their spelling.  Where rows of several spellings fall into one group, the
    group shows one of them; compare such output without case and trailing blanks.
    """
    wanted = None if columns is None else {c.lower() for c in columns}
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
              and (wanted is None or f.name.lower() in wanted)]
    return df.withColumns({c: F.collate(quoted(c), collation) for c in chosen}) if chosen else df


def collate_tables(tables: Mapping[str, DataFrame], collation: str = COLLATION) -> dict[str, DataFrame]:
    """All tables with collated keys."""
    return {name: collate_keys(df, collation=collation) for name, df in tables.items()}


def plain_texts(df: DataFrame) -> DataFrame:
    """``df`` with every text column back under the binary comparison, for writing or comparing."""
    chosen = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.dataType.collation != PLAIN]
    return df.withColumns({c: F.collate(quoted(c), PLAIN) for c in chosen}) if chosen else df
