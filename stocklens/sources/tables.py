"""Reading the source tables from files, a catalog or a database."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from ..names import WAREHOUSE_LAYOUT


def strip_columns(df: DataFrame) -> DataFrame:
    """Column names without surrounding white space."""
    return df.toDF(*[c.strip() for c in df.columns])


def load_table(spark: SparkSession, name: str, base: str | None = None, fmt: str = "table",
               **options) -> DataFrame:
    """A whole table by name.

    ``fmt="table"`` reads the session catalog (``base`` is an optional catalog or
    schema prefix); ``fmt="jdbc"`` takes ``base`` as the URL and, for a parallel
    read, ``partitionColumn, lowerBound, upperBound, numPartitions``; any other
    format reads ``base/name`` or ``base/name.<fmt>``.
    """
    if fmt == "table":
        df = spark.table(f"{base}.{name}" if base else name)
    elif fmt == "jdbc":
        df = jdbc_reader(spark, base, name, **options).load()
    else:
        df = _load_files(spark.read.format(fmt).options(**options), base, name, fmt)
    return strip_columns(df)


LARGE_TABLES = tuple(
    n for k in ("fact_stock", "movement_line", "movement_header") for n in (k, WAREHOUSE_LAYOUT[k][0]))


def jdbc_reader(spark: SparkSession, url: str, name: str, **options):
    """Configured reader; a partitioned read needs all four bounds or none.

    The tables that grow with the business must be read in parts.
    """
    bounds = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    given = bounds & set(options)
    if given != bounds and (given or {name, name.split(".")[-1]} & set(LARGE_TABLES)):
        raise ValueError(f"partitioned read also needs: {', '.join(sorted(bounds - given))}")
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options)


def _load_files(reader: DataFrameReader, base: str, name: str, fmt: str) -> DataFrame:
    """``base/name.<fmt>`` when it exists, else ``base/name``."""
    path = f"{base.rstrip('/')}/{name}"
    try:
        return reader.load(f"{path}.{fmt}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return reader.load(path)


def load_sources(spark: SparkSession, base: str | None = None, fmt: str = "parquet",
                 names: Iterable[str] | None = None,
                 options: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """Tables of the star schema and the movements, keyed by our names.

    ``names`` lists other tables to read as they are; ``options`` holds reader
    options per table, such as the bounds of a partitioned database read.
    """
    options = options or {}
    wanted = WAREHOUSE_LAYOUT if names is None else names
    return {n: load_table(spark, n, base, fmt, **options.get(n, {})) for n in wanted}


def load_warehouse(spark: SparkSession, star_base: str, operational_base: str,
                   fmt: str = "table", options: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """The same tables under their warehouse names, renamed to ours.

    The star tables and the operational tables may live in different places.
    """
    options = options or {}
    tables = {}
    for ours, (source, renames) in WAREHOUSE_LAYOUT.items():
        base = star_base if source.startswith("tb") else operational_base
        tables[ours] = adopt(load_table(spark, source, base, fmt, **options.get(ours, {})), renames)
    return tables


def adopt(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Keep and rename the mapped columns a table has, ignoring case."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[df[have[src.lower()]].alias(dst)
                       for src, dst in renames.items() if src.lower() in have])
