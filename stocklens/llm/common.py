"""Small helpers shared by the operators: words, fresh names, stored tables, Arrow arrays row by row."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# A word is a run of anything but the space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"
PART_ROWS = 200     # rows of an Arrow array that a task makes at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage with a copy that all executors can read, so the work above
    it runs once and is not lost with an executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class OneByOne:
    """The texts of an Arrow array; each becomes a Python text when its turn comes, not all at once."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self):
        return (t.as_py() for t in self.texts)


@cache
def _trim() -> Callable[[int], int]:
    """glibc's ``malloc_trim``; nothing where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Hand freed memory back to the system: the allocators of Arrow and C else keep it for a worker's life."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def one_at_a_time(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The Arrow arrays of a task; what was needed for one is handed back to the system before the next is read."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def in_parts(values: Iterable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``values`` as Arrow arrays of a few rows each, so that never all of a batch's results are held."""
    values = iter(values)
    while part := list(islice(values, PART_ROWS)):
        yield pa.array(part, kind)
