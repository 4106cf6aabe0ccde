"""Quality rules: counts and verdicts per document, and shrunken verdicts per host.

Base rules look at one text.  Host rules count the failures of a host's documents,
shrink the rate toward the corpus with a beta prior fitted to all hosts, and reject
the documents of hosts that are surely bad.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import OneByOne, fresh, in_parts, one_at_a_time

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` (a power of two) words that occur twice or more.

    Windows are named by doubling: a name for each word, then for each pair of names
    a window apart, so equal names mean equal windows.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    names = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    width = 1
    while width < window:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        distinct, names = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    hit = np.bincount(names)[names] > 1
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORDS.findall(text)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif WORDS.search(line):
            seen.add(line)
    return (len(words), sum(map(len, words)), len(NOT_SYMBOL.sub("", text)), duplicates,
            repeated_words(words))


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])
    for texts in one_at_a_time(batches):
        yield from in_parts((dict(zip(COUNTS, text_counts(t), strict=True)) for t in OneByOne(texts)), kind)


def base_failed(counts: Column) -> Column:
    return ((counts.n_words < MIN_WORDS)
            | (100 * counts.n_repeat_words > MAX_REPEAT_PERCENT * counts.n_words))


def with_base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``rules``: struct of the five counts and ``base_failed``.

    Null texts count as empty: all counts 0, failed.  Repeated rows and extra columns
    stay; if ``docs`` has a column ``rules``, the new one gets underscores in front.
    """
    name = fresh(docs, "rules")
    counted = docs.withColumn(name, _counts(F.col(text)))
    return counted.withColumn(name, F.col(name).withField("base_failed", base_failed(F.col(name))))


def host_rates(scored: DataFrame, host: str = "source", failed: str = "rules.base_failed") -> DataFrame:
    """One row per host: host, n, fails, rate (posterior mean), spread (posterior deviation).

    The prior is Beta(a, b) fitted by moments: its mean is the corpus rate and its
    weight a + b comes from the variance of the host rates beyond the binomial one,
    between 2 (hosts say little about each other) and 1e6 (hosts are alike).  Hosts are
    pre-aggregated on the map side; the prior is one row.  Null is a host of its own.
    """
    hosts = scored.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("fails"))
    total = hosts.agg(F.sum("n").alias("n_all"), F.sum("fails").alias("fails_all"),
                      F.count(F.lit(1)).alias("n_hosts"),
                      F.sum(F.col("n").cast("double") * F.col("n")).alias("n_squares"),
                      F.sum(F.col("fails").cast("double") * F.col("fails") / F.col("n")).alias("rate_squares"))
    n_all, k = F.col("n_all").cast("double"), F.col("n_hosts").cast("double")
    mean = F.col("fails_all") / n_all
    between = F.col("rate_squares") - n_all * mean * mean
    spread = n_all - F.col("n_squares") / n_all
    variance = (between - (k - 1) * mean * (1 - mean)) / F.when(spread > 0, spread)
    weight = F.when(variance > 0, mean * (1 - mean) / variance - 1).otherwise(1e6)
    bounded = F.greatest(F.lit(2.0), F.least(F.lit(1e6), F.coalesce(weight, F.lit(1e6))))
    prior = total.select(F.struct(mean.alias("mean"), bounded.alias("weight")).alias("prior"))
    hosts = hosts.withColumn("prior", prior.scalar())
    n = F.col("n") + F.col("prior.weight")
    rate = (F.col("fails") + F.col("prior.mean") * F.col("prior.weight")) / n
    return hosts.select("host", "n", "fails", rate.alias("rate"),
                        F.sqrt(rate * (1 - rate) / (n + 1)).alias("spread"))


def with_host_verdicts(scored: DataFrame, host: str = "source", rules: str = "rules",
                       max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``scored`` with ``kept``: false if the document failed its base rules or its host is bad.

    A host is bad if its shrunken failure rate lies above ``max_rate`` by two posterior
    deviations.  The verdicts are one row per host; a hot host is split by adaptive
    execution.  An empty table gives no rows.  A column ``kept`` already there stays
    and the new one gets underscores in front.
    """
    verdicts = host_rates(scored, host, f"{rules}.base_failed").select(
        F.struct("host", (F.col("rate") - 2 * F.col("spread") > max_rate).alias("bad"), "rate").alias("verdict"))
    column = fresh(scored, "kept")
    joined = scored.join(verdicts, F.col(host).eqNullSafe(F.col("verdict.host")), "left")
    return joined.select(*scored.columns, (~F.col(f"{rules}.base_failed") & ~F.coalesce(
        F.col("verdict.bad"), F.lit(False))).alias(column), F.col("verdict.rate").alias(fresh(scored, "host_rate")))
