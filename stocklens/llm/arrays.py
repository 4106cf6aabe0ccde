"""Array expressions: bind a value once, shift, hash runs of words, slide minima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shifted(values: Column, by: int) -> Column:
    """The elements from position ``by`` on."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pair_hashes(values: Column, others: Column) -> Column:
    """Hash of each element with its partner; a missing partner leaves the element's own hash."""
    return F.zip_with(values, others, lambda a, b: F.xxhash64(a, b))


def five_word_hashes(hashes: Column) -> Column:
    """Hash of each run of five word hashes; one hash of all of them if there are fewer."""
    def runs(h: Column) -> Column:
        two = pair_hashes(h, shifted(h, 1))
        four = bind(two, lambda t: pair_hashes(t, shifted(t, 2)))
        return F.slice(pair_hashes(four, shifted(h, 4)), 1, F.greatest(F.size(h) - 4, F.lit(1)))
    return bind(hashes, runs)


def sliding_minimum_8(values: Column) -> Column:
    """Minimum of each element and the seven after it (of those there are), by doubling."""
    def step(by: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, shifted(v, by), lambda a, b: F.least(a, b))
    return bind(bind(bind(values, step(1)), step(2)), step(4))
