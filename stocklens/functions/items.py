"""Item, region, owner, discount and share expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import PROMO
from ..rules import LabelRule, StockRules
from .text import joined, number_from_text, quoted


def item_key(reference: Column, brand: Column) -> Column:
    """Reference code followed by brand code; a NULL part counts as ``''``."""
    return joined(reference, brand)


def label_by_list(col: Column, rules: Sequence[LabelRule], default: str) -> Column:
    """First rule whose list holds the code wins; codes in no list get ``default``."""
    if not rules:
        return F.lit(default)
    first, *rest = rules
    chain = reduce(
        lambda acc, rule: acc.when(col.isin(list(rule.values)), rule.label),
        rest, F.when(col.isin(list(first.values)), first.label))
    return chain.otherwise(default)


def region_bucket(store_id: Column, rules: StockRules) -> Column:
    return label_by_list(store_id, rules.regions, rules.no_region)


def owner(subline: Column, rules: StockRules) -> Column:
    return label_by_list(subline, rules.owners, rules.no_owner)


def discount_label(price: Column, promo: Column) -> Column:
    """Promotion discount as whole percent text; a NULL price gives a bare ``%``."""
    ratio = promo / F.nullif(price, F.lit(0))
    percent = F.round((F.lit(1) - ratio) * 100, 0).cast("int")
    return (F.when((promo == 0) | (price == 0) | (promo == price), F.lit("0%"))
             .otherwise(joined(percent.cast("string"), F.lit("%"))))


def store_label(region: Column, store: Column) -> Column:
    """Pivot label of a store; NULL when either part is NULL."""
    return F.concat(region, F.lit(" - "), store)


def rounded_half_even(value: Column) -> Column:
    """Correct decimal rounding to 2 places: ties are judged on the exact value.

    The double is split so that both ``head * 100`` and ``tail * 100`` are
    exact; their sum is then compared with the half-way point without error.
    """
    value = value.cast("double")
    head = value.cast("float").cast("double")
    hi, lo = head * 100, (value - head) * 100
    base = F.floor(hi).cast("double")
    gap = hi - base - 0.5
    step = F.when(gap > -lo, 1.0).when(gap == -lo, F.pmod(base, F.lit(2.0))).otherwise(0.0)
    return (base + step) / 100


def rounded_scaled(value: Column) -> Column:
    """Array-library rounding to 2 places: scale, round half-even, scale back."""
    return F.rint(value.cast("double") * 100) / 100


def share(part: Column, total: Column) -> Column:
    """``part`` as a percentage of a row total, 0 when the total is not positive."""
    percent = rounded_half_even(part.cast("double") / F.nullif(total, F.lit(0)) * 100)
    return F.when(total > 0, percent).otherwise(F.lit(0.0))


def percent_sign(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def promo_flag(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Flag spellings as 1/0; every other value stays as it is."""
    if isinstance(dtype, T.BooleanType):
        return col.cast("int")
    if not isinstance(dtype, T.StringType):
        return col
    return (F.when(col.isin("True", "true", "1"), "1")
             .when(col.isin("False", "false", "0"), "0").otherwise(col))


def normalise_promo(df: DataFrame, name: str = PROMO) -> DataFrame:
    if name not in df.columns:
        return df
    return df.withColumn(name, promo_flag(quoted(name), df.schema[name].dataType))


def pct_text(col: Column) -> Column:
    """Percent text rounded half-even to a whole number; other text is left alone."""
    number = number_from_text(F.replace(col, F.lit("%"), F.lit("")))
    return F.coalesce(joined_percent(number), col)


def joined_percent(number: Column) -> Column:
    return F.concat(F.rint(number).try_cast("bigint").cast("string"), F.lit("%"))
