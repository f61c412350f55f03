"""Request parameters as column expressions: flags, page limits and offsets, with a default for what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a flag, and the limits of a page.
ON, OFF = ("1", "true", "yes"), ("0", "false", "no")
PAGE, PAGE_MAX, EXPORT_MAX = 100, 1000, 2000


def flag(value: Column, default: bool) -> Column:
    low = F.lower(value)
    return F.coalesce(F.when(low.isin(*ON), True).when(low.isin(*OFF), False), F.lit(default))


def _whole(value: Column) -> Column:
    """The whole number that a text holds; null for any other text."""
    return F.when(value.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(F.regexp_replace(value, r"[\s+]", "")).try_cast("bigint"))


def limit(value: Column, default: int = PAGE, maximum: int = PAGE_MAX) -> Column:
    """From 1 to maximum."""
    number = _whole(value)
    return F.when(number.isNull(), default).otherwise(F.least(F.lit(maximum), F.greatest(F.lit(1), number))).cast("bigint")


def offset(value: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), _whole(value)), F.lit(0)).cast("bigint")
