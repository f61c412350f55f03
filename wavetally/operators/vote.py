"""The repeat vote: the most frequent of the last readings of a series, ties to the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.config import DEFAULTS


def vote(df: DataFrame, keys: list[str], order: list[str], value: str, clock: str | None = None, depth: int | Column = DEFAULTS.vote_depth, seconds: int | None = None) -> DataFrame:
    """df with voted, votes and total after each row.

    The pool is the last depth rows of the row's key, and of those the ones at most seconds
    before it by clock. One shuffle by the keys; the frame bounds each row's state.
    """
    deepest = depth if isinstance(depth, int) else DEFAULTS.vote_depth
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - deepest, 0)
    at = F.unix_micros(F.col(clock).cast("timestamp")) if clock and seconds is not None else F.lit(0).cast("long")
    seen = F.collect_list(F.struct(F.col(value).alias("v"), at.alias("c"))).over(frame)
    if not isinstance(depth, int):
        seen = F.slice(seen, F.greatest(F.lit(1), F.size(seen) - depth + 1), depth)
    pool = F.col("__seen") if seconds is None else F.filter("__seen", lambda x: x["c"] >= F.element_at("__seen", -1)["c"] - seconds * 1_000_000)
    best = F.array_max(F.transform("__pool", lambda x, i: F.struct(F.size(F.filter("__pool", lambda y: y["v"] == x["v"])).alias("n"), i.alias("i"), x["v"].alias("v"))))
    out = df.withColumn("__seen", seen).withColumn("__pool", pool).withColumn("__best", best)
    return out.select(*df.columns, F.col("__best.v").alias("voted"), F.col("__best.n").alias("votes"), F.size("__pool").alias("total"))


def vote_conditions(readings: DataFrame, order: list[str], keys: tuple[str, ...] = ("city", "condition")) -> DataFrame:
    """The vote over the keys, value, captured_at: temperature over 5 readings, others over 15, all within 45 minutes."""
    depth = F.when(F.col("condition") == "temperature_f", DEFAULTS.temperature_depth).otherwise(DEFAULTS.vote_depth)
    return vote(readings, list(keys), order, "value", "captured_at", depth, DEFAULTS.vote_seconds)


def median_filter(df: DataFrame, keys: list[str], value: str, quorum: int = DEFAULTS.peer_quorum, deviation: float = DEFAULTS.peer_deviation) -> DataFrame:
    """df without rows that lie too far from their group's median, where a group has a quorum."""
    group = Window.partitionBy(*keys)
    at = df.withColumns({"__n": F.count(F.lit(1)).over(group), "__m": F.percentile(value, F.lit(0.5)).over(group)})
    return at.where((F.col("__n") < quorum) | (F.abs(F.col(value) - F.col("__m")) <= deviation)).drop("__n", "__m")
