"""Paging: a plain page, and one lossless watermark over several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order, with total, count and next_offset (null on the last page)."""
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))  # one row
    rows = df.orderBy(*order).offset(offset).limit(limit)
    after = F.lit(offset + limit)
    return rows.crossJoin(total).withColumn("next_offset", F.when(after < F.col("total"), after))


def sync_window(sections: dict[str, DataFrame], limits: dict[str, int]) -> DataFrame:
    """Rows (section, at, id) of all sections up to one watermark that no section's page was cut before.

    A section is cut if it has more rows than its limit; it is safe up to the last stamp before the first row
    that did not fit, or through that stamp if the whole page is one. The watermark is the least of the safe
    stamps. Only limit + 1 rows of each section are read on.
    """
    tops = []
    for name, df in sections.items():
        n = limits[name]
        top = df.select(F.lit(name).alias("section"), "at", "id").orderBy("at", "id").limit(n + 1)
        top = top.withColumn("rn", F.row_number().over(Window.partitionBy("section").orderBy("at", "id")))
        tops.append(top.withColumn("fits", F.col("rn") <= n))
    rows = reduce(DataFrame.unionByName, tops)
    edge = rows.where(~F.col("fits")).select("section", F.col("at").alias("edge"))
    safe = rows.where("fits").join(edge, "section").groupBy("section", "edge").agg(F.max(F.when(F.col("at") < F.col("edge"), F.col("at"))).alias("before"))
    cutoff = safe.agg(F.min(F.coalesce("before", "edge")).alias("cutoff"))
    kept = rows.where("fits").crossJoin(F.broadcast(cutoff)).where(F.col("cutoff").isNull() | (F.col("at") <= F.col("cutoff")))
    return kept.select("section", "at", "id", "cutoff")


def merge_streams(parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """The first rows of each section (section, at, id) in one order of time."""
    each = [df.select(F.lit(name).alias("section"), "at", "id").orderBy("at", "id").limit(n) for name, (df, n) in parts.items()]
    return reduce(DataFrame.unionByName, each).orderBy("at", "section", "id")
