"""Rows of known and of unwanted cities, matched without regard to case against whole names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_roster(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """rows whose city the roster (city) has."""
    return rows.join(roster.select(F.lower("city").alias("__c")).distinct(), F.lower(rows["city"]) == F.col("__c"), "left_semi")


def without_junk(rows: DataFrame, junk: DataFrame) -> DataFrame:
    """rows whose city the list of unwanted names (city) lacks; rows without a city stay."""
    return rows.join(junk.select(F.lower("city").alias("__c")).distinct(), F.lower(rows["city"]) == F.col("__c"), "left_anti")


def junk_counts(rows: DataFrame, junk: DataFrame) -> DataFrame:
    """city, n: how many rows each unwanted name would lose."""
    names = junk.select(F.lower("city").alias("city")).distinct()
    return rows.groupBy(F.lower("city").alias("city")).agg(F.count(F.lit(1)).alias("n")).join(names, "city", "left_semi")
