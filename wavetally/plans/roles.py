"""The driver's tables in the roles of the domain's: readings, reports, alerts, forecasts, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed present of queries that depend on time.
NOW = "2024-01-31 00:00:00"


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, city, condition, value, captured_at out of events."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("C"), F.col("user_id")).alias("city"), F.col("event_type").alias("condition"),
        F.floor(F.col("value") / 50).cast("bigint").alias("value"), F.col("ts").alias("captured_at"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select(F.col("event_id").alias("id"), F.col("ts").alias("captured_at"), ((F.col("event_id") % 12) * 10).alias("purge_minutes"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("report_id"), F.col("ts").alias("captured_at"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, city, issued_at, lead, period, high_f, sky, precip_pct out of orders."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("city"), F.col("o_orderdate").alias("issued_at"),
        (F.col("o_orderkey") % 7).cast("int").alias("lead"), F.floor(F.col("o_totalprice") % 60).cast("int").alias("high_f"),
        (F.col("o_orderkey") % 4).cast("int").alias("step"), (F.col("o_orderkey") % 101).cast("int").alias("precip_pct"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, at, value, step out of line items; times spread over the day by the key."""
    li = load(spark, sf_dir, "lineitem")
    at = F.col("l_shipdate") + F.make_dt_interval(mins=(F.col("l_orderkey") * 37 % 1440).cast("int"))
    return li.select((F.col("l_suppkey") % 7).alias("city"), at.alias("at"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_partkey") % 4).cast("int").alias("step"))
