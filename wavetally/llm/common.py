"""Shared folder, intermediate tables and other small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of a histogram, and most rows that the last step of a selection brings to the driver.
HISTOGRAM = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a single-JVM session (local[...]) without the setting gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wavetally-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of stash in this process, the newest last.
_MADE: list[str] = []


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared folder as Parquet and read back.

    It cuts the lineage: lost executors cost a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, stashed; the stashes that making them took are deleted then."""
    before = len(_MADE)
    out = stash(make())
    gone, _MADE[before:] = _MADE[before:-1], _MADE[-1:]
    jvm, conf = out.sparkSession._jvm, out.sparkSession._jsc.hadoopConfiguration()
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return out


def keyed(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs, written once, with a key for each row: a hash of its columns (but maps), then a number of its own.

    Only rows that are equal are told apart by the number, so that choices by the key are the same in every run.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return stash(docs.withColumn(name, F.struct(F.xxhash64(*plain).alias("hash"), F.monotonically_increasing_id().alias("id"))))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls in the given fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column (the least if there are fewer; None if k < 1 or without rows)."""
    values = df.select(F.col(column).alias("x")).where("x IS NOT NULL")
    if k < 1:
        return None
    while True:
        low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
        if not n:
            return None
        if n <= k:
            return low
        if n <= HISTOGRAM or low == high:
            return low if low == high else sorted((r["x"] for r in values.collect()), reverse=True)[k - 1]
        width = (high - low) / HISTOGRAM
        if low + width == low:  # the range is as narrow as numbers are
            return low
        bins = F.least(F.lit(HISTOGRAM - 1), F.floor((F.col("x") - low) / width)).alias("bin")
        counted = sorted(((r["bin"], r["count"]) for r in values.groupBy(bins).count().collect()), reverse=True)
        for at, count in counted:
            if k <= count:
                break
            k -= count
        values = values.withColumn("bin", bins).where(F.col("bin") == at).select("x")
