"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; they
share a budget, each up to a cap of epochs, the excess going to the others by
weight (water filling, solved in closed form over the table of sources).

Selection: a source's complete epochs take every document; the rest of its target
is filled in the order of exponential keys -ln(u) / quality, by a prefix sum. A
document is taken when at least half of it fits, so that a source ends within
half a document of its target. Prefix sums run in two steps: rows are dealt out by
ranges of source and key, whose edges Spark takes from quantiles of these keys, so
that a range holds about BUCKET_ROWS rows whatever the source's size and quality; sums
per range, then windows within ranges, make the prefix sums.

Defined cases: null text: size 0 and never counted; null source: a source of its
own, last; null doc_id: keyed by its text; repeated rows: each a row of its
own, in either order; sources without words: target 0; a text of any length counts
whole; other columns stay as they are in mix, whatever their names; empty table:
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavetally.llm.common import WORD, keyed, stash

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
#: Rows of a range of keys; what one task sorts.
BUCKET_ROWS = 1 << 16
SALTS = 64
#: Characters that prose rarely holds; their share lowers a document's quality.
SYMBOLS = "#$%&*|{}<>~^=+@_"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.05 to 1: the share of ordinary characters to the fourth power; 1 for no text."""
    share = F.length(F.translate(text, SYMBOLS, "")) / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.05), share * share * share * share), F.lit(1.0))


def exponential_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """-ln(u) / quality; u comes from the md5 of seed and id (without one, of the text's md5), so that reruns agree."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.ln(u) / quality(text)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row per source: source, source_size, n, target. sized: source, size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"),
            "cap": F.col("source_size") * max_epochs,
            "budget": F.sum("source_size").over(everything) * share_percent / 100.0,
        }
    ).withColumn("all_weight", F.sum("weight").over(everything))
    # In the order of cap per weight, the sources that end at their cap are a prefix.
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    at = weighed.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    at = at.withColumn("full", F.col("cap") / F.col("weight") <= level)
    full = at.withColumns(
        {
            "caps": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything),
            "full_weight": F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(everything),
        }
    )
    shared = (F.col("budget") - F.col("caps")) * F.col("weight") / (F.col("all_weight") - F.col("full_weight"))
    return full.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def in_ranges(rows: DataFrame, n: int, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (of them n), written once, with their range of source and order as the column bucket."""
    by = [F.col("source").isNull(), F.col("source"), *map(F.col, order)]
    return stash(rows.repartitionByRange(max(1, -(-n // bucket_rows)), *by).withColumn("bucket", F.spark_partition_id()))


def plan_mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, epochs, chosen, taken, and the column row (its key) if named."""
    own = [row] if row else []
    order = ["key", "doc_id", "size", *own, "salt"]
    # The texts are read once; what is kept of them is a few numbers a row. Salts go by row, so rows without an id are spread.
    rows = stash(
        docs.select(
            "doc_id",
            "source",
            words(F.col("text")).alias("size"),
            exponential_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
            *own,
        )
    )
    # Each source's row meets its documents in as many parts as there are salts.
    targets = source_targets(rows, weights, share_percent, max_epochs).withColumnRenamed("source", "of")
    targets = targets.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = in_ranges(rows, rows.count(), order, bucket_rows).withColumns({"src": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    sums = at.groupBy("src", "none", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("src", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("src", "none", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "none", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = at.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["src", "none", "bucket"])
    summed = summed.join(targets, summed["source"].eqNullSafe(targets["of"]) & (summed["salt"] == targets["part"])).drop("of", "part", "salt")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("size") > 0) & (2 * (F.col("base") + F.col("within")) + F.col("size") <= 2 * rest)
    out = summed.withColumn("epochs", epochs).withColumn("chosen", chosen)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "chosen", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"), *own
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each row as often as its own epochs and selection say.

    Rows carry a key through the plan, so rows that share a doc_id, or have none, are each decided alone.
    Documents without words are not taken.
    """
    rows = keyed(docs)
    times = (F.col("epochs") + F.col("chosen").cast("long")).alias("__times")
    taken = plan_mix(rows, row="__row", **how).where("size > 0").select("__row", times).where("__times > 0")
    joined = rows.join(taken, "__row")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
