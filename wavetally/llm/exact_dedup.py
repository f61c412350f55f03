"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are deduplicated locally (the map side of the first aggregation), merged in
salted digest groups, and the salt winners are combined globally. Every stage
groups by the full text beside its digest, so that a digest collision never
merges two texts. A group that holds a third of all rows reaches no task whole:
it is spread over the salts, and each salt passes on one winner.

duplicate_groups then tells each row of its group. That join carries no text: it is by
digest, two 64-bit hashes and the length, so that it goes wrong only where two texts
agree in all of them. With SHA-256 that has a probability of less than 2 ** -256 for
each pair even before the other two, far less than that of a hardware fault; carrying
the text there would move all texts twice more (see README). drop_duplicates has no
such join.

Defined cases: a null text counts as empty; the row with the largest doc_id
stays, and a null doc_id is smaller than any other; of repeated rows (same
doc_id and text) exactly one is kept; a text of any length is compared whole; columns
of any name and kind are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SALTS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(docs: DataFrame, salts: int, digest: Callable[[Column], Column], normalise: Callable[[Column], Column] | None) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(
        docs["doc_id"].alias("id"),
        text.alias("body"),
        digest(text).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.pmod(F.xxhash64(docs["doc_id"]), F.lit(salts)).cast("int").alias("salt"),
    )


def duplicate_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = _sha256, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    digest may be any function of the text; equality is always decided on the text.
    """
    if not 1 <= salts <= 64:
        raise ValueError("salts must be from 1 to 64")
    rows = _keyed(docs, salts, digest, normalise)
    merged = rows.groupBy("digest", "check", "salt", "body").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    # At most one row per salt meets here; which salts a group has is one long's bits.
    groups = merged.groupBy("digest", "check", "body").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    wide = groups.select(
        "digest",
        "check",
        F.xxhash64("body", F.lit(1)).alias("check2"),
        F.octet_length("body").alias("bytes"),
        "keep_id",
        "group_size",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), x -> shiftright(salts, x) & 1 = 1)")).alias("salt"),
    )
    # The rows find their group by digest and two further hashes; no text moves here. Repeats of one row travel as a count.
    light = (
        rows.select("id", "digest", "check", "salt", F.xxhash64("body", F.lit(1)).alias("check2"), F.octet_length("body").alias("bytes"))
        .groupBy("digest", "check", "check2", "bytes", "salt", "id")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    found = light.join(wide, ["digest", "check", "check2", "bytes", "salt"])
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
    return each.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without exact copies: of equal texts, the row with the largest doc_id.

    All columns of docs are kept; ties of doc_id are broken by the other columns.
    A null text that is kept stays null if the group holds only nulls, and is empty otherwise.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Maps have no order; their text stands before them, and they themselves are told apart by nothing else.
    unordered = [c for c in rest if "map<" in docs.schema[c].dataType.simpleString() or "variant" in docs.schema[c].dataType.simpleString()]
    of = {c: F.to_json(F.struct(F.col(f"`{c}`").alias("m"))) if c in unordered else F.col(f"`{c}`") for c in rest}
    row = F.struct(F.col("doc_id").alias("c0"), *[of[c].alias(f"c{i}") for i, c in enumerate(rest, 1)], F.col("text").isNotNull().alias("there"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.sha2(text, 256).alias("digest"), text.alias("body"), row.alias("row"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    merged = rows.groupBy("digest", "salt", "body").agg(F.max("row").alias("row"))
    won = merged.groupBy("digest", "body").agg(F.max("row").alias("row"))
    name = {"doc_id": F.col("row.c0"), "text": F.when(F.col("row.there"), F.col("body"))}
    for i, c in enumerate(rest, 1):
        kind = StructType([StructField("m", docs.schema[c].dataType)])
        name[c] = F.from_json(F.col(f"row.c{i}"), kind)["m"] if c in unordered else F.col(f"row.c{i}")
    return won.select(*[name[c].alias(c) for c in docs.columns])
