"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the document's shingle hashes have it
set. Two fingerprints link at RADIUS or fewer differing bits. They are cut into
parts; by the pigeonhole principle two linked ones agree in some part up to a small
ball: with 3 parts and 4 bits, up to one bit in one of the first two parts, or wholly
in the third; with the 2 parts that very many fingerprints ask for, up to two bits. Each fingerprint is stored under its parts and looked up under
the ball around them (of two values that differ in one bit, the one with the zero
there looks up the other). What meets under a key is verified by the complete
distance, and each key's links are passed on as a spanning forest, never as all pairs.

Keys under which more than HOT fingerprints are stored are cut further by the same
rule over the remaining bits, up to CUTS times. Documents of one fingerprint count as one node and
are joined back in salted parts. Components are found by ``components``.

Defined cases: a null text or one without words has fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; null doc_ids are never the
smallest and a component of nothing else has a null id; rows that repeat a doc_id
share its component; a text of any length is hashed whole; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import stash
from wavetally.llm.components import components

SHINGLE, SEED = 4, 42
RADIUS = 4
#: Most distinct fingerprints for which three parts tell enough apart; beyond, there are two of 32 bits.
MANY = 1 << 30
#: Most fingerprints stored under a key before it is cut further, and how often it is: then a group's values
#: agree in all but 20 bits, up to one bit in each part.
HOT, CUTS = 2048, 2
SALTS = 64
#: Pairs that a worker compares at a time.
PAIRS = 1 << 20

PRINTED = "doc_id bigint, fp bigint"
LINKS = "u bigint, v bigint"


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), dtype=">u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) of every document."""
    return docs.select("doc_id", "text").mapInArrow(_printed, PRINTED)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _reach(fp: np.ndarray, radius: int) -> np.ndarray:
    """The first member of each one's component within one group, compared in full.

    What is reached leaves the comparison, so a dense group costs little more than its size.
    """
    label = np.empty(len(fp), dtype=np.int64)
    rest = np.arange(len(fp))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        label[seed], front = seed, [seed]
        while front and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[front.pop()]) <= radius
            got, rest = rest[near], rest[~near]
            label[got] = seed
            front += got.tolist()
    return label


def _links(key: np.ndarray, fp: np.ndarray, stored: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole groups; rows are in order of key."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    held = np.add.reduceat(stored.astype(np.int64), cut)
    work = held * size
    large = np.flatnonzero((work > PAIRS) & (size > 1))
    for g in large.tolist():
        part = np.unique(fp[cut[g] : cut[g] + size[g]])
        root = part[_reach(part, radius)]
        yield part[part != root], root[part != root]
    small = np.flatnonzero((held > 0) & (size > 1) & (work <= PAIRS))
    turn = (np.cumsum(work[small]) - 1) // PAIRS
    for groups in np.split(small, np.flatnonzero(np.diff(turn)) + 1) if len(small) else []:
        rows = _ranges(cut[groups], size[groups])
        own = rows[stored[rows]]
        of = np.searchsorted(cut, own, "right") - 1
        left = np.repeat(own, size[of])
        right = _ranges(cut[of], size[of])
        x = fp[left] ^ fp[right]
        near = (x != 0) & (np.bitwise_count(x) <= radius)
        left, right = left[near], right[near]
        if len(left):
            nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
            label = spanning(at[: len(left)], at[len(left) :], len(nodes))
            moved = label != np.arange(len(nodes))
            yield fp[nodes[moved]], fp[nodes[label[moved]]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, stored) sorted by key to links; a group may span batches."""
    for key, fp, stored in whole_groups(batches):
        for u, v in _links(key, fp.view(np.uint64), stored, RADIUS):
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """The columns of many whole groups at a time, from rows in order of the first column."""
    parts: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        parts.append(now)
        n += batch.num_rows
        # One group that fills many batches is put together once, when it ends.
        if n >= rows and parts[0][0][0] != now[0][-1]:
            left = [np.concatenate(p) for p in zip(*parts, strict=True)]
            whole = int(np.searchsorted(left[0], left[0][-1], "left"))
            yield [p[:whole] for p in left]
            parts, n = [[p[whole:] for p in left]], n - whole
    if parts:
        yield [np.concatenate(p) for p in zip(*parts, strict=True)]


def _lookups(value: str, bits: int, near: int) -> str:
    """SQL for an array of (value, stored) under which values within near bits meet.

    For one bit, of two values the one with the zero there looks up the other; for two, both are
    stored under all values within one bit.
    """
    own = f"array(named_struct('value', {value}, 'stored', true))"
    if not near:
        return own
    flips = f"sequence(0, {bits - 1})" if near == 2 else f"filter(sequence(0, {bits - 1}), i -> shiftright({value}, i) & 1 = 0)"
    changed = f"{value} ^ shiftleft(1L, i)"
    return f"concat({own}, transform({flips}, i -> named_struct('value', {changed}, 'stored', {'true' if near == 2 else 'false'})))"


def _keys(parts: tuple[tuple[int, int], ...], column: str) -> str:
    """SQL for an array of (part, value, stored, rest) of a column's keys; rest: the bits of the other parts."""
    found, low = [], 0
    for t, (bits, near) in enumerate(parts):
        value = f"(shiftrightunsigned({column}, {low}) & {(1 << bits) - 1}L)"
        above = f"shiftleft(shiftrightunsigned({column}, {low + bits}), {low})" if low + bits < 64 else "0L"
        rest = f"(({column} & {(1 << low) - 1}L) | {above})"
        found.append(f"transform({_lookups(value, bits, near)}, k -> named_struct('part', {t}, 'value', k.value, 'stored', k.stored, 'rest', {rest}))")
        low += bits
    return f"concat({', '.join(found)})"


def parts_of(bits: int) -> tuple[tuple[int, int], ...]:
    """(bits, near) of three parts: four differing bits leave one of them within its ball."""
    third = bits // 3
    return ((bits - 2 * third, 1), (third, 1), (third, 0))


def _cut(rows: DataFrame, parts: tuple[tuple[int, int], ...]) -> DataFrame:
    """key, fp, stored, rest: rows under their keys and their old key. Keys are hashes; what meets by chance is told apart by its distance."""
    cut = rows.select("key", "fp", F.explode(F.expr(_keys(parts, "rest"))).alias("k"))
    return cut.select(F.xxhash64("key", "k.part", "k.value").alias("key"), "fp", F.col("k.stored").alias("stored"), F.col("k.rest").alias("rest"))


def _met(rows: DataFrame, bits: int, hot: int, cuts: int) -> DataFrame:
    """Links of the rows' groups; a crowded key is cut by the bits that its part leaves."""
    meet = lambda df: df.select("key", "fp", "stored").repartition("key").sortWithinPartitions("key").mapInArrow(_matched, LINKS)
    if not cuts:
        return meet(rows)
    crowded = rows.where("stored").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key").checkpoint()
    if crowded.isEmpty():
        return meet(rows)
    parts = parts_of(bits)
    # Under a part's key any two rows may be a link, so all count as stored.
    inner = _cut(rows.join(crowded, "key"), parts).withColumn("stored", F.lit(True))
    return meet(rows.join(crowded, "key", "left_anti")).union(_met(inner, bits - parts[-1][0], hot, cuts - 1))


def links(prints: DataFrame, hot: int = HOT, many: int = MANY) -> DataFrame:
    """u, v: a spanning forest of the links for each key, over distinct fingerprints (column fp)."""
    parts = parts_of(64) if prints.count() <= many else ((32, 2), (32, 2))
    rows = _cut(prints.select(F.lit(0).alias("key"), "fp", F.col("fp").alias("rest")), parts)
    return _met(rows, 64 - parts[-1][0], hot, CUTS)


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    # Salts go by row, so that rows without an id, or of one id, are spread too.
    salted = stash(fingerprints(docs).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    parts = salted.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    nodes = stash(parts.groupBy("fp").agg(F.min("least").alias("least")))
    # Roots are fingerprints; the component's id is the smallest doc_id of its nodes.
    roots = components(links(nodes.select("fp"), hot)).withColumnRenamed("node", "fp")
    at = nodes.join(roots, "fp")
    ids = at.groupBy("root").agg(F.min("least").alias("component_id"))
    # A component may be large: its id meets its nodes in salted parts.
    ids = ids.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = at.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    # Merged, so that both sides are dealt out by part; a broadcast would send a root's rows on from the one task that made them.
    named = nodes.join(at.hint("merge").join(ids, ["root", "part"]).select("fp", "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    by_part = parts.select("fp", "salt").join(named, "fp")
    found = salted.hint("merge").join(by_part, ["fp", "salt"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
