"""Near copies by the similarity of word shingles, found by multi-index hashing of wide SimHash fingerprints.

Two documents are near copies when their sets of SHINGLE-word shingles have a Jaccard
similarity of SIMILARITY or more. A 64-bit fingerprint can't tell that (at 0.8 its
bits differ with probability 0.15), so fingerprints are as wide as it takes: they hold
a number of segments, and 128 bits beside them. In each segment a document is stored
under its value and all values within one bit, so that what differs there by up to two
bits meets under a key; there are as many segments as bring a pair of the least
similarity together with probability RECALL. Rows are dealt out by a segment's first
BUCKET_BITS bits; the ball over its other bits is enumerated where they arrive.

What meets is compared by the other 128 bits, and each key's likely links are passed on
as a spanning forest, never as all pairs. The components of these make clusters, within
which all pairs are compared: by long fingerprints, then exactly, by the shingles of
whole texts, the nearest first and only while the two lie in different components. A
cluster of more than BLOCK documents is dealt out in pairs of blocks, so that a task
holds two blocks of it at most; under one key a task holds 32 bytes a document.

Defined cases: null texts count as empty; fewer words than a shingle make one shingle,
so texts without words are copies of each other; a text of any length is read whole;
repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import keyed, stash
from wavetally.llm.components import components
from wavetally.llm.simhash import spanning, whole_groups

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
#: Bits of a segment, while no more documents than 2 ** MANY_BITS share its values, and those that deal rows out.
SEGMENT_BITS, MANY_BITS, BUCKET_BITS = 22, 26, 8
#: Words of the long fingerprint, documents of a block, and pairs that are verified before the rest is looked at again.
LONG, BLOCK, TURN = 16, 1024, 2048
#: Rows of a key up to which all pairs are compared at once.
SMALL = 64

FOUND = "node bigint, a bigint, b bigint, parts array<bigint>"
LINKS = "u bigint, v bigint"
DESCRIBED = "node bigint, long binary, shingles array<bigint>"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def bit_difference(similarity: float) -> float:
    """The probability that a fingerprint's bit differs between sets of one size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(bits: int, similarity: float) -> int:
    """The most differing bits that a pair of this similarity has, but for chance of about 1 in 1000."""
    p = bit_difference(similarity)
    return math.floor(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def layout(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, segments) for n documents."""
    bits = SEGMENT_BITS + max(0, (n - 1).bit_length() - MANY_BITS)
    p = bit_difference(similarity)
    meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return bits, 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles: [n, 2] words of their 128-bit hashes, in order of the first."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else np.zeros(1, np.int64)
    last = ends[shingle - 1 :] if len(words) >= shingle else np.array([len(joined)])
    digest = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return found[np.unique(found[:, 0], return_index=True)[1]]


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """words * 64 bits (0 or 1): set where over half of the shingles have them set."""
    columns = [hashes[:, 0], hashes[:, 1]]
    while len(columns) < words:
        x = (columns[-2] ^ (columns[-1] >> np.uint64(29))) * _MIX[0]
        columns.append((x ^ (x >> np.uint64(32))) * _MIX[1])
    counts = np.zeros(words * 64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = np.stack([c[at : at + (1 << 13)] for c in columns[:words]], axis=1)
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return (2 * counts > len(hashes)).astype(np.uint8)


def _printed(batches: Iterator[pa.RecordBatch], bits: int, segments: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """node, the 128 bits that are compared (a, b), and the segments' values."""
    words = -(-(128 + bits * segments) // 64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        n = batch.num_rows
        found = np.empty((n, words * 64), dtype=np.uint8)
        for i, text in enumerate(batch.column(1)):
            found[i] = wide_fingerprint(shingle_hashes(text.as_py(), shingle), words)
        check = np.packbits(found[:, :128], axis=1).view(np.int64).reshape(n, 2)
        values = found[:, 128 : 128 + bits * segments].reshape(n, segments, bits).astype(np.int64) @ weights
        parts = pa.ListArray.from_arrays(pa.array(np.arange(0, n * segments + 1, segments, dtype=np.int32)), pa.array(values.ravel()))
        yield pa.record_batch([batch.column(0), pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy()), parts], names=["node", "a", "b", "parts"])


def _dealt(prints: DataFrame, bits: int, first: int, last: int) -> DataFrame:
    """bucket, value, own, comp, node, a, b: rows under their segments' values (from first to last) and those with one of the bits changed that deal rows out."""
    rest = bits - BUCKET_BITS
    row = lambda value, own: f"named_struct('bucket', shiftleft(bigint(s), {BUCKET_BITS}) + shiftright({value}, {rest}), 'value', {value}, 'own', {own})"
    changed = f"transform(sequence({rest}, {bits - 1}), i -> {row('parts[s] ^ shiftleft(1L, i)', 'false')})"
    keys = F.expr(f"flatten(transform(sequence({first}, {last}), s -> concat(array({row('parts[s]', 'true')}), {changed})))")
    return prints.select(F.explode(keys).alias("k"), "comp", "node", "a", "b").select("k.bucket", "k.value", "k.own", "comp", "node", "a", "b")


def _forest(key: np.ndarray, check: np.ndarray, near: int) -> np.ndarray:
    """For each row (in order of key) the first row that it reaches within its key over rows near to each other."""
    n = len(key)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, n])
    label = np.arange(n)
    small = np.repeat(size <= SMALL, size)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    at, d = np.flatnonzero(small), 1
    while len(at):
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        hit = at[np.bitwise_count(check[at] ^ check[at + d]).sum(axis=1, dtype=np.int64) <= near]
        links.append((hit, hit + d))
        d += 1
    if links:
        left, right = (np.concatenate(x) for x in zip(*links, strict=True))
        nodes, back = np.unique(np.concatenate([left, right]), return_inverse=True)
        label[nodes] = nodes[spanning(back[: len(left)], back[len(left) :], len(nodes))]
    for a, m in zip(cut[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rest = np.arange(a, a + m)
        while len(rest):
            seed, rest = rest[0], rest[1:]
            front = [seed]
            while front and len(rest):  # what is reached leaves the comparison
                close = np.bitwise_count(check[rest] ^ check[front.pop()]).sum(axis=1, dtype=np.int64) <= near
                got, rest = rest[close], rest[~close]
                label[got] = seed
                front += got.tolist()
    return label


def _likely(batches: Iterator[pa.RecordBatch], bits: int, near: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, value, own, comp, node, a, b) in order of bucket to links between the components of what meets under a key and is near."""
    flips = np.concatenate([[0], 1 << np.arange(bits - BUCKET_BITS, dtype=np.int64)])
    for bucket, value, own, comp, node, *check in whole_groups(batches):
        own = own.astype(bool)
        key = (bucket >> BUCKET_BITS << bits) + value  # the value's own first bits are those of the bucket
        key = np.concatenate([(key[own][:, None] ^ flips).ravel(), key[~own]])
        row = np.concatenate([np.repeat(np.flatnonzero(own), len(flips)), np.flatnonzero(~own)])
        # Keys of one row need no look.
        turn = np.argsort(key, kind="stable")
        key, row = key[turn], row[turn]
        same = key[1:] == key[:-1]
        several = np.r_[same, False] | np.r_[False, same]
        key, row = key[several], row[several]
        turn = np.lexsort((node[row], key))
        key, row = key[turn], row[turn]
        label = _forest(key, np.stack([c[row] for c in check], axis=1).view(np.uint64), near) if len(key) else key
        pairs = np.stack([comp[row], comp[row[label]]], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])


def _described(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """A text's set of shingles and its long fingerprint."""
    for batch in batches:
        hashes = [shingle_hashes(text.as_py(), shingle) for text in batch.column(1)]
        ends = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
        values = np.concatenate([h[:, 0] for h in hashes]).view(np.int64) if hashes else np.zeros(0, np.int64)
        longs = [np.packbits(wide_fingerprint(h, LONG)).tobytes() for h in hashes]
        yield pa.record_batch([batch.column(0), pa.array(longs, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "long", "shingles"])


def verified(nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], near: int, similarity: float) -> list[tuple[int, int]]:
    """Links of similarity or more that span the components of all such pairs of a group."""
    n, size = len(nodes), np.array([len(s) for s in sets])
    pairs = []
    for i in range(n - 1):
        far = np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(axis=1, dtype=np.int64)
        hit = (far <= near) & (np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]))
        j = np.flatnonzero(hit)
        pairs.append(np.stack([np.full(len(j), i), j + i + 1, far[j]]).astype(np.int32))
    left, right, far = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int32)
    turn = np.argsort(far, kind="stable")
    left, right, label, out = left[turn], right[turn], np.arange(n), []
    while len(left):
        for i, j in zip(left[:TURN].tolist(), right[:TURN].tolist(), strict=True):
            if label[i] == label[j]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (size[i] + size[j] - common):
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
        open_ = label[left[TURN:]] != label[right[TURN:]]
        left, right = left[TURN:][open_], right[TURN:][open_]
    return out


def _verified(batches: Iterator[pa.RecordBatch], near: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Groups (group, node, long, shingles) in order of group to their links."""
    held: list[tuple] = []
    now = None

    def out() -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(r[1] for r in held), dtype=np.uint64).reshape(len(held), LONG)
        links = verified(np.array([r[0] for r in held]), prints, [r[2] for r in held], near, similarity)
        return pa.record_batch([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["u", "v"])

    for batch in batches:
        sets = batch.column(3)
        values, starts = sets.values.to_numpy(), sets.offsets.to_numpy()
        for i, (group, node, long) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if held and group != now:
                yield out()
                held.clear()
            now = group
            held.append((node, long, values[starts[i] : starts[i + 1]].copy()))
    if held:
        yield out()


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame | None:
    """u, v: verified links of rows (columns id, text) that give the components of all; None if nothing meets."""
    bits, segments = layout(texts.count(), similarity, recall)
    prints = stash(texts.select("id", "text").mapInArrow(partial(_printed, bits=bits, segments=segments, shingle=shingle), FOUND))
    meet = partial(_likely, bits=bits, near=reach(128, similarity))
    met = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, LINKS)
    # What the first segment joins is one row's affair in the others, so a dense group's links are passed on once.
    some = stash(components(met(_dealt(prints.withColumn("comp", F.col("node")), bits, 0, 0))))
    clusters = some
    if segments > 1:
        joined = prints.join(some, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        clusters = stash(components(met(_dealt(joined, bits, 1, segments - 1)).union(some.select(F.col("node").alias("u"), F.col("root").alias("v")))))
    if clusters.isEmpty():
        return None
    described = texts.join(clusters.select(F.col("node").alias("id")), "id", "left_semi").select("id", "text").mapInArrow(partial(_described, shingle=shingle), DESCRIBED)
    # A large cluster's blocks meet in pairs; which block a row is in goes by its hash.
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = clusters.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.select("node", "root", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    group = F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other"))
    groups = placed.select("node", group.alias("group")).join(described, "node").select("group", "node", "long", "shingles")
    check = partial(_verified, near=reach(64 * LONG, similarity), similarity=similarity)
    return stash(groups.repartition("group").sortWithinPartitions("group").mapInArrow(check, LINKS))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (none is last; ties by the other columns).

    Rows carry a key, so one goes or stays for itself, whether or not others share its doc_id.
    """
    rows = keyed(docs)
    edges = similar_links(rows.select(F.col("__row.id").alias("id"), "text"), similarity, recall, shingle)
    if edges is None:
        return docs
    ranked = rows.select(F.col("__row.id").alias("id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("rank"))
    at = stash(ranked.join(components(edges).withColumnRenamed("node", "id"), "id"))
    first = at.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.__row.id").alias("id"))
    gone = at.join(first, "id", "left_anti").select(F.col("id").alias("__gone"))
    return rows.join(gone, F.col("__row.id") == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
