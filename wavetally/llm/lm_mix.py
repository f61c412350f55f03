"""Language-model scoring by online logistic mixing of context predictors.

A text is a sequence of tokens (lower-case words, then one end). Each frequent token
is a path of bits in a Huffman tree over the training counts; any other token is the
path of an escape leaf, followed by its share among the rare tokens. Each bit is
predicted by several models: counts under hashed contexts (the class of the last word; the classes of the last two; the last two of
the most frequent words, which tell the language and the sentence's frame), each
shrunk to the node's own frequency. A gate, chosen by the depth in the tree and by how
much the best context has seen, picks the weights that mix the predictions in the
logistic domain. The weights start from constants and are refined online
in each document: a document's tokens are coded in blocks of at most LONGEST_BLOCK, and
each block's errors move the weights for the next, so a block's probability never depends
on itself. The sum over all bits is the text's probability and its bits per byte.

Coding whole tokens instead of bytes takes about a sixth of the binary decisions; the
result is a proper distribution over the known tokens and one class of unknown ones,
the same event space as an add-one unigram model.

Token counts and context counts cover all training text. Bounds that do not grow with
the corpus, each measured in README: HEAD frequent tokens in the tree, of which each was
seen LEAST times, and 2 ** TABLE_BITS counters for each context. Every node of a path is
mixed. Counts of rare tokens stay in a distributed table and are joined.

Defined cases: a null text counts as empty and is the end token alone; null doc_ids are
training rows; repeated rows are counted and scored each; without training text every
token is unknown and every score 0; a text of any length is coded whole (one that is longer
than a slice by itself); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import kth_largest, stash

HEAD = 1 << 18
#: Least training count of a token in the tree.
LEAST = 4
TABLE_BITS = 20
CONTEXTS = 3
CLASSES, FREQUENT = 512, 64
MOST_KEYS = max(2 * CLASSES + 1, 64 * 64, (FREQUENT + 1) ** 2)
#: Pseudo-counts with which a context starts at its node's own frequency.
SHRINK = 4.0
#: Tokens in a document's first block; each further one is as long as all before it, up to the longest.
FIRST_BLOCK, LONGEST_BLOCK = 8, 512
#: Bits that the first weights count for against a document's own.
INERTIA = 100.0
#: Bytes of text that a worker splits at a time, tokens that it mixes at a time, tokens whose pairs of context and leaf
#: it gathers, pairs that it counts at a time, and entries of its partial counts.
SPLIT_BYTES, SLICE_TOKENS, COUNTED_TOKENS, COUNTED_PAIRS, PARTIAL = 1 << 23, 16_000, 2_000_000, 250_000, 250_000
DEPTHS, SEEN = 8, 4
GATES, INPUTS = DEPTHS * SEEN, CONTEXTS
BLOCK_BITS = 14
#: Training tokens for one partial sum of a context table.
TOKENS_A_SUM = 1 << 22
#: First weights of a gate's inputs by how much the best context has seen: the more, the more their agreement
#: may add up to. Online steps refine them in each document.
FIRST_WEIGHTS = ((0.37, 0.37, 0.37), (0.4, 0.4, 0.4), (0.5, 0.5, 0.5), (0.48, 0.48, 0.48))

#: Bits of a path's step below the node: the depth and the bit.
STEP_BITS = DEPTHS.bit_length()

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: CRC-32 of one byte, as zlib's tables have it.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))

COUNTED = "token binary, n bigint"
TABLES = "context int, block int, part int, width int, data binary"
SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_bytes bigint, n_known bigint, head_log10 double, path_log10 double, rare array<binary>, rare_n array<bigint>"


@dataclass
class Tokens:
    """Some documents' tokens, as places in an array of different ones."""

    different: pa.Array
    place: np.ndarray
    sizes: np.ndarray  # of each document
    ids: np.ndarray | None = None  # of the different ones, in the tree
    classes: np.ndarray | None = None

    @classmethod
    def listed(cls, docs: list[list[bytes]]) -> Tokens:
        coded = pa.array([t for d in docs for t in d], pa.binary()).dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy(), np.array([len(d) for d in docs], dtype=np.int64))

    @classmethod
    def split(cls, texts: pa.Array) -> Tokens:
        """Words between ASCII white space with A-Z lowered; each document closes with the end token, the empty word."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()  # with empty words where white space begins or ends a text
        different, words, end = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
        offsets = np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        if end < 0:
            different, end = pa.concat_arrays([different, pa.array([b""], pa.binary())]), len(different)
            sizes = np.diff(offsets).astype(np.int64) + 1
        else:
            filled = words != end
            before = np.concatenate([[0], np.cumsum(filled, dtype=np.int32)])
            sizes, words = np.diff(before[offsets]).astype(np.int64) + 1, words[filled]
        place = np.full(int(sizes.sum()), end, dtype=np.int32)
        word = np.ones(len(place), dtype=bool)
        word[np.cumsum(sizes) - 1] = False
        place[word] = words
        return cls(different, place, sizes)

    def looked_up(self, tree: Tree) -> Tokens:
        ids = pc.fill_null(pc.index_in(self.different, value_set=tree.index), tree.escape).to_numpy().astype(np.int64)
        classes = tree.classes[ids]
        rare = np.flatnonzero(ids == tree.escape)
        classes[rare] = word_classes(self.different, rare)
        return Tokens(self.different, self.place, self.sizes, ids, classes)

    def slices(self) -> Iterator[tuple[int, Tokens]]:
        """A bounded number of tokens (at least one document) at a time, with the first document's number."""
        ends = np.cumsum(self.sizes)
        for a, b in _runs(ends, SLICE_TOKENS):
            first = int(ends[a - 1]) if a else 0
            yield a, Tokens(self.different, self.place[first : ends[b - 1]], self.sizes[a:b], self.ids, self.classes)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items, given their sizes' prefix sums, that each end with the item that reaches the bound."""
    a = 0
    while a < len(ends):
        b = min(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)) + 1, len(ends))
        yield a, b
        a = b


def _split(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Tokens]]:
    """Rows with their texts' bytes and tokens, a bounded number of bytes (at least one document) at a time."""
    for batch in batches:
        n_bytes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        for a, b in _runs(np.cumsum(n_bytes), SPLIT_BYTES):
            rows = batch.slice(a, b - a)
            yield rows, n_bytes[a:b], Tokens.split(rows.column(column))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    for _, _, tokens in _split(batches, 0):
        for token, n in zip(tokens.different.to_pylist(), np.bincount(tokens.place).tolist(), strict=True):
            counts[token] = counts.get(token, 0) + n
        if len(counts) > PARTIAL:
            yield out()
            counts.clear()
    yield out()


@dataclass
class Tree:
    """Huffman paths of the head tokens and, last, of the escape leaf."""

    index: pa.Array  # the head tokens
    log_count: np.ndarray  # log10(count + 1) of each head token
    start: np.ndarray
    length: np.ndarray
    steps: np.ndarray  # of each path: the nodes, then STEP_BITS of depth (below DEPTHS) and bit
    shrunk: np.ndarray  # [node, bit] pseudo-counts with which its contexts start
    classes: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.log_count)


def word_class(token: bytes) -> int:
    """The class of a word that is not among the CLASSES most frequent: by its ending."""
    return CLASSES + zlib.crc32(token[-3:]) % CLASSES


def word_classes(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """word_class of the words at some places of a binary array."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    begin, end = bounds[at], bounds[at + 1]
    crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    for back in (3, 2, 1):
        own = np.flatnonzero(end - back >= begin)
        crc[own] = _CRC[(crc[own] ^ data[end[own] - back]) & 255] ^ (crc[own] >> 8)
    return CLASSES + (~crc % CLASSES).astype(np.int64)


def build_tree(head: list[tuple[bytes, int]], rare: int) -> Tree:
    """head: tokens and counts, most frequent first; rare: occurrences of all other tokens."""
    weights = [c for _, c in head] + [rare + 1]
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    node_weight: list[tuple[int, int]] = []
    n = len(weights)
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, n + len(children)))
        children.append((left, right))
        node_weight.append((a, b))
    start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    nodes: list[int] = []
    bits: list[int] = []
    odds = np.array([math.log((b + 0.5) / (a + 0.5)) for a, b in node_weight] or [0.0])
    # (tree node, path so far as a linked list)
    stack: list[tuple[int, tuple]] = [(heap[0][1], ())]
    while stack:
        at, path = stack.pop()
        if at >= n:
            stack += [(child, ((at - n, b), path)) for b, child in enumerate(children[at - n])]
            continue
        own = []
        while path:
            own.append(path[0])
            path = path[1]
        start[at], length[at] = len(nodes), len(own)
        nodes += [k for k, _ in reversed(own)]
        bits += [b for _, b in reversed(own)]
    order = np.argsort(start, kind="stable")
    depths = np.minimum(np.arange(len(nodes)) - np.repeat(start[order], length[order]), DEPTHS - 1)
    classes = np.array([i if i < CLASSES else word_class(t) for i, (t, _) in enumerate(head)] + [0], dtype=np.int64)
    return Tree(
        pa.array([t for t, _ in head], pa.binary()),
        np.array([math.log10(c + 1) for _, c in head]),
        start,
        length,
        (np.array(nodes, dtype=np.int32) << STEP_BITS) + depths.astype(np.int32) * 2 + np.array(bits, dtype=np.int32),
        np.stack([SHRINK / (1 + np.exp(odds)), SHRINK / (1 + np.exp(-odds))], axis=1).astype(np.float32),
        classes,
    )


def contexts(tokens: Tokens, tree: Tree) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each token's leaf, and its key in each context, below MOST_KEYS."""
    escape, pad, sizes = tree.escape, 2, tokens.sizes
    total = int(sizes.sum())
    begin = np.cumsum(sizes + pad) - sizes
    own = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
    ids = np.full(total + pad * len(sizes), escape, dtype=np.int64)
    classes = np.full(len(ids), 2 * CLASSES, dtype=np.int64)
    ids[own], classes[own] = tokens.ids[tokens.place], tokens.classes[tokens.place]
    padding = np.ones(len(ids), dtype=bool)
    padding[own] = False
    frequent = np.where(padding, FREQUENT, np.where(ids < min(FREQUENT, escape), ids, -1))
    last = np.maximum.accumulate(np.where(frequent >= 0, np.arange(len(ids)), 0))
    one, two = classes[own - 1], classes[own - 2]
    f1 = last[own - 1]
    f2 = last[np.maximum(f1 - 1, 0)]
    return ids[own], [one, one % 64 * 64 + two % 64, frequent[f1] * (FREQUENT + 1) + frequent[f2]]


def start_key(context: int, keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) + np.uint64((context + 1) << 24)) * _M1


def slots_of(started: np.ndarray, mixed: np.ndarray, table_bits: int) -> np.ndarray:
    """The places of bits in a context's table; overwrites started, their keys. mixed: their nodes times _M2."""
    started ^= mixed
    started *= _M3
    started >>= np.uint64(64 - table_bits)
    return started.view(np.int64)


def gathered(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], in less than half the time; every place must be one of values."""
    return values.take(at, mode="wrap")


class Coded:
    """The bits of some documents, with the slots of their contexts."""

    def __init__(self, docs: Tokens | list[list[bytes]], tree: Tree, table_bits: int):
        tokens = docs if isinstance(docs, Tokens) else Tokens.listed(docs).looked_up(tree)
        sizes = tokens.sizes
        self.ids, keys = contexts(tokens, tree)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.doc, self.sizes = doc, sizes
        # The bits come block by block, and in each block document by document.
        doubled = np.where(place < FIRST_BLOCK, 0, np.log2(np.maximum(place, 1) / FIRST_BLOCK).astype(np.int64) + 1)
        block = np.where(place < LONGEST_BLOCK, doubled, int(math.log2(LONGEST_BLOCK / FIRST_BLOCK)) + place // LONGEST_BLOCK)
        last = block == np.repeat(block[np.cumsum(sizes) - 1], sizes)
        turn = block * 2 + last  # after its last block a document's weights are not needed
        order = np.argsort(turn, kind="stable")
        ordered = self.ids[order]
        self.length = tree.length[ordered]
        stops = np.cumsum(self.length)
        at = np.repeat(tree.start[ordered] - (stops - self.length), self.length)
        at += np.arange(len(at))
        self.steps = gathered(tree.steps, at)
        self.node, self.bit = (self.steps >> STEP_BITS).astype(np.int64), (self.steps & 1).astype(np.int8)
        self.ordered = doc[order]
        turn = turn[order]
        turns = np.flatnonzero(np.diff(turn)) + 1
        self.cuts = [0, *(stops[turns - 1].tolist()), len(self.node)]
        self.learns = (turn[[0, *turns.tolist()]] % 2 == 0).tolist()
        mixed = self.node.view(np.uint64) * _M2
        self.slots = [slots_of(np.repeat(start_key(j, key[order]), self.length), mixed, table_bits) for j, key in enumerate(keys)]

    @property
    def depth(self) -> np.ndarray:
        return np.arange(len(self.node)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def inputs(self, tree: Tree, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[INPUTS, bit] predictions as log odds, and each bit's gate in its document."""
        x = np.empty((INPUTS, len(self.node)), dtype=np.float32)
        start = gathered(tree.shrunk.view(np.float64).ravel(), self.node).view(np.float32).reshape(-1, 2)
        for j, table in enumerate(tables):
            counts = gathered(table.view(np.float64).reshape(-1), self.slots[j]).view(np.float32).reshape(-1, 2)
            both = counts + start
            np.divide(both[:, 1], both[:, 0], out=x[j])
        np.log(x, out=x)
        seen = counts[:, 0] + counts[:, 1]
        level = (seen >= 4).view(np.int8)
        for least in (32, 512):
            level += (seen >= least).view(np.int8)
        gate = np.repeat(self.ordered * GATES, self.length)
        gate += ((self.steps >> 1) & DEPTHS - 1) * SEEN
        gate += level
        return x, gate


def _trained(batches: Iterator[pa.RecordBatch], tree, table_bits: int) -> Iterator[pa.RecordBatch]:
    """This task's counts of each context table, in compressed blocks."""
    from pyspark import TaskContext

    tree = tree.value
    leaves = tree.escape + 1
    order = np.argsort(tree.start, kind="stable")  # the leaves from one side of the tree to the other
    rank = np.empty_like(order)
    rank[order] = np.arange(leaves)
    tables = [np.zeros(2 << table_bits, dtype=np.int64) for _ in range(CONTEXTS)]
    seen: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]

    def count() -> None:
        """Adds the paths of each different pair of a key and a leaf, as often as it was seen.

        Pairs are in order of key and of the leaf's place in the tree, so at each depth those paths of one length that
        share a node and a bit follow each other and are added up before the table is touched.
        """
        for j, (table, pairs) in enumerate(zip(tables, seen, strict=True)):
            different, times = np.unique(np.concatenate(pairs), return_counts=True)
            for a in range(0, len(different), COUNTED_PAIRS):
                key, place = np.divmod(different[a : a + COUNTED_PAIRS], leaves)
                leaf, key, n = order[place], start_key(j, key), times[a : a + COUNTED_PAIRS]
                length = tree.length[leaf].astype(np.int16)
                by_length = np.argsort(length, kind="stable")  # so that paths end together
                ends = np.cumsum(np.bincount(length)).tolist()
                for long, (c, d) in enumerate(itertools.pairwise(ends), 1):
                    if c == d:
                        continue
                    own = by_length[c:d]
                    keys, ns, at = key[own], n[own], tree.start[leaf[own]]
                    other = np.concatenate([[True], keys[1:] != keys[:-1]])
                    for depth in range(long):
                        step = gathered(tree.steps, at + depth)
                        new = other.copy()
                        new[1:] |= step[1:] != step[:-1]
                        first = np.flatnonzero(new)
                        bits = step[first].astype(np.int64)
                        slot = slots_of(keys[first], (bits >> STEP_BITS).view(np.uint64) * _M2, table_bits)
                        np.add.at(table, slot * 2 + (bits & 1), np.add.reduceat(ns, first))
            pairs.clear()

    n = 0
    narrow = np.int32 if MOST_KEYS * leaves < 1 << 31 else np.int64
    for _, _, tokens in _split(batches, 0):
        for _, some in tokens.looked_up(tree).slices():
            ids, keys = contexts(some, tree)
            for pairs, key in zip(seen, keys, strict=True):
                pairs.append((key * leaves + rank[ids]).astype(narrow))
            n += len(ids)
            if n >= COUNTED_TOKENS:
                count()
                n = 0
    if n:
        count()
    part = TaskContext.get().partitionId()
    for j, table in enumerate(tables):
        for b, block in enumerate(table.reshape(-1, min(1 << BLOCK_BITS, len(table)))):
            if block.any():
                yield _block(j, b, part, block)


def _block(context: int, block: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    width = next(w for w in (2, 4, 8) if not int(counts.max()) >> 8 * w)  # bytes that hold every count
    data = zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)
    return pa.record_batch(
        [pa.array([context], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())],
        names=["context", "block", "part", "width", "data"],
    )


def _counts(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=f"<u{width}").astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks that follow each other under one key; holds one block at a time."""
    key, total = None, None
    for batch in batches:
        for context, block, part, width, data in zip(*(batch.column(i) for i in range(5)), strict=True):
            now = (context.as_py(), block.as_py(), part.as_py())
            counts = _counts(width.as_py(), data.as_py())
            if now == key:
                total += counts
            else:
                if key:
                    yield _block(*key, total)
                key, total = now, counts
    if key:
        yield _block(*key, total)


def context_tables(train: DataFrame, tree, table_bits: int, fan: int) -> list[np.ndarray]:
    """For each context [slot, bit] counts over all training text, summed in two steps of partial sums: first in `fan` parts."""
    parts = train.select("text").mapInArrow(partial(_trained, tree=tree, table_bits=table_bits), TABLES)
    keys = ["context", "block", "part"]
    some = parts.withColumn("part", F.col("part") % fan).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_summed, TABLES)
    whole = some.withColumn("part", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_summed, TABLES)
    size = min(1 << BLOCK_BITS, 2 << table_bits)
    tables = [np.zeros(2 << table_bits, dtype=np.float32) for _ in range(CONTEXTS)]
    for row in whole.toLocalIterator():  # as many blocks as the tables have, which are of fixed size
        tables[row["context"]][row["block"] * size : (row["block"] + 1) * size] = _counts(row["width"], row["data"])
    return [t.reshape(-1, 2) for t in tables]


def first_weights() -> np.ndarray:
    """[GATES, INPUTS]"""
    return np.tile(np.array(FIRST_WEIGHTS), (DEPTHS, 1))


def code(coded: Coded, tree: Tree, tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """log10 probability of each document's paths; the weights follow each document's own bits."""
    docs = len(coded.sizes)
    cells = docs * GATES
    cost = np.zeros(cells)
    x, cell = coded.inputs(tree, tables)
    own = [np.tile(weights[:, i].astype(np.float32), docs) for i in range(INPUTS)]
    seen = np.full(cells, INERTIA)
    signs = (1 - 2 * coded.bit).astype(np.float32)
    for (a, b), learns in zip(itertools.pairwise(coded.cuts), coded.learns, strict=True):
        at, sign = cell[a:b], signs[a:b]
        z = gathered(own[0], at) * x[0, a:b]
        for i in range(1, INPUTS):
            z += gathered(own[i], at) * x[i, a:b]
        z *= sign  # log odds against the bit that comes
        np.clip(z, -15, 15, out=z)
        odds = np.exp(z, out=z)
        whole = 1 + odds
        cost += np.bincount(at, np.log(whole), cells)
        if learns:
            error = np.divide(odds, whole, out=whole)
            error *= sign
            seen += np.bincount(at, minlength=cells)
            for i in range(INPUTS):
                own[i] -= (np.bincount(at, error * x[i, a:b], cells) / (INPUTS * seen)).astype(np.float32)
    return -cost.reshape(docs, GATES).sum(axis=1) / math.log(10)


def _scored(batches: Iterator[pa.RecordBatch], tree, tables, weights: np.ndarray, table_bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    tree, row = tree.value, TaskContext.get().partitionId() << 40
    log_count = np.append(tree.log_count, 0.0)
    for rows, n_bytes, tokens in _split(batches, 1):
        for first, some in tokens.looked_up(tree).slices():
            coded, n = Coded(some, tree, table_bits), len(some.sizes)
            escaped = np.flatnonzero(coded.ids == tree.escape)
            pairs, times = np.unique(coded.doc[escaped] * len(some.different) + some.place[escaped], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(some.different)).astype(np.int32))
            columns = {
                "row": pa.array(np.arange(row, row + n)),
                "doc_id": rows.column(0).slice(first, n),
                "n_tokens": pa.array(coded.sizes),
                "n_bytes": pa.array(n_bytes[first : first + n]),
                "n_known": pa.array(np.bincount(coded.doc, coded.ids < tree.escape, n).astype(np.int64)),
                "head_log10": pa.array(np.bincount(coded.doc, log_count[coded.ids], n)),
                "path_log10": pa.array(code(coded, tree, tables.value, weights)),
                "rare": pa.ListArray.from_arrays(offsets, some.different.take(pa.array(pairs % len(some.different)))),
                "rare_n": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
            }
            row += n
            yield pa.record_batch(list(columns.values()), names=list(columns))


def score(docs: DataFrame, training: Column, head: int = HEAD, table_bits: int = TABLE_BITS) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    training: which rows the model learns from. base_score is the add-one unigram log10 probability.
    """
    spark = docs.sparkSession
    train = docs.where(training)
    vocabulary = stash(train.select("text").mapInArrow(_counted, COUNTED).groupBy("token").agg(F.sum("n").alias("c")))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    least = kth_largest(vocabulary.withColumn("x", F.col("c").cast("double")), "x", head) or 0
    if vocabulary.where(F.col("c") >= least).count() > head:  # of tokens that tie at the end, none
        least += 1
    frequent = F.col("c") >= F.lit(max(LEAST, int(least)))
    top = sorted(((bytes(r["token"]), r["c"]) for r in vocabulary.where(frequent).collect()), key=lambda r: (-r[1], r[0]))  # at most head rows
    rare_total, rare_distinct = total - sum(c for _, c in top), distinct - len(top)
    tree = spark.sparkContext.broadcast(build_tree(top, rare_total))
    tables = spark.sparkContext.broadcast(context_tables(train, tree, table_bits, fan=math.isqrt(total // TOKENS_A_SUM) + 1))
    scored = stash(docs.select("doc_id", "text").mapInArrow(partial(_scored, tree=tree, tables=tables, weights=first_weights(), table_bits=table_bits), SCORED))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("n"))
    counted = each.join(vocabulary.where(~frequent), "token", "left")
    log10 = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rare = counted.groupBy("row").agg(F.sum(F.col("n") * log10).alias("rare_log10"), F.sum("n").alias("n_rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    found = scored.drop("rare", "rare_n").join(rare, "row", "left").fillna(0, ["rare_log10", "n_rare", "rare_known"])
    base = F.col("head_log10") + F.col("rare_log10") - F.col("n_tokens") * math.log10(total + distinct + 1)
    own = F.col("path_log10") + F.col("rare_log10") - F.col("n_rare") * math.log10(rare_total + rare_distinct + 1)
    return found.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        own.alias("score"),
        (-own * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
