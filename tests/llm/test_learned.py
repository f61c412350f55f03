"""Language model, toxicity, importance resampling: against brute force, by edge cases and held-out accuracy."""

import math
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from wavetally.llm import importance, lm_mix, queries, toxicity
from wavetally.llm.common import held_out, kth_largest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeiounstr") for _ in range(2 + i % 6)) for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(3, 80))), "en", "s", 0) for i in range(n)]


def test_language_model_counts_equal_brute_force(spark):
    rows = [*corpus(), (1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "A\tb\x0bC\n d e", "en", "s", 0), (1003, "zzzz " * 3000, "en", "s", 0), (1003, "zzzz " * 3000, "en", "s", 0), (None, "only here", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = held_out(F.col("doc_id"), 7, 2)
    got = lm_mix.score(docs, ~out, head=50, table_bits=12).withColumn("held_out", out).collect()
    assert len(got) == len(rows)
    words = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    twins = [r["score"] for r in got if r["doc_id"] == 1003]
    assert len(twins) == 2 and twins[0] == pytest.approx(twins[1])


def test_tokens_equal_plain_splitting():
    """Over all ASCII characters and some others, nulls, empty and blank texts, a slice of an array, and a long text."""
    rnd = random.Random(5)
    signs = [chr(i) for i in range(128)] + ["\u00c4", "\u00e9", "\u00a0", "\u2003", "\u212a", "\u0130", "\U0001f600"] + [" "] * 30
    texts = [None, "", " \t\n", *("".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(400)), "Word other " * 30_000, None]
    plain = [(t or "").encode().lower().split() + [b""] for t in texts]
    for array, want in ((pa.array(texts, pa.string()), plain), (pa.array(texts, pa.large_string()), plain), (pa.array(texts, pa.string()).slice(5, 50), plain[5:55])):
        got = lm_mix.Tokens.split(array)
        words = got.different.to_pylist()
        assert len(set(words)) == len(words)
        assert got.sizes.tolist() == [len(d) for d in want]
        assert [words[i] for i in got.place.tolist()] == [w for d in want for w in d]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(lm_mix._split(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for rows, _, _ in parts for i in rows.column(0).to_pylist()] == list(range(len(texts)))
    assert [n for _, sizes, _ in parts for n in sizes.tolist()] == [len((t or "").encode()) for t in texts]


def test_slices_hold_whole_documents():
    docs = [[b"a", b"b", b""], [b""], [b"c"] * lm_mix.SLICE_TOKENS + [b""], [b"a", b""], [b""]]
    tokens = lm_mix.Tokens.listed(docs)
    parts = list(tokens.slices())
    assert [first for first, _ in parts] == [0, 3]
    words = tokens.different.to_pylist()
    assert [words[i] for _, p in parts for i in p.place.tolist()] == [t for d in docs for t in d]
    assert [n for _, p in parts for n in p.sizes.tolist()] == [len(d) for d in docs]


def test_language_model_reads_no_other_columns(spark):
    """Extra columns with the names that the operator gives its own, a long text among short ones, repeated rows."""
    rows = [(i, t) for i, t, *_ in corpus(60)] + [(900, "long text of few words " * 20_000), (900, "long text of few words " * 20_000), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = plain.select("*", F.lit(1).alias("row"), F.lit("x").alias("token"), F.lit(2).alias("n"), F.lit(3).alias("c"), F.lit(4).alias("score"), F.lit(5).alias("rare"))
    got = [sorted(map(str, lm_mix.score(d, F.lit(True), head=30, table_bits=8).collect())) for d in (plain, clash)]
    assert len(got[0]) == len(rows) and got[0] == got[1]


def test_language_model_is_a_distribution():
    """One-token continuations of a text, over every head token and the escape, sum to one."""
    head = [(f"w{i}".encode(), 200 - i) for i in range(60)] + [(b"", 50)]
    tree = lm_mix.build_tree(sorted(head, key=lambda r: (-r[1], r[0])), 300)
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 9, (1 << 10, 2)).astype(np.float32) for _ in range(lm_mix.CONTEXTS)]
    weights = lm_mix.first_weights() + rng.normal(0, 0.1, (lm_mix.GATES, lm_mix.INPUTS))
    assert tree.shrunk.sum(axis=1) == pytest.approx(lm_mix.SHRINK)
    start = [b"w3", b"w9", b"never seen", b"w1"] * 12
    before = lm_mix.code(lm_mix.Coded([start], tree, 10), tree, tables, weights)[0]
    ends = [*tree.index, b"also never seen"]
    longer = lm_mix.code(lm_mix.Coded([[*start, t] for t in ends], tree, 10), tree, tables, weights)
    assert sum(10 ** (longer - before)) == pytest.approx(1.0, abs=2e-3)


def test_score_of_a_small_tree_equals_plain_arithmetic(spark):
    """Every document's score, bit by bit in plain Python: tree, contexts, mixing and the steps between blocks."""
    rows = corpus(40, seed=7)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["score"] for r in lm_mix.score(docs, F.col("doc_id") < 30, head=20, table_bits=8).collect()}
    words = lambda t: t.encode().lower().split() + [b""]
    counts = Counter(w for i, t, *_ in rows if i < 30 for w in words(t))
    enough = {w: c for w, c in counts.items() if c >= lm_mix.LEAST}
    least = sorted(enough.values(), reverse=True)[19]
    if sum(c >= least for c in enough.values()) > 20:
        least += 1
    top = sorted(((w, c) for w, c in enough.items() if c >= least), key=lambda r: (-r[1], r[0]))
    total, head = sum(counts.values()), sum(c for _, c in top)
    tree = lm_mix.build_tree(top, total - head)
    tables = [Counter() for _ in range(lm_mix.CONTEXTS)]

    def bits_of(text):
        """(place, node, bit, depth, slots) of one document."""
        coded = lm_mix.Coded([words(text)], tree, 8)
        places = np.repeat(np.arange(len(words(text))), tree.length[coded.ids])
        return list(zip(places.tolist(), coded.node.tolist(), coded.bit.tolist(), coded.depth.tolist(), *[s.tolist() for s in coded.slots], strict=True)), coded.ids

    for i, t, *_ in rows:
        if i < 30:
            for _, _, bit, _, *slots in bits_of(t)[0]:
                for table, slot in zip(tables, slots, strict=True):
                    table[slot, bit] += 1
    block = lambda place: 0 if place < 8 else int(math.log2(place / 8)) + 1  # noqa: E731  no text here reaches the longest
    for i, t, *_ in rows:
        own = [list(w) for w in lm_mix.first_weights()]
        seen, steps, now = [lm_mix.INERTIA] * lm_mix.GATES, [], 0
        coded, ids = bits_of(t)
        want = 0.0
        for place, node, bit, depth, *slots in coded:
            if block(place) != now:
                for g, _, _ in steps:
                    seen[g] += 1
                moved = {}
                for g, x, error in steps:
                    for k, v in enumerate(x):
                        moved[g, k] = moved.get((g, k), 0.0) + error * v
                for (g, k), v in moved.items():
                    own[g][k] += v / (lm_mix.INPUTS * seen[g])
                steps, now = [], block(place)
            start = tree.shrunk[node]
            pairs = [(table[slot, 0], table[slot, 1]) for table, slot in zip(tables, slots, strict=True)]
            x = [math.log((b + start[1]) / (a + start[0])) for a, b in pairs]
            n = sum(pairs[-1])
            gate = min(depth, lm_mix.DEPTHS - 1) * lm_mix.SEEN + (n >= 4) + (n >= 32) + (n >= 512)
            z = max(-15.0, min(15.0, sum(w * v for w, v in zip(own[gate], x, strict=True))))
            mixed = 1 / (1 + math.exp(-z))
            want += math.log10(mixed if bit else 1 - mixed)
            steps.append((gate, x, bit - mixed))
        rare = Counter(w for w, k in zip(words(t), ids.tolist(), strict=True) if k == tree.escape)
        spread = total - head + len(counts) - len(top) + 1
        want += sum(n * math.log10((counts[w] + 1) / spread) for w, n in rare.items())
        assert got[i] == pytest.approx(want, rel=1e-4), i


def test_language_model_beats_its_base(spark):
    """Text in which the last word tells much about the next."""
    rnd = random.Random(3)
    after = {i: [rnd.randrange(300) for _ in range(4)] for i in range(300)}
    rows = []
    for i in range(1500):
        word, words = rnd.randrange(300), []
        for _ in range(rnd.randrange(5, 60)):
            word = rnd.choice(after[word]) if rnd.random() < 0.8 else rnd.randrange(300)
            words.append(f"t{word}")
        rows.append((i, " ".join(words), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = held_out(F.col("doc_id"), 7, 2)
    rows = lm_mix.score(docs, ~out, head=1000, table_bits=14).withColumn("held_out", out).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0)], SCHEMA)
    (row,) = lm_mix.score(docs, F.lit(False), table_bits=8).collect()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["base_score"] == 0.0
    assert lm_mix.score(docs.limit(0), F.lit(True), table_bits=8).count() == 0


def maximal_segments(scores):
    """By the definition: the best segment (the shortest, then first), then the same left and right of it."""
    n = len(scores)
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(n) for b in range(a + 1, n + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return maximal_segments(scores[:a]) + [(a, b - 1)] + [(x + b, y + b) for x, y in maximal_segments(scores[b:])]


def test_segments_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        scores = [rnd.choice([-3.0, -1.0, -0.15, -0.15, 0.35, 2.0, 3.85]) + rnd.random() / 1000 for _ in range(rnd.randrange(1, 26))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for _, a, b in got] == maximal_segments(scores)
        assert all(s == pytest.approx(sum(scores[a : b + 1])) and s > 0 for s, a, b in got)
    assert toxicity.segments(np.zeros(0)) == []


def test_repeats_are_damped_nearby_only():
    log_odds = toxicity._Scores({"bad": 3.0, "mild": -1.0})
    tokens = ["bad"] * 4 + ["x"] * 100 + ["bad", "mild"]
    want = [3.0, 1.5, 1.0, 0.75] + [0.0] * 100 + [3.0, -1.0]
    assert toxicity.token_scores(tokens, log_odds) == pytest.approx(np.array(want) - toxicity.DRIFT)


def test_hierarchy_equals_its_formula():
    """Log-odds under the priors by hand, and that pruning changes no word's score by more than its bound."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    counts = {}
    for w in words:
        for f in toxicity.features(w):
            t, c = counts.get(f, (0, 0))
            counts[f] = (t + rnd.randrange(4), c + rnd.randrange(6))
    base = 100 / 300

    def rate(name):
        stem = name.rstrip("*")
        lower = [p for p in toxicity.PREFIXES if p < len(stem)]
        prior = rate(f"{stem[: lower[-1]]}*") if lower else base
        t, c = counts[name]
        return (t + 5 * prior) / (t + c + 5)

    odds = toxicity.hierarchy(counts, 100, 200, 5.0)
    for f in counts:
        assert odds[f] == pytest.approx(math.log(rate(f) / (1 - rate(f))) - math.log(0.5))
    whole, few = toxicity._Scores(odds), toxicity._Scores(toxicity.pruned(odds))
    assert all(abs(whole[w] - few[w]) <= toxicity.SAME for w in words)


def labelled(seed=2, n=600):
    rnd = random.Random(seed)
    plain = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randrange(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["Idiot!", "scum", "moron,", f"vequ{rnd.choice('abcdefgh')}{rnd.choice('xyz')}"])
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = labelled()
    df, lf = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(df, lf.where("doc_id % 5 > 0"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    test = [(i, t) for i, _, t in labels if i % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == bool(t) for i, t in test]) > 0.97
    extra = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 20000 + "idiot scum moron", "en", "s", 0), (None, "you idiot, scum and moron", "en", "s", 0)], SCHEMA)
    got = {r["doc_id"]: r for r in toxicity.score(extra, model).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["score"] > 0.5
    found = toxicity.passages(extra, model).where("doc_id = 3").collect()
    assert [(r["first_token"], r["last_token"]) for r in found] == [(20000, 20002)] and found[0]["p_value"] < 0.05
    # Equal passages at both ends, one behind scattered words of its kind, and one behind a repeated line.
    plain = [t for _, t, *_ in docs[1:5]]
    words = " ".join(plain).split()[:200]
    scattered = " ".join(w + (" idiot" if i % 150 == 75 else "") for i, w in enumerate(words * 6))
    texts = {10: "idiot scum moron " + " ".join(words) + " idiot scum moron", 11: scattered + " idiot scum moron", 12: ("one line of text again " * 300) + "idiot scum moron"}
    spans = {}
    for r in toxicity.passages(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA), model).collect():
        spans.setdefault(r["doc_id"], []).append((r["first_token"], r["last_token"]))
    for i, t in texts.items():
        n = len(t.split())
        assert any(a <= n - 3 and b == n - 1 and b - a < 8 for a, b in spans[i]), i
    assert any(a == 0 and 2 <= b < 8 for a, b in spans[10]) and len(spans[10]) == 2
    kept = toxicity.drop_toxic(df.withColumn("score", F.lit(1)), lf)
    assert kept.columns == [*df.columns, "score"] and 480 <= kept.count() <= 520


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 0)], SCHEMA)
    none = spark.createDataFrame([(1, 1, None)], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(df, toxicity.train(df, none)).collect()] == [0.0]
    assert toxicity.drop_toxic(df.limit(0), none).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in np.round(rng.normal(size=9000), 2)] + [5.0] * 6000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for k in (1, 5, 5999, 6000, 6001, 9000, 14999, 15000, 20000):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 15000) - 1]
    assert kth_largest(df, "x", 0) is None and kth_largest(df.limit(0), "x", 3) is None


def test_importance_weights_equal_brute_force(spark):
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(["good words here", "good words there", "### $$$ &&&", "bad bad bad bad", None, ""])]
    labels = [(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)]
    df, lf = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in importance.resample(df, lf, share=0.5).collect()}
    hashes, size = importance._Hashes(), importance.BUCKETS
    grams = {i: importance.grams(t, hashes) for i, t, *_ in docs}
    count = lambda ids: np.bincount(np.concatenate([grams[i] for i in ids]).astype(int), minlength=size)
    log = lambda c: np.log((c + 1) / (c.sum() + size))
    ratio = log(count([0, 1])) - log(count(range(6)))
    for i, g in grams.items():
        assert rows[i]["log_importance"] == pytest.approx(ratio[g.astype(int)].sum()) and rows[i]["n_grams"] == len(g)
    assert rows[4]["log_importance"] == rows[5]["log_importance"] == 0.0
    keys = sorted((r["key"] for r in rows.values()), reverse=True)
    assert sum(r["kept"] for r in rows.values()) == 3 and all(r["kept"] == (r["key"] >= keys[2]) for r in rows.values())
    assert importance.resample(df.limit(0), lf, share=0.5).count() == 0


def test_importance_keeps_good_documents(spark):
    rows = {r["doc_id"]: r["kept"] for r in queries.op10_importance_resampling(spark, "/root/testdata/sf0.01").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [rows[i] for i, q in quality.items() if q == 1]
    bad = [rows[i] for i, q in quality.items() if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_context_counts_equal_those_of_each_bit(spark):
    """Pairs of context and leaf that are counted once, over several tasks, give every bit's counts."""
    texts = [" ".join(f"w{(i * j) % (7 + i)}" for j in range(30)) for i in range(40)] * 2 + ["", "rare words here"]
    listed = [[*(w.encode() for w in t.split()), b""] for t in texts]
    counts: dict[bytes, int] = {}
    for token in (t for d in listed for t in d):
        counts[token] = counts.get(token, 0) + 1
    tree = lm_mix.build_tree(sorted(((t, n) for t, n in counts.items() if n > 1), key=lambda r: (-r[1], r[0])), 3)
    coded = lm_mix.Coded(listed, tree, 10)
    want = [np.bincount(slots * 2 + coded.bit, minlength=2 << 10).reshape(-1, 2) for slots in coded.slots]
    found = lm_mix.context_tables(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), spark.sparkContext.broadcast(tree), 10, fan=2)
    assert all((a == b).all() for a, b in zip(found, want, strict=True)) and want[0].sum() > 10000


def test_classes_of_words_equal_those_of_each_word():
    words = [b"", b"a", b"ab", b"abc", b"xabc", "é".encode(), "€éx".encode(), b"\xff\x00\x80", *(f"w{i}".encode() for i in range(300))]
    for array in (pa.array(words, pa.binary()), pa.array([b"skipped", *words], pa.binary()).slice(1)):
        at = np.arange(len(words))[::-1]
        assert lm_mix.word_classes(array, at).tolist() == [lm_mix.word_class(w) for w in words[::-1]]
    assert lm_mix.word_classes(pa.array([b""], pa.binary()), np.array([0])).tolist() == [lm_mix.word_class(b"")]
    assert not len(lm_mix.word_classes(pa.array([], pa.binary()), np.array([], dtype=np.int64)))


def test_a_worker_of_the_language_model_needs_little_memory(monkeypatch):
    """Peaks of numpy's and Python's memory and of Arrow's, beside the batch, while 30 MB of text are learned from and scored."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(60_000)]
    texts = [" ".join(words[i] for i in (60_000 * rng.random(500) ** 3).astype(int)) for _ in range(6_500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    head = [(w.encode(), 60_000 - i) for i, w in enumerate(words[:50_000])]
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    tree = SimpleNamespace(value=lm_mix.build_tree(head, 1000))
    tables = SimpleNamespace(value=[np.zeros((1 << 12, 2), dtype=np.float32) for _ in range(lm_mix.CONTEXTS)])
    jobs = {
        "trained": lambda: lm_mix._trained(iter([batch.select(["text"])]), tree, 12),
        "scored": lambda: lm_mix._scored(iter([batch]), tree, tables, lm_mix.first_weights(), 12),
    }
    peaks = {}
    usual = pa.default_memory_pool()
    for name, job in jobs.items():
        pool = pa.proxy_memory_pool(usual)
        pa.set_memory_pool(pool)
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in job())
            peaks[name] = (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 1e6
        finally:
            tracemalloc.stop()
            pa.set_memory_pool(usual)
    assert peaks["trained"] < 150 and peaks["scored"] < 80, peaks


def test_gathered_values_equal_those_at_their_places():
    values = np.random.default_rng(2).random((1000, 2)).astype(np.float32)
    at = np.random.default_rng(3).integers(0, 1000, 5000)
    assert (lm_mix.gathered(values.view(np.float64).ravel(), at).view(np.float32).reshape(-1, 2) == values[at]).all()
    assert not len(lm_mix.gathered(values.ravel(), np.array([], dtype=np.int64)))
