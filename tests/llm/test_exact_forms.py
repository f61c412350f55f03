"""SimHash, packing, FLAC media, HTML extraction and the pipeline: brute force and exact round trips."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavetally.llm import components, flac, html_extract, media, near_copies, packing, queries, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def naive_fingerprint(text):
    import re

    import xxhash

    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b, c in enumerate(counts) if 2 * c > len(shingles))


def reached(prints, radius=4):
    """The smallest index that each fingerprint reaches, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            parent[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(6)
    base = [[f"w{rnd.randrange(500)}" for _ in range(120)] for _ in range(12)]
    texts = [None, "", " \t", "One", "one two", "É é x A b", "word " * 30000]
    for words in base:
        for _ in range(15):
            own = list(words)
            for _ in range(rnd.randrange(0, 6)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(99)}"
            texts.append(" ".join(own))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = np.array([naive_fingerprint(t) for t in texts], dtype=np.uint64)
    assert [int(rows[i]["fingerprint"], 16) for i in range(len(texts))] == prints.tolist()
    assert [rows[i]["component_id"] for i in range(len(texts))] == reached(prints)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot, many", [(2048, 1 << 30), (15, 1 << 30), (1, 1 << 30), (2048, 1), (3, 1)])
def test_crowded_keys_lose_no_link(spark, hot, many):
    rng = np.random.default_rng(hot)
    found = []
    for v in rng.integers(0, 1 << 63, 15, dtype=np.uint64):
        for _ in range(30):
            y = int(v)
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= 1 << int(bit)
            found.append(y)
    found += [int(v) & ~((1 << 22) - 1) | 5 for v in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    prints = np.unique(np.array(found, dtype=np.uint64))
    df = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp bigint")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, hot, many)).collect()}
    mine = [roots.get(v, v) for v in prints.view(np.int64).tolist()]
    want = reached(prints)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_simhash_repeats_and_null_ids(spark):
    rows = simhash.near_duplicates(documents(spark, ["a b c d e"] * 4 + [None], [5, 5, None, 9, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]


def test_near_copies_go_by_row(spark):
    """Rows that share an id or have none: one of each component stays, whatever other rows the id has."""
    a, b, c = "a b c d e", "other words are here", "a third text of its own"
    cases = [(5, a), (7, a), (7, b), (None, a), (None, c), (None, c), (3, c), (3, a), (3, a)]
    got = near_copies.keep_one(documents(spark, [t for _, t in cases], [i for i, _ in cases])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, a), (3, c), (7, b)]
    got = near_copies.keep_one(documents(spark, [a, a, b], [None, None, None])).collect()
    assert sorted(r["text"] for r in got) == [a, b]


def near_copy_groups(texts, shingle=5, similarity=0.8):
    """The smallest index that each text reaches over all pairs of similarity or more."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_near_copies_equal_brute_force(spark):
    """Groups of edited copies; one large dense group; the links that are found are exact and hardly any is missed."""
    rnd = random.Random(4)
    texts = [None, "", " \t", "one", "One", "a b", "a b c d e f", "A b c d e f", "very long " * 40000]
    for g in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 40, 150, 600]))]
        for _ in range(60 if g == 0 else 5):
            own = list(words)
            for _ in range(rnd.randrange(0, max(2, len(own) // 60))):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(99)}"
            texts.append(" ".join(own))
    docs = documents(spark, texts).withColumns({"node": F.lit(1), "key": F.lit("k"), "check": F.lit(2.0)})
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    got, want = {r["doc_id"] for r in kept.collect()}, set(near_copy_groups(texts))
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))
    assert near_copies.keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2048, 7])
def test_near_copies_in_blocks(spark, block):
    """A chain of edits and texts that share a part: all pairs are compared, in one block or many."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:40] + [f"x{k}y{i}" for i in range(4)]) for k in range(12)] + [" ".join([*base[:40], f"z{k}"]) for k in range(12)]
    texts += [" ".join([f"c{max(0, i - k)}d{i}" for i in range(50)]) for k in range(0, 30)]
    rows = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    links = near_copies.similar_links(rows, recall=0.999, block=block)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == near_copy_groups(texts)


def test_forest_of_large_groups_equals_that_of_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    check = np.array([[int(w) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 7).tolist())) for w in base[rng.integers(0, 6)]] for _ in range(300)], dtype=np.uint64)
    key = np.sort(rng.integers(0, 9, 300))
    want = near_copies._forest(key, check, 20)
    monkeypatch.setattr(near_copies, "SMALL", 1)
    assert near_copies._forest(key, check, 20).tolist() == want.tolist() and len(set(want.tolist())) < 300


def test_layout_grows_with_the_rows():
    for n in (10, 1 << 26, 1 << 32):
        bits, segments = near_copies.layout(n)
        p = near_copies.bit_difference(0.8)
        meet = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
        assert 1 - (1 - meet) ** segments >= 0.95 and (bits == 22) == (n <= 1 << 26)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(200)) and got[2001] == 2000
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_token_ids_equal_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    texts += ["a  b", " \n b", "it's  \t\n x", "", "   ", "a ", "é   z", "<|endoftext|> b", "1 2  3\t4", "x\x85y", "日本語 ок", "a　 b"]
    run = packing.encoder()
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        assert [run(x) for x in part] == [e.ids for e in t.encode_batch(part, add_special_tokens=False)]


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"word{rnd.randrange(900)}" for _ in range(rnd.choice([1, 5, 40, 200, 700, 3000]))) for _ in range(300)] + [None, "", "x" * 5]
    ids = [*range(len(texts) - 1), 0]  # a repeated id
    rows = packing.pack(documents(spark, texts, ids), shard_pieces=100).collect()
    run, want = packing.encoder(), defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*run(t or ""), packing.END_ID], dtype="<u4")
        first = len(tokens) % 1024 if len(tokens) > 1024 else len(tokens)
        cuts = ([0] if first else []) + list(range(first, len(tokens), 1024)) if len(tokens) > 1024 else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(tokens)], strict=True)):
            want[i].append((k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert len(sequences) <= 1.05 * least + 8
    assert packing.pack(documents(spark, [])).count() == 0


def test_sum_of_squares_chooses_the_smallest_sum():
    """Each step against trying all open gaps."""
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 64, 200))[::-1]
    where, offset = packing.sum_of_squares(lengths, 64)
    gaps: dict[int, int] = {}
    for n, w, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        open_gaps = [g for g in gaps.values() if 0 < g < 64]
        square = lambda gs: sum(gs.count(h) ** 2 for h in set(gs))
        tries = {}
        for g in set(open_gaps):
            if g >= n:
                rest = list(open_gaps)
                rest.remove(g)
                tries[g] = square(rest + ([g - n] if g > n else []))
        gap = gaps.get(w, 64)
        assert 64 - o == gap
        assert (gap == 64 and not tries) or (gap in tries and tries[gap] == min(tries.values()))
        gaps[w] = gap - n


def bits(*fields):
    """Bytes of (value, width) fields, most significant first, padded with zeros."""
    text = "".join(format(v & ((1 << w) - 1), f"0{w}b") for v, w in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def frame(n, subframes, channels=0, size_code=1, number=0):
    head = bits((0x3FFE, 14), (0, 2), (7, 4), (4, 4), (channels, 4), (size_code, 3), (0, 1)) + flac._coded_number(number) + struct.pack(">H", n - 1)
    head += bytes([flac.crc8(head)])
    body = head + bits(*[f for s in subframes for f in s])
    return body + struct.pack(">H", flac.crc16(body))


def rice(values, k):
    out = []
    for v in values:
        u = v << 1 if v >= 0 else (-v << 1) - 1
        out += [(0, 1)] * (u >> k) + [(1, 1), (u & ((1 << k) - 1), k)] if k else [(0, 1)] * u + [(1, 1)]
    return out


def stream(frames, samples, channels=1, width=8):
    info = struct.pack(">HH", 16, 4096) + bytes(6) + struct.pack(">Q", 8000 << 44 | channels - 1 << 41 | width - 1 << 36 | samples) + bytes(16)
    return b"fLaC" + struct.pack(">I", 0x80 << 24 | len(info)) + info + b"".join(frames)


def test_flac_reads_linear_prediction_partitions_and_stereo():
    rng = np.random.default_rng(4)
    x = np.clip(np.cumsum(rng.integers(-3, 4, 32)), -100, 100).tolist()
    weights, shift = [7, -3], 2
    residual = [x[t] - ((weights[0] * x[t - 1] + weights[1] * x[t - 2]) >> shift) for t in range(2, 32)]
    lpc = [(0, 1), (32 + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (4 - 1, 4), (shift, 5), (7, 4), (-3, 4), (0, 2), (1, 4), (3, 4), *rice(residual[:14], 3), (15, 4), (9, 5), *[(r, 9) for r in residual[14:]]]
    assert flac.read_samples(stream([frame(32, [lpc])], 32), 0, 32) == [x]
    assert flac.decode([stream([frame(32, [lpc])], 32)])[0].tolist() == x
    left, right = [5, -7, 9, 100] * 8, [4, -7, 1, -100] * 8
    plain = lambda values, width: [(0, 1), (1, 6), (0, 1), *[(v, width) for v in values]]
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    for channels, pair in ((1, (left, right)), (8, (left, side)), (9, (side, right)), (10, (mid, side))):
        widths = [9 if p is side else 8 for p in pair]
        data = stream([frame(32, [plain(p, w) for p, w in zip(pair, widths, strict=True)], channels)], 32, 2)
        assert flac.read_samples(data, 3, 5) == [left[3:8], right[3:8]]
    wasted = [(0, 1), (1, 6), (1, 1), (0, 1), (1, 1), *[(v >> 2, 6) for v in [8, -12] * 16]]
    assert flac.read_samples(stream([frame(32, [wasted])], 32), 0, 32) == [[8, -12] * 16]
    constant = [(0, 1), (0, 6), (0, 1), (-5, 16)]
    assert flac.read_samples(stream([frame(40, [constant], size_code=4)], 40, width=16), 0, 99) == [[-5] * 40]


PAYLOADS = [b"", b"a", b"\0" * 5000, bytes(range(256)) * 9, b"ab" * 700, b"a" * 1023 + b"\xff" + b"b" * 4000, bytes([0, 255] * 3000), "Ünï " .encode() * 900]


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(1)
    whole = [p + bytes(-len(p) % 64 or 64 * (not p)) for p in [*PAYLOADS, rng.integers(0, 256, 3000, dtype=np.uint8).tobytes(), np.clip(np.cumsum(rng.normal(0, 2, 150_000)) + 128, 0, 255).astype(np.uint8).tobytes()]]
    pcm = [media.to_pcm(p) for p in whole]
    streams = flac.encode(pcm)
    assert [media.from_pcm(x) for x in flac.decode(streams)] == whole
    for s, p in zip(streams, pcm, strict=True):
        assert flac.read_samples(s, 0, len(p) if len(p) < 9000 else 2000)[0] == p[: len(p) if len(p) < 9000 else 2000].tolist()
        assert flac.read_samples(s, len(p) - 50, 50)[0] == p[-50:].tolist()
    kinds = {s[flac.Info(s).first + 6] >> 1 for s in streams if flac.Info(s).samples >= flac.BLOCK}
    assert 0x20 | flac.ORDER - 1 in kinds and len(kinds) > 2  # linear prediction, and others
    for at in (-1, -40, flac.Info(streams[3]).first + 2):
        broken = bytearray(streams[3])
        broken[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode([b"RIFF"])


def test_media_digests_equal_plain_hashes(spark):
    texts = [None, "", "hello", "é" * 100, "long text " * 30000, "hello"]
    rows = {r["doc_id"]: r for r in media.digests(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    same = [{k: rows[i][k] for k in ("media_bytes", "media_sha256", "feature")} for i in (2, 5)]
    assert same[0] == same[1]
    stored = media.write_media(documents(spark, texts))
    blocks = media.read_blocks(stored).where("doc_id = 4").orderBy("block").collect()
    assert media.from_pcm(np.frombuffer(b"".join(b["pcm"] for b in blocks), np.int8)).rstrip(b"\0") == ("long text " * 30000).encode()
    assert [b["first_sample"] for b in blocks] == [flac.BLOCK * b["block"] for b in blocks]
    assert media.digests(documents(spark, [])).count() == 0


PAGES = {
    "<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three<br>four<p>Short.</article><footer>f</footer>": "A & B\nOne two three four\nShort.",
    "<article><p>a &lt;b&gt; &eacute;&#233;&#x41;</p><aside>ad</aside><p>c<b>d</b>e</p><form><p>mail</p></form></article><section class='comments'><p>first!</p></section>": "a <b> ééA\ncde",
    "<body><div id=menu><a href=1>One</a><a href=2>Two</a></div><div><h1>The title of it</h1><p>A first paragraph that is long enough to make the text surge, so it stays.</p><p>Short.</p><p>And a last one that is long enough as well.</p></div><div class=footer>Imprint</div>": "The title of it\nA first paragraph that is long enough to make the text surge, so it stays.\nShort.\nAnd a last one that is long enough as well.",
    "<main><header><h1>Head</h1></header><!-- <p>no</p> --><p>text <span class='ad'>buy</span>on</p><style>p{}</style><noscript>n</noscript></main>": "Head\ntext on",
    "": "",
    "<div class='ad'>buy</div>": "",
    "<div class='site header'><p>Welcome to this very long header of a site that goes on for more than sixty letters</p></div><p>The only paragraph, long enough to make the text surge on this page.</p>": "The only paragraph, long enough to make the text surge on this page.",
    "<article><div class='header'><h1>T</h1></div><p>x</p><div id='reader_comments'><p>c</p></div></article>": "T\nx",
    "<nav>never closed <p>x": "",
    "<h1>Title</h1><p>Hi.</p><p>Short body only.</p>": "Title\nHi.\nShort body only.",
    "<article><p class='tags-of-iron'>A paragraph about tags that are made of iron.</p><p>And one more of them.</p></article>": "A paragraph about tags that are made of iron.\nAnd one more of them.",
    "<article><p>First text of the article, which goes on for a while.</p><ul><li><a href=1>Menu one</a></li><li><a href=2>Menu two</a></li><li><a href=3>Menu three</a></li><li><a href=4>Menu four</a></li></ul></article>": "First text of the article, which goes on for a while.",
    "<article><p>A teaser.</p></article><div>" + "<p>The main text of this page lies in a plain element and is long enough to surge.</p>" * 6 + "</div>": "\n".join(["A teaser."] + ["The main text of this page lies in a plain element and is long enough to surge."] * 6),
    "<div class=comments><p>" + "What a reader says here. " * 4 + "</p></div><article><p>One.</p><p>Two <i>and</i> three.</p></article><p>Stray.</p>": "One.\nTwo and three.",
}


def test_html_pages(spark):
    cases = list(PAGES.items())
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(cases)] + [(99, None, None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert [got[i]["text"] for i in range(len(cases))] == [w for _, w in cases]
    assert got[99]["text"] == "" and got[99]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_of_the_table(spark):
    """Every page against its article element read by plain splitting."""
    import html as h
    import re

    for r in queries.op5_html_extraction(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_line_windows_equal_brute_force():
    """Surges and dives against the definition, line by line."""
    rnd = random.Random(7)
    for _ in range(300):
        weights = [float(rnd.choice([0, 0, 0, 1, 5, 80])) for _ in range(rnd.randrange(0, 30))]
        sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
        want, inside = [], False
        for i, s in enumerate(sums):
            if not inside and weights[i] > 0:
                want.append([i])
                inside = True
            if inside and s == 0:
                inside = False
            elif inside:
                want[-1].append(i)
        got = html_extract.between_surge_and_dive(weights, 3)
        assert got == [(w[0], w[-1] + 1, max(sums[w[0] : w[-1] + 1])) for w in want]


def test_pages_take_time_in_proportion():
    """Unclosed, deep and long pages."""
    import time

    for unit in ("<div>", "<p><b>x", "<div></p>", "<b><hr>", "<li><i>", "<article>t", "<div class=ad>t", "<span class=ad>", "</div>", "a <", "<script>", "&amp;<br>"):
        took = []
        for n in (4000, 16000):
            start = time.process_time()
            html_extract.main_text(unit * n)
            took.append(time.process_time() - start)
        assert took[1] < 8 * took[0] + 0.3, unit


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 90))) for _ in range(150)]
    texts += texts[:20]
    near = [t.split() for t in texts[20:30]]
    texts += [" ".join([*t, "tail"]) for t in near]
    for i in range(0, 150, 6):
        texts[i] += " idiot you scum and moron"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("idiot" in t)) for i, t in enumerate(texts)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        results.append(docs.collect())
        docs = spark.createDataFrame(results[-1], docs.schema)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(r[0].asDict()) == columns for r in results[:4])
    left = {r["doc_id"]: r["text"] for r in results[0]}
    assert left == {i: t for i, t in enumerate(texts) if "idiot" not in t}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, -1))
    assert sorted(r["doc_id"] for r in results[1]) == sorted(last.values())
    ids = sorted(last.values())
    assert sorted(r["doc_id"] for r in results[2]) == sorted({ids[k] for k in near_copy_groups([left[i] for i in ids])})
    kept = {r["doc_id"] for r in results[2]}
    assert {r["doc_id"] for r in results[3]} <= kept and max(sum(r["doc_id"] == i for r in results[3]) for i in kept) <= 2
    tokens = sum(len(packing.encoder()(r["text"])) + 1 for r in results[3])
    assert sum(r["length"] for r in results[4]) == tokens
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == tokens
