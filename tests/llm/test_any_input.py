"""Every operator: extra columns with clashing names, nulls in any column, very long texts, repeated rows, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from wavetally.llm import exact_dedup, html_extract, importance, lm_mix, media, mixing, packing, simhash, toxicity, url_filter

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
#: Names that operators give to columns of their own.
CLASHING = (
    "row token n c x key keys salt salts part parts block fp fingerprint root component_id size source_size target taken times bucket score n_segments label "
    "toxic quality host path rule verdict digest keep_id group_size kept piece start length sequence_id offset payload stream data value id a b u v count weight"
).split()


def documents(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(3 + i % 5)) for i in range(200)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 40))) for _ in range(40)]
    long = " ".join(rnd.choices(words, k=120_000))
    texts += [None, "", " \n\t ", long, long, long + " more", "x" * 300_000, texts[0], texts[0], "é ü 漢字 " * 50]
    rows = [(i if i % 9 else None, t, "en" if i % 4 else None, ("a", "b", None)[i % 3], None if i % 5 else 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], DOCUMENTS)


def pages(spark):
    para = "A paragraph of the article that is long enough to be taken for text by its density, with some words to spare. "
    body = "<html><body><nav><a href=1>One</a> <a href=2>Two</a></nav><article>" + f"<p>{para * 3}</p>" * 4 + "</article></body></html>"
    rows = [(1, "http://a.example.net/en/x", body), (1, "http://a.example.net/en/x", body), (2, "HTTPS://B.org/fr/?q", ""), (3, None, None), (None, "no scheme", body)]
    rows += [(4, "http://" + "h" * 100_000 + ".net/", body.replace("</article>", f"<p>{para * 20_000}</p></article>")), (5, "://", "<" * 1000), (6, "http://example.com/de/a", "<div>" * 20_000)]
    return spark.createDataFrame(rows, PAGES)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(1, 30)] + [(None, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "lm": (documents, lambda d, n: lm_mix.score(d, F.col("doc_id") % 2 == 0, head=30, table_bits=8)),
    "simhash": (documents, lambda d, n: simhash.near_duplicates(d)),
    "exact": (documents, lambda d, n: exact_dedup.duplicate_groups(d)),
    "toxicity": (documents, lambda d, n: toxicity.score(d, toxicity.train(d, n))),
    "html": (pages, lambda d, n: html_extract.extract(d)),
    "url": (pages, lambda d, n: url_filter.judge(d)),
    "packing": (documents, lambda d, n: packing.pack(d).select("doc_id", "piece", "start", "length", "ids_crc32")),
    "mixing": (documents, lambda d, n: mixing.plan_mix(d).select("doc_id", "size", "source_size", "target", "taken")),
    "media": (documents, lambda d, n: media.digests(d)),
    "importance": (documents, lambda d, n: importance.resample(d, n)),
}


def rounded(df):
    return sorted(str([f"{v:.6g}" if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, name):
    rows, operator = OPERATORS[name]
    plain = rows(spark).coalesce(1)
    clash = plain.select("*", *[F.lit(c).alias(c) for c in CLASHING if c not in plain.columns])
    marks = labels(spark)
    other = marks.select("*", *[F.lit(c).alias(c) for c in ("text", "lang", "n", "label", "x", "key") if c not in marks.columns])
    want = rounded(operator(plain, marks))
    assert want and rounded(operator(clash, other)) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    rows, operator = OPERATORS[name]
    assert operator(rows(spark).limit(0), labels(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("packing", "importance")])
def test_a_result_for_every_row(spark, name):
    rows, operator = OPERATORS[name]
    table = rows(spark)
    key = table.columns[0]
    got = operator(table, labels(spark))
    assert sorted(map(str, (r[0] for r in got.select(key).collect()))) == sorted(map(str, (r[0] for r in table.select(key).collect())))


def test_long_texts_are_linked_packed_and_counted_whole(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    long = sorted(i for i, t in texts.items() if t and len(t) > 400_000)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert len({found[i] for i in long}) == 1
    sizes = {r["doc_id"]: r["size"] for r in mixing.plan_mix(docs).where("doc_id is not null").collect()}
    assert all(sizes[i] == len(texts[i].split()) for i in long)
    pieces = packing.pack(docs).where(F.col("doc_id").isin(long)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert len(pieces) == len(long) and all(r["n"] == r["end"] > 100_000 for r in pieces)
