"""No text, page or url stalls a job, nothing is cut off in learning, and repeated rows are judged alike whatever their order."""

import math
import time
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from leadfit.llm import html, neardup, quality, rules, toxicity, urls
from leadfit.llm.registry import op2_quality_classifier, op5_toxicity

SMALL = "/root/testdata/sf0.01"
SIZE = 300_000
UNITS = ['<a "', "<a ", "<a", '<a b="', "<a 'x\" ", "<", "</i>", "<p>", "<li>", "<td>", "<!", "<script>", "<a <b "]


@pytest.mark.parametrize("end", ["", ">", '">'])
def test_pages_are_parsed_in_linear_time(end):
    pages = [u * (SIZE // len(u)) + end for u in UNITS]
    pages += ["<b>" * 50_000 + "</i>" * 40_000 + end, "<i><div>" + "<b>" * 50_000 + "</i>" * 40_000 + end, "<p>" + "<font>" * 50_000 + "<div>" * 10 + end]
    for page in pages:
        start = time.time()
        assert html.extract(page + "<p>last", None) is not None
        assert time.time() - start < 15, page[:30]


def test_text_behind_an_open_tag_stays():
    assert html.extract('<p>one < two</p><p>a <b "c</p><p>three</p>', None) == 'one < two\na <b "c\nthree'
    assert html.extract("<p>one</p><p>two</p><a href='", None) == "one\ntwo"


def test_pages_without_names_are_still_read(spark):
    """Trees alone, on the given pages with article, main, nav, aside, header, footer and all class and id names gone."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    trees = html.fit_extractor(pages)
    named = {r["page_id"]: r["html"] for r in pages.collect()}
    strip = lambda h: html.re.sub(r"<(/?)(?:article|main|nav|aside|header|footer|section)\b[^>]*>", r"<\1div>", html.re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h))
    shares = []
    for h in named.values():
        want, got = Counter(html.extract(h, trees).split("\n")), Counter(html.extract(strip(h), trees).split("\n"))
        same = sum((want & got).values())
        shares.append(2 * same / (sum(want.values()) + sum(got.values())))
    assert np.mean(shares) > 0.8


def test_entropy_and_long_urls(spark):
    texts = ["", "a", "aaaa", "abab", "aab/é日日", "x" * 30_000, "".join(chr(0x4E00 + k % 4000) for k in range(40_000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    start = time.time()
    got = [r["e"] for r in df.select("k", urls.entropy(F.col("t")).alias("e")).orderBy("k").collect()]
    assert time.time() - start < 10
    for t, e in zip(texts, got):
        assert e == pytest.approx(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), abs=1e-9)


def test_every_suffix_has_its_blame(spark):
    rows = [(f"http://{'casino' if k % 2 else 'plain'}{k}.s{k % 300}/a",) for k in range(3000)]
    rows += [(f"http://casino.com/{k}",) for k in range(200)]
    model = urls.fit_urls(spark.createDataFrame(rows, "url string"), label=F.when(F.col("url").contains("casino"), 1).otherwise(0))
    blame = {r["known_suffix"]: r["blame"] for r in model.blame.collect()}
    assert len(blame) == 301 and blame["com"] > 0.9 and blame["s1"] > blame["s2"]


def test_quality_scores_by_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    m = quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), parts=4, held_out=2)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in op2_quality_classifier(spark, SMALL).collect()}

    def size(data, content):
        frame = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=quality.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=words, compression_params=frame).compress(data))

    for r in docs.orderBy("doc_id").collect():
        data = (r["text"] or "").encode()
        saved = sum(size(data[i:i + 1024], m.bad) - size(data[i:i + 1024], m.good) for i in range(0, len(data), 1024)) if len(data) < 20_000 else None
        if saved is not None:
            x = (saved + m.mean * 50) / (len(data) + 50)
            score = 1 / (1 + math.exp(-max(-30, min(30, m.slope * x + m.offset))))
            assert got[r["doc_id"]] == (pytest.approx(score, abs=1e-9), int(got[r["doc_id"]][0] >= 0.7))


def test_toxicity_scores_by_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    m = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), parts=5, held_out=0)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in op5_toxicity(spark, SMALL).collect()}
    for r in docs.collect():
        words, word = set(), ""
        for c in (r["text"] or "").lower() + " ":
            if c.isalnum():
                word += c
            elif word:
                words |= {word, *(word[:n] + "-" for n in (5, 7) if len(word) > n)}
                word = ""
        score = 1 / (1 + math.exp(-max(-30, min(30, m.offset + sum(m.weights.get(w, 0.0) for w in words)))))
        assert got[r["doc_id"]] == (pytest.approx(score, abs=1e-6), int(got[r["doc_id"]][0] >= 0.5))


def test_late_words_of_long_texts_are_learnt(spark):
    """The word that tells is the alphabetically last of over 20,000."""
    filler = " ".join(f"a{k:05d}" for k in range(21_000))
    rows = [(k, f"{filler} {'яд' if k % 2 else 'мир'}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    m = toxicity.fit_toxicity(docs, labels)
    assert m.score("яд") > 0.5 > m.score("мир")


def test_repeated_ids_are_learnt_from_in_a_fixed_order(spark):
    rows = [(k, f"{'fine words about hills' if (k + v) % 2 else 'BUY!! $$$ NOW!!'} number {k} version {v} " * 5) for k in range(80) for v in range(3)]
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(80)], "doc_id long, quality int, toxic int")
    made = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        made.append((quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels), rules.fit_rules(docs, labels)))
    assert made[0] == made[1]


def test_copies_of_reused_and_missing_ids(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, a, "x", 1), (2, a, "y", 2), (2, b, "z", 3), (2, b, "w", 4), (None, a, "n", 5), (None, a, "n", 6)]
    schema = "doc_id long, text string, source string, n int"
    want = [(1, a, "x", 1), (2, b, "w", 4), (None, a, "n", 5), (None, a, "n", 6)]
    for order in (rows, rows[::-1]):
        kept = neardup.keep_one_of_each(spark.createDataFrame(order, schema).repartition(3))
        assert kept.columns == ["doc_id", "text", "source", "n"]
        assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    bare = neardup.keep_one_of_each(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert sorted((tuple(r) for r in bare.collect()), key=repr) == sorted([(1, a), (2, b), (None, a), (None, a)], key=repr)
