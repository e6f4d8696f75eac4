"""Near copies and searches against brute force; pages, urls and the pipeline."""

import html as entities
import math
import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from leadfit.llm import html, neardup, topk, urls
from leadfit.llm.registry import URL_RULES, op9_html_extraction, op10_url_filters

SMALL = "/root/testdata/sf0.01"


def plain_sets(rows, size):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((i, frozenset(zip(*(words[k:] for k in range(size)))) if len(words) >= size else frozenset([tuple(words)] if words else [])))
    return out


def plain_components(rows, size, percent):
    sets, parent = plain_sets(rows, size), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def variants(seed=2):
    """Groups of near copies with edits about the threshold, copies, a line that many texts share, and unlike texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(r.choice(words) for _ in range(30))
    rows, n = [], 0
    for length in (7, 20, 40, 150, 700):
        for _ in range(3):
            base = [r.choice(words) for _ in range(length)]
            for k in range(12):
                text = list(base)
                for _ in range(r.randint(0, max(1, length // 18))):
                    text[r.randrange(length)] = r.choice(words)
                rows.append((n, " ".join(text) if k % 4 else " ".join(base)))
                n += 1
    for _ in range(60):
        rows.append((n, line + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 60)))))
        n += 1
    r.shuffle(rows)
    return rows


def test_portions_of_a_batch_give_the_same_sets(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice("ABcdefg hij é") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", " \n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = [x.tolist() for x in neardup.shingle_sets(batch.column("text"), 3)]
    monkeypatch.setattr(neardup, "BYTES_AT_ONCE", 500)
    parts = [x.tolist() for rows in neardup.portions([batch]) for x in neardup.shingle_sets(rows.column("text"), 3)]
    assert parts == whole and [len(x) for x in whole] == [len(s) for _, s in plain_sets(enumerate(texts), 3)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_as_brute_force(spark, documents, size, percent):
    rows = variants()
    want = plain_components(rows, size, percent)
    got = neardup.near_duplicates(documents(rows), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = plain_components([tuple(r) for r in docs.collect()], 3, 85)
    got = neardup.near_duplicates(docs, 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_one_hot_group_of_variants(spark, documents):
    """Many variants of one text, some too far from all others, none of them lost and no block left out."""
    r = random.Random(9)
    base = [f"x{k}" for k in range(80)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            text[r.randrange(80)] = f"y{r.randrange(40)}"
        rows.append((i, " ".join(text)))
    before = neardup.BLOCK
    neardup.BLOCK = 64
    try:
        got = neardup.near_duplicates(documents(rows), 3, 85).collect()
    finally:
        neardup.BLOCK = before
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == plain_components(rows, 3, 85)


def test_near_duplicates_of_odd_documents(spark, odd, nothing):
    got = neardup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by_id[1]] == [1, 1] and by_id[8][0]["component_id"] == 1 and not by_id[8][0]["kept"]
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (0, i, True) for i in (2, 3, 4) for r in by_id[i])
    assert all(r["component_id"] is None and r["kept"] for r in by_id[None])
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.keep_one_of_each(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 7]
    assert neardup.keep_one_of_each(nothing).count() == 0


def plain_top(rows, k, every):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in vectors:
        if i % every == 0:
            scores = {(-sum(a * b for a, b in zip(q, c)), j) for j, c in vectors if j != i}
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)}
    return out


def search(df, k=5, every=50):
    return {tuple(r) for r in topk.top_products(df, k, every).select("query_id", "rank", "vec_id", "score").collect()}


def test_top_products_as_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 7) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (450, [1.0, None] * 6), (500, [float("nan")] * 12), (550, [float("inf")] * 12), (None, [1.0] * 12), (600, []), (650, [1.0] * 3), (700, [0.0] * 12)]
    rows += [(0, rows[0][1])]  # a repeated row
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, label int, id long, score double")
    before = topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK
    topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK = 40, 4
    try:
        assert search(df, 5, 10) == plain_top(rows, 5, 10)
    finally:
        topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK = before


def test_repeated_rows_take_one_place(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(120) if i not in (10, 20)]
    rows += [(i, [30.0 + i] * 6) for i in (7, 8) for _ in range(30)]  # one vector of one id, far more than k times
    rows += [(9, [40.0, 40.0, *(float(j == k) for j in range(4))]) for k in range(4) for _ in range(12)]  # one id, several vectors
    rows += [(10, [0.0] * 6)] * 40 + [(20, [50.0, -50.0] * 3)] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for per_block in (16, 4096):
        before = topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK
        topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK = per_block, 4
        try:
            assert search(df, 5, 10) == plain_top(rows, 5, 10)
        finally:
            topk.CANDIDATES_IN_BLOCK, topk.QUERIES_IN_BLOCK = before
    few = [(0, [1.0, 1.0]), *[(1, [9.0, 9.0])] * 8, (2, [1.0, 2.0])]
    assert search(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == plain_top(few, 5, 50)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert search(df) == plain_top([(0, [1.0, 2.0]), (1, [3.0, 4.0])], 5, 50)
    assert search(df.limit(0)) == set()


def plain_article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", "\0", inside)).split("\0")
    return "\n".join(x for x in (re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks) if x)


def test_pages_of_the_given_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, SMALL).collect()
    assert len(rows) == len(pages)
    assert all(r["text"] == plain_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in rows)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header class="top"><a href=/>Home</a></header><div class="cookie-notice">We use cookies.</div>
<div id="content"><h1>Rivers &amp; hills</h1><p>First   paragraph
of <b>bold</b> text &mdash; long enough.<p>Second one with <a href=x>a link</a> inside.<ul><li>one<li>two</ul>
<div class="share-buttons">Share</div><!-- <p>hidden</p> --></div>
<aside><div class="text">Side</div></aside><section id="comments"><p>I like it.</p></section><form><p>Name</p><input></form><footer><div class="footer-content">foot</div></footer></body></html>"""


def test_page_parts(spark):
    trees = html.fit_extractor(spark.read.parquet(f"{SMALL}/pages.parquet"))
    text = html.extract(PAGE, trees)
    assert not re.search("Home|cookies|Share|Side|like it|Name|foot|hidden|var a", text)
    assert text.startswith("Rivers & hills\nFirst paragraph of bold text — long enough.\nSecond one with a link inside.")


@pytest.mark.parametrize("given", [True, False])
def test_names_do_not_force_out_text(spark, given):
    trees = html.fit_extractor(spark.read.parquet(f"{SMALL}/pages.parquet")) if given else None
    words = "A long sentence about rivers and hills, told at some length for all to read. " * 4
    top, end = "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav>", "<footer>foot</footer></body></html>"
    wrapped = html.extract(f'{top}<div class="page no-sidebar"><p>{words}</p><p>{words}</p><div class="share-buttons">Share</div></div>{end}', trees)
    assert wrapped.startswith("\n".join([words.strip()] * 2)) and not re.search("Home|Share", wrapped)
    inline = html.extract(f'{top}<article><p>{words} see <a class="related" href=x>this</a> and <em class="notice">that</em>.</p><p class="legal">{words}</p></article>{end}', trees)
    assert inline == f"{words}see this and that.\n{words.strip()}"


def test_headings_are_left_to_the_trees():
    page = '<body><header><h1>Site</h1></header><article><header><h1>Own</h1></header><h2 class="page-header">Next</h2><p>Text.</p><footer>foot</footer></article></body>'
    nodes = html.parse(page)
    other = html.named_other(nodes, html.features(nodes)[:, html.NUMBERS.index("share_of_page")])
    assert [n.tag for n, o in zip(nodes, other) if o] == ["header", "footer"]
    assert html.extract(page, None) == "Own\nNext\nText."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<" * 5000), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "no markup at all"), (6, "u", "no markup at all"), (7, "u", "<article><p>a&nbsp;b&#33;</article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    for trees in (None, html.fit_extractor(df)):
        got = html.main_text(df, trees).collect()
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
        assert {r["text"] for r in got if r["page_id"] == 7} == {"a b!"}
    assert html.main_text(df.limit(0), html.fit_extractor(df.limit(0))).count() == 0


def plain_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1])) if fit else None
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls_of_the_given_table(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op10_url_filters(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_url(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] == ("block" if "-" in host else "allow")


def test_odd_urls(spark):
    odd_urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net", "http://xnet/", "http://org/fr/?", "a://b://c/d", "http://h?a/b", "http://é.example.com/de/", "http://x.org/fr/a/../b", "http://" + "a" * 20000]
    df = spark.createDataFrame([(i, u, "h", "p", "r", 1) for i, u in enumerate(odd_urls)] + [(None, "http://x.org/fr/", "h", "p", "r", 1)], "page_id long, url string, host string, path string, rule string, label int")
    rows = urls.judge_urls(df, URL_RULES, urls.fit_urls(df)).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_url(odd_urls[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if rule else ["allow", "block"])
    assert urls.judge_urls(df.limit(0), URL_RULES, urls.fit_urls(df.limit(0))).count() == 0


def test_pipeline_stages(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns
        ids, before = ({r["doc_id"] for r in t.select("doc_id").collect()} for t in (left, docs))
        assert ids < before
        docs = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed.collect())
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).count()
        stage(spark, odd.limit(0), folder).count()


def test_kept_documents_of_the_pipeline_by_brute_force(spark, folder):
    """Of the documents that the two classifiers keep, the smallest id of each brute-force component stays."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {c for _, c in plain_components(rows, 5, 80).values()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == want


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
