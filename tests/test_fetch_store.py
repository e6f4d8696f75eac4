"""Fetches merged batch by batch against the latest result of all of them."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from leadfit.operators.pages import store_fetches, urls_to_refetch
from leadfit.schemas import PAGE_FETCHES, conform
from leadfit.sources.fetch_store import FetchStore

NOON = datetime(2026, 9, 16, 12)
SCHEMA = ", ".join(f"{c} {t}" for c, t in PAGE_FETCHES.items())


def fetch(url, hours, status=200, html="<p>x</p>"):
    return (url, status, url, html, False, None, None if hours is None else NOON - timedelta(hours=hours))


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some(r, n, urls):
    """Fetches with equal times, no times, no responses; a third are of one url."""
    return [fetch(f"https://s{0 if r.random() < 0.33 else r.randrange(urls)}.test/", r.choice([None, *range(100)]), r.choice([0, 200, 200, 404, 503]), f"<p>{r.randrange(50)}</p>") for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in conform(df, PAGE_FETCHES).collect()), key=repr)


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("fetches"))
    r = random.Random(5)
    batches = [some(r, 600, 150), some(r, 300, 300), [*some(r, 40, 400), *some(random.Random(5), 100, 150)]]
    for rows in batches:
        FetchStore(spark, root, buckets=4).upsert(batch(spark, rows))
    return root, batches


def test_store_equals_the_latest_of_all(spark, merged):
    root, batches = merged
    every = batch(spark, [row for rows in batches for row in rows])
    assert rows_of(FetchStore(spark, root).read()) == rows_of(store_fetches(every))


def test_a_batch_that_comes_again_changes_nothing(spark, merged):
    root, batches = merged
    store = FetchStore(spark, root)
    before, listed, versions = rows_of(store.read()), store.segments(), store.commits.versions()
    for rows in batches:
        assert store.upsert(batch(spark, rows * 2)) == 0
    assert (rows_of(store.read()), store.segments(), store.commits.versions()) == (before, listed, versions)


def test_current_rows_are_counted(spark, merged):
    """Segments tell how many of their rows are current; together they are the urls."""
    root, batches = merged
    store = FetchStore(spark, root)
    assert store.buckets == 4 and sum(live for _, live in store.segments().values()) == store.read().count()
    assert [n for n, _ in store.segments().values()] == [sum(row[1] != 0 for row in rows) for rows in batches]


def test_asked_urls_only(spark, merged):
    root, _ = merged
    store = FetchStore(spark, root)
    asked = ["https://s0.test/", "https://s3.test/", "https://unknown.test/", None, "https://s0.test/"]
    found = store.read(spark.createDataFrame([(u, 1) for u in asked], "url string, status int"))
    assert rows_of(found) == [row for row in rows_of(store.read()) if row[0] in asked]


def test_heads_say_what_is_due(spark, merged):
    root, batches = merged
    every = batch(spark, [row for rows in batches for row in rows])
    needed = every.select("url").unionByName(spark.createDataFrame([("https://new.test/",)], "url string"))
    heads = FetchStore(spark, root).heads()
    assert heads.columns == ["url", "status", "fetched_at"]
    due = lambda stored: sorted(r["url"] for r in urls_to_refetch(needed, stored, NOON).collect())
    assert due(heads) == due(store_fetches(every))


def test_html_is_written_once_and_heads_are_narrow(spark, tmp_path):
    store = FetchStore(spark, str(tmp_path), buckets=2)
    body = "<p>" + "y" * 20_000 + "</p>"
    store.upsert(batch(spark, [fetch(f"https://s{k}.test/", k, html=body) for k in range(50)]))
    heads = [pq.read_schema(f).names for f in Path(tmp_path, "heads").rglob("*.parquet")]
    assert heads and all("html" not in names for names in heads)
    assert sum(pq.read_metadata(f).num_rows for f in Path(tmp_path, "rows").rglob("*.parquet")) == 50
    # no outdated row: read as it stands, without a join
    assert "Join" not in store.read()._jdf.queryExecution().executedPlan().toString()
    store.upsert(batch(spark, [fetch("https://s1.test/", -1)]))
    assert [live for _, live in store.segments().values()] == [49, 1]
    small = store.compacted(str(tmp_path / "small"))
    assert rows_of(small.read()) == rows_of(store.read()) and list(small.segments().values()) == [(50, 50)]


def test_outdated_segments_leave_the_list(spark, tmp_path):
    store = FetchStore(spark, str(tmp_path), buckets=2)
    for hours in (3, 2, 1):
        store.upsert(batch(spark, [fetch("https://a.test/", hours), fetch("https://b.test/", hours)]))
    assert list(store.segments().values()) == [(2, 2)]
    assert store.upsert(batch(spark, [fetch("https://a.test/", 9), fetch("https://c.test/", None)])) == 1
    assert store.read().count() == 3


def test_unfinished_batches_empty_batches_and_odd_rows(spark, tmp_path):
    store = FetchStore(spark, str(tmp_path), buckets=2)
    assert store.read().count() == 0 and store.heads().count() == 0 and store.segments() == {}
    assert store.upsert(batch(spark, [])) == 0
    assert store.upsert(batch(spark, [fetch(None, 1), fetch("https://a.test/", 1, status=None), fetch("https://a.test/", 1, status=0)])) == 0
    assert store.read().columns == list(PAGE_FETCHES)
    assert store.upsert(batch(spark, [fetch("https://a.test/", None, html=None)])) == 1
    broken = tmp_path / "rows" / "segment=000000000009-broken"
    batch(spark, [fetch("https://z.test/", 0)]).selectExpr("*", "1L AS row_hash", "1L AS row_no").write.parquet(str(broken))
    assert [r["url"] for r in FetchStore(spark, str(tmp_path)).read().collect()] == ["https://a.test/"]
