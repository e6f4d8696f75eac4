"""A lead store in buckets against the table that is rewritten as a whole."""

import random
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from leadfit.operators.merging import dedupe_merge, upsert_leads
from leadfit.schemas import LEAD_FIELDS
from leadfit.sources.lead_files import normalize_leads
from leadfit.sources.lead_store import LeadStore
from leadfit.sources.tables import materialize

DAY = date(2026, 9, 16)
RAW = "ord long, name string, website string, city string, state string, industry string, employees string, revenue_estimate string, owner_name string, email string, phone string"


def batch(spark, rows):
    return materialize(dedupe_merge(normalize_leads(spark.createDataFrame(rows, RAW))), "rows")


def some_rows(r, n, first=0, of=None):
    """Companies with gaps, so that later batches fill domains, cities and phones, and with shared names."""
    gap = lambda x, p=0.4: x if r.random() > p else None
    out = []
    for k in range(n):
        c = first + r.randrange(of or n)
        out.append((k, f"Firm {c % 90}" if c % 7 else f"firm {c}", gap(f"https://www.s{c}.test"), gap(f"Town{c % 11}"), gap("TX"), gap("Plumbing"), gap(str(c % 50)), None, gap("Ann Lee"), gap(f"a@s{c}.test", 0.7), gap("512-555-0100")))
    return out


def rows_of(leads):
    return sorted((tuple(r) for r in leads.select("lead_key", "seq", "batch_id", "score", "tier", "status", *LEAD_FIELDS).collect()), key=repr)


def written(root, parts=("inserted", "updated", "domains", "names")):
    """Rows of each file of the store."""
    return {f: pq.read_metadata(f).num_rows for p in parts for f in Path(root, p).rglob("*.parquet")} if Path(root).exists() else {}


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """A store and the whole table after the same three batches, and what each batch wrote."""
    root = str(tmp_path_factory.mktemp("store"))
    r = random.Random(3)
    batches = [batch(spark, some_rows(r, 1500, of=900)), batch(spark, some_rows(r, 12, first=40, of=30)), batch(spark, some_rows(r, 200, first=500, of=700))]
    table, sizes = None, []
    for n, rows in enumerate(batches, 1):
        before = written(root)
        LeadStore(spark, root, buckets=8).upsert(rows, f"b{n}", DAY)
        sizes.append(sum(s for f, s in written(root).items() if f not in before))
        table = materialize(upsert_leads(table, rows, f"b{n}", n, DAY), "table")
    return root, table, batches, sizes


def test_store_equals_the_rewritten_table(spark, stores):
    root, table, _, _ = stores
    store = LeadStore(spark, root)
    assert store.buckets == 8 and store.versions() == [1, 2, 3]
    assert rows_of(store.read()) == rows_of(table)


def test_a_small_batch_writes_little(stores):
    """Twelve rows change twelve leads at most: each a lead and up to two keys."""
    _, _, batches, sizes = stores
    assert 0 < sizes[1] <= 3 * batches[1].count() and sizes[1] < sizes[0] / 20


def test_batches_that_come_again(spark, stores, tmp_path):
    """As in the rewritten table; and rows that are known by their domains alone write nothing the second time."""
    root, table, batches, _ = stores
    store = LeadStore(spark, root).compacted(str(tmp_path))
    store.upsert(batches[2], "again", DAY)
    assert store.versions() == [3, 4] and rows_of(store.read()) == rows_of(upsert_leads(table, batches[2], "again", 4, DAY))
    known = batch(spark, [(k, f"Other {k}", f"s{k}.test", "Town", None, None, None, None, None, None, None) for k in range(40)])
    store.upsert(known, "b5", DAY)
    before = written(tmp_path)
    store.upsert(known, "b6", DAY)
    assert set(written(tmp_path)) == set(before) and store.versions() == [3, 4, 5, 6]


def test_unfinished_batches_are_not_read(spark, stores):
    root, table, _, _ = stores
    store = LeadStore(spark, root)
    store._append("inserted", "000000000009-broken", table.limit(5))
    assert rows_of(LeadStore(spark, root).read()) == rows_of(table)


def test_an_empty_store_and_an_empty_batch(spark, tmp_path):
    store = LeadStore(spark, str(tmp_path / "a"))
    assert store.read() is None and store.versions() == []
    store.upsert(batch(spark, [(0, None, None, None, None, None, None, None, None, None, None)]), "b1", DAY)
    assert store.read().count() == 0 and store.versions() == [1]
