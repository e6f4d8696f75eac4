"""Search by stored postings against the scan of all leads."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from leadfit.operators.filters import search_text
from leadfit.sources.search_index import SearchIndex, runs_of

COLS = "lead_key string, name string, domain string, city string"
PATTERNS = ["alder", "ALDER%1", "der_he", "%", "", "a", "al", "ald", "s12.test", "town 3", "under\\line", "50%", "_", "ÄRZTE", "x😀y", "no such lead", "st%st", "alder heating 7"]


def leads(r, keys):
    gap = lambda x: x if r.random() > 0.2 else None
    words = ["Alder", "alder_", "Birch", "under\\line", "50% off", "Ärzte", "x😀y", "al", "", "st"]
    return [(f"k{k}", gap(f"{r.choice(words)} {r.choice(['Heating', 'HEAT', 'Toys'])} {r.randrange(40)}"), gap(f"s{r.randrange(90)}.test"), gap(f"Town {r.randrange(9)}")) for k in keys]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Three batches: leads, more leads, and leads of both under new names."""
    r = random.Random(2)
    root, now = str(tmp_path_factory.mktemp("index")), {}
    for rows, part in ((leads(r, range(300)), 5_000_000), (leads(r, range(300, 360)), 50), (leads(r, range(280, 320)), 50)):
        SearchIndex(spark, root, buckets=8).add(spark.createDataFrame(rows, COLS), part)
        now |= {row[0]: row for row in rows}
    return root, spark.createDataFrame(list(now.values()), COLS)


@pytest.mark.parametrize("literal", [False, True])
def test_search_equals_the_scan(spark, index, literal):
    root, now = index
    found = SearchIndex(spark, root)
    for q in PATTERNS:
        want = sorted(r["lead_key"] for r in now.where(search_text(q, literal)).collect())
        assert sorted(r["lead_key"] for r in found.search(q, literal, lists=1 if literal else 4).collect()) == want, q


def test_runs():
    assert runs_of("Alder%1") == ["ald", "der", "lde"] and runs_of("a%b_cd") == [] and runs_of("a%b", literal=True) == ["a%b"]
    assert runs_of("") == [] and runs_of("aaaa") == ["aaa"]


def test_only_the_lists_asked_for_are_read(spark, index, tmp_path):
    """The candidates come out right where the folders of all other runs are missing."""
    root, _ = index
    store = SearchIndex(spark, root)
    want = sorted(r["lead_key"] for r in store.candidates(["bir", "irc"], 1).collect())
    kept = {f"bucket={b}" for b in store._buckets_of(spark.createDataFrame([("bir",), ("irc",)], "gram string"), "gram")}
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if "/postings/" in folder and n.startswith("bucket=") and n not in kept])
    assert want and sorted(r["lead_key"] for r in SearchIndex(spark, str(copy)).candidates(["bir", "irc"], 1).collect()) == want


def test_empty_and_unfinished(spark, tmp_path):
    store = SearchIndex(spark, str(tmp_path), buckets=4)
    assert store.search("alder").count() == 0 and store.search("a").count() == 0
    store.add(spark.createDataFrame([], COLS))
    assert store.search("alder").count() == 0
    store.add(spark.createDataFrame([("a", "Alder", None, None), ("b", None, None, None)], COLS))
    store._append("texts", "000000000009-broken", spark.createDataFrame([("a", "Birch", None, None), ("c", "Alder", None, None)], COLS))
    assert [r["lead_key"] for r in SearchIndex(spark, str(tmp_path)).search("ALDER").collect()] == ["a"]


def test_a_task_writes_a_bounded_part_of_the_postings(spark, tmp_path):
    """Postings hold hashes instead of keys, and no file holds many more than the bound, however many runs a bucket has."""
    rows = [(f"key-{k}", f"Alder Heating {k}", f"s{k}.test", "Town") for k in range(2_000)]
    SearchIndex(spark, str(tmp_path), buckets=4).add(spark.createDataFrame(rows, COLS), 4_000)
    postings = spark.read.parquet(f"{tmp_path}/postings")
    assert dict(postings.dtypes)["lead_key"] == "bigint"
    per_file = postings.groupBy(F.input_file_name().alias("file")).count().agg(F.max("count")).first()[0]
    assert per_file <= 4_000 and sorted(r["lead_key"] for r in SearchIndex(spark, str(tmp_path)).search("heating 77").collect()) == sorted(
        r[0] for r in rows if "heating 77" in r[1].lower())
