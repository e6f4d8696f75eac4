"""Counts that follow changes against counts of the whole table."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from leadfit.operators import facets
from leadfit.operators.views import apply_edits
from leadfit.schemas import LEAD_TABLE
from leadfit.sources.facet_counts import FacetCounts
from leadfit.sources.lead_store import LeadStore
from leadfit.sources.tables import materialize
from tests.test_lead_store import batch, some_rows

DAY = date(2026, 9, 16)


def same(counts, leads):
    assert facets.stats_of_counts(counts.read()).collect() == facets.stats(leads).collect()
    assert facets.industries_of_counts(counts.read()).collect() == facets.distinct_industries(leads).collect()


def test_batches_and_edits_against_a_recount(spark, tmp_path):
    """Three batches of a store, then edits, one lead of which is deleted; each counted as it comes."""
    r = random.Random(7)
    store, counts = LeadStore(spark, str(tmp_path / "leads"), buckets=4), FacetCounts(spark, str(tmp_path / "counts"))
    for n, rows in enumerate([some_rows(r, 200, of=150), some_rows(r, 60, first=100, of=120), some_rows(r, 9, of=40)], 1):
        store.upsert(batch(spark, rows), f"b{n}", DAY)
        before, after = store.changes(n)
        assert after.count() <= len(rows) and before.count() <= after.count()
        assert counts.apply(f"b{n}", before, after)
        same(counts, store.read())
    leads = materialize(store.read(), "leads")
    keys = [row["lead_key"] for row in leads.select("lead_key").orderBy("lead_key").limit(30).collect()]
    rows = [(k, r.choice(["shortlist", "passed", None]), r.choice(["note", "", None]), datetime(2026, 1, 1) + timedelta(hours=r.randrange(9))) for k in keys * 3]
    edits = spark.createDataFrame(rows, "lead_key string, stage string, notes string, edited_at timestamp")
    touched = leads.join(edits.select("lead_key").distinct(), "lead_key", "left_semi")
    assert counts.apply("edits", touched, apply_edits(touched, edits))
    edited = materialize(apply_edits(leads, edits), "edited")
    same(counts, edited)
    gone = edited.where(edited["lead_key"] == keys[0])
    assert counts.apply("gone", gone, edited.limit(0))
    same(counts, edited.where(edited["lead_key"] != keys[0]))


def test_a_change_counts_once_and_values_leave(spark, tmp_path):
    counts = FacetCounts(spark, str(tmp_path))
    assert counts.read().count() == 0 and facets.stats_of_counts(counts.read()).first()["total"] == 0
    schema = ", ".join(f"{c} {t}" for c, t in LEAD_TABLE.items())
    row = lambda **of: tuple(of.get(c) for c in LEAD_TABLE)
    one = spark.createDataFrame([row(lead_key="a", status="pending", tier="A", industry="Toys"), row(lead_key="b", status="enriched", tier="B", email_status="valid")], schema)
    assert counts.apply("x", None, one) and not counts.apply("x", None, one)
    same(counts, one)
    done = spark.createDataFrame([row(lead_key="a", status="failed", tier="A", stage="new")], schema)
    assert counts.apply("y", one.where("lead_key = 'a'"), done)
    same(counts, one.where("lead_key = 'b'").unionByName(done))
    assert "Toys" not in [r["value"] for r in counts.read().collect()] and counts.read().where("n <= 0").count() == 0
    assert sorted(r["change"] for r in counts.changes().collect()) == ["x", "y"]
    assert counts.apply("empty", None, one.limit(0))
    same(counts, one.where("lead_key = 'b'").unionByName(done))


def test_narrow_columns_give_the_same_facets(spark):
    """Counting needs neither breakdowns nor the signals' texts; what is rewritten at each change goes without them."""
    values = [("a", "enriched", "A", "new", "valid", "Toys", (True, False, None)), ("b", "failed", "B", None, None, None, (None, True, "HVAC")),
              ("c", "pending", None, "new", "role", "", (None, None, "HVAC"))]
    leads = spark.createDataFrame(
        values, "lead_key string, status string, tier string, stage string, email_status string, industry string, "
                "signals struct<succession:boolean,family_owned:boolean,industry_guess:string>")
    wide = leads.withColumns({c: F.lit("x") for c in ("breakdown", "flags", "brief", "notes")}).withColumn(
        "signals", F.col("signals").withField("description", F.lit("long text")))
    narrow = facets.facet_columns(wide, "notes")
    assert narrow.columns == ["lead_key", "status", "tier", "stage", "email_status", "industry", "signals", "notes"]
    assert narrow.select("signals.*").columns == ["succession", "family_owned", "industry_guess"]
    rows = sorted(map(tuple, facets.facet_rows(wide).collect()))
    assert sorted(map(tuple, facets.facet_rows(narrow).collect())) == rows and len(rows) > 9
