"""What keeps the shared steps of the lead flow in proportion to their rows."""

from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from leadfit.operators import contacts
from leadfit.operators.merging import new_leads
from leadfit.operators.skew import balanced_left_join
from leadfit.plans import importing
from leadfit.plans.enrichment import enrich_leads
from leadfit.schemas import LEAD_FIELDS, SIGNALS
from leadfit.sources.tables import VersionedTable, compiled_methods, materialize

DAY = date(2026, 9, 16)
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_tables_are_written_by_compiled_methods(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        seen.append(spark.conf.get(LIMIT))
        write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    own = spark.conf.get(LIMIT)
    assert materialize(spark.range(3), "t").count() == 3
    assert VersionedTable(spark, str(tmp_path / "v")).write(spark.range(4)).count() == 4
    assert seen == ["8000", "8000"] and spark.conf.get(LIMIT) == own


def test_the_session_keeps_its_own_limit(spark):
    own = spark.conf.get(LIMIT)
    with pytest.raises(AnalysisException), compiled_methods(spark):
        spark.table("no_such_table")
    assert spark.conf.get(LIMIT) == own
    spark.conf.set(LIMIT, "4000")
    with compiled_methods(spark):
        assert spark.conf.get(LIMIT) == "4000"
    assert spark.conf.get(LIMIT) == "4000"
    spark.conf.set(LIMIT, own)


def test_a_frequent_key_is_split_among_tasks(spark):
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        left = spark.range(400_000).select("id", F.lit("mail.example").alias("k"))
        right = spark.createDataFrame([("mail.example", 1)], "k string, v int")
        got = balanced_left_join(left, right, ["k"], ["id"]).groupBy(F.spark_partition_id()).agg(
            F.count("v").alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in got) == 400_000 and max(r["n"] for r in got) < 400_000


def test_frequent_hosts_are_counted_before_signals_are_joined(spark, monkeypatch):
    sources, join = [], contacts.balanced_left_join

    def spy(*args, **kwargs):
        sources.append(kwargs["hot_source"])
        return join(*args, **kwargs)

    monkeypatch.setattr(contacts, "balanced_left_join", spy)
    fields = ", ".join(f"{f} {t}" for f, t in LEAD_FIELDS.items())
    rows = [{"name": "a", "domain": "a.test", "email": "A@One.test"}, {"name": "b", "domain": "b.test"}, {"name": "c"}]
    raw = spark.createDataFrame([(n, str(n), *[r.get(f) for f in LEAD_FIELDS]) for n, r in enumerate(rows)], f"ord long, key string, {fields}")
    leads = new_leads(raw, "b1", 1, None, DAY)
    signals = F.from_json(F.lit('{"reachable": true, "emails": ["x@two.test"]}'), SIGNALS).alias("signals")
    site = spark.createDataFrame([("b.test",)], "domain string").select("domain", signals)
    mx = spark.createDataFrame([("one.test", True), ("two.test", False)], "host string, has_mx boolean")
    got = {r["name"]: (r["email"], r["email_status"]) for r in enrich_leads(leads, site, mx, DAY).collect()}
    assert got == {"a": ("A@One.test", "valid"), "b": ("x@two.test", "invalid"), "c": (None, None)}
    hosts, = sources
    assert sorted(str(r[0]) for r in hosts.collect()) == ["None", "None", "one.test", "two.test"]
    assert "Join" not in hosts._jdf.queryExecution().analyzed().toString()


def test_scanned_cells_are_cleaned_once(spark, tmp_path, monkeypatch):
    def again(rows):
        raise AssertionError("cells of a scan are clean")

    monkeypatch.setattr(importing, "canonical_rows", again)
    (tmp_path / "a.csv").write_text("Company,Town,URL\n  Oak   grove ,, oak.test\nOak, Kiel,www.oak.test\n , Ulm,\n")
    leads = importing.import_csv(spark, VersionedTable(spark, str(tmp_path / "t")), str(tmp_path / "a.csv"), "b1", DAY)
    assert [(r["name"], r["city"], r["domain"]) for r in leads.collect()] == [("Oak grove", "Kiel", "oak.test")]
