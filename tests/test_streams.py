"""Streams of fetch results and of edits against the batch operators."""

import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadfit.operators.pages import store_fetches, urls_to_refetch
from leadfit.operators.views import apply_edits
from leadfit.streaming.edits import collect_edits, latest_edits
from leadfit.streaming.refetch import due_urls, follow_fetches

NOW = datetime(2026, 9, 16, 12)
FETCH = "url string, status int, fetched_at timestamp"
EDIT = "lead_key string, stage string, notes string, edited_at timestamp"


def arrive(spark, folder, batches, schema):
    """One file for each batch; one batch of the stream for each file."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ago(hours):
    return NOW - timedelta(hours=hours)


FETCHES = [
    ("old", 200, ago(80)), ("edge", 200, ago(72)), ("new", 200, ago(1)), ("busy", 503, ago(2)),
    ("again", 200, ago(90)), ("again", 200, ago(5)), ("worse", 200, ago(9)), ("worse", 429, ago(3)), ("better", 500, ago(9)), ("better", 200, ago(3)),
    ("mute", 0, ago(1)), ("kept", 200, ago(4)), ("kept", 0, ago(1)), ("bad", 404, ago(3)), (None, 200, ago(1)),
]
NEEDED = ["old", "edge", "new", "busy", "again", "worse", "better", "mute", "kept", "bad", "never", "new"]


@pytest.mark.parametrize("order", ["given", "reversed", "one", "mixed"])
def test_replayed_fetches_give_the_batch_answer(spark, tmp_path, order):
    tick = [(None, 0, NOW)]
    batches = {
        "given": [FETCHES[k::3] for k in range(3)] + [tick], "reversed": [FETCHES[::-1][k::3] for k in range(3)] + [tick],
        "one": [FETCHES + tick], "mixed": [FETCHES[8:], tick, FETCHES[:8], tick],
    }[order]
    log = str(tmp_path / "log")
    stream = arrive(spark, str(tmp_path / "in"), batches, FETCH)
    follow_fetches(stream, log, str(tmp_path / "state")).awaitTermination()
    needed = spark.createDataFrame([(u,) for u in NEEDED], "url string")
    got = sorted(r["url"] for r in due_urls(needed, spark.read.parquet(log)).collect())
    stored = store_fetches(spark.createDataFrame(FETCHES, FETCH))
    assert got == sorted(r["url"] for r in urls_to_refetch(needed, stored, NOW).collect())
    assert got == ["busy", "mute", "never", "old", "worse"]


def test_a_timer_ends_a_result_once(spark, tmp_path):
    log, state, folder = (str(tmp_path / x) for x in ("log", "state", "in"))
    needed = spark.createDataFrame([("a",), ("b",)], "url string")

    def after(rows):
        follow_fetches(arrive(spark, folder, [rows], FETCH), log, state).awaitTermination()
        return sorted(r["url"] for r in due_urls(needed, spark.read.parquet(log)).collect())

    assert after([("a", 200, ago(72)), ("b", 503, ago(72))]) == ["b"]
    assert after([(None, 0, NOW)]) == ["b"]  # just within the 72 hours
    assert after([(None, 0, NOW + timedelta(milliseconds=5))]) == ["a", "b"]
    assert after([("a", 200, ago(80))]) == ["a", "b"]  # too late to matter
    assert after([("a", 200, NOW)]) == ["b"]
    assert after([(None, 0, NOW + timedelta(hours=73))]) == ["a", "b"]
    turns = sorted((r["url"], r["fetched_at"], r["reason"]) for r in spark.read.parquet(log).collect())
    assert turns == [("a", ago(72), "expired"), ("a", ago(72), "usable"), ("a", NOW, "expired"), ("a", NOW, "usable"), ("b", ago(72), "retry")]


EDITS = [
    [("x", "new", None, ago(9)), ("y", None, "call", ago(30)), (None, "new", "", ago(1))],
    [("x", "passed", "", ago(12)), ("x", None, "b", ago(4)), ("y", "won", "later", ago(29.9)), ("z", "new", "n", None)],
    [("x", "shortlist", "a", ago(4)), ("y", None, None, ago(1)), ("x", "shortlist", "a", ago(4))],
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_edits_in_any_order_give_the_batch_answer(spark, tmp_path, order):
    leads = spark.createDataFrame([("x", "s", "n"), ("y", "s", "n"), ("w", "s", None)], "lead_key string, stage string, notes string")
    log = str(tmp_path / "log")
    stream = arrive(spark, str(tmp_path / "in"), [EDITS[k] for k in order], EDIT)
    collect_edits(stream, log, str(tmp_path / "state"), lateness="48 hours").awaitTermination()
    timed = spark.createDataFrame([e for batch in EDITS for e in batch], EDIT).where(F.col("edited_at").isNotNull())
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(apply_edits(leads, timed))
    assert rows(apply_edits(leads, latest_edits(spark, log))) == want
    assert want == [("w", "s", None), ("x", "shortlist", "b"), ("y", "won", "later")]


def test_edits_behind_the_watermark_are_refused(spark, tmp_path):
    log, state, folder = (str(tmp_path / x) for x in ("log", "state", "in"))
    # a batch drops what lies behind the watermark that the batch before it began with
    batches = [[("x", "new", None, ago(1))], [("y", "new", None, ago(1))], [("x", None, "too late", ago(20)), ("x", None, "in time", ago(3))]]
    query = collect_edits(arrive(spark, folder, batches, EDIT), log, state, lateness="10 hours")
    query.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    got = {k: v for r in latest_edits(spark, log).where("lead_key = 'x'").collect() for k, v in r.asDict().items() if k in ("stage", "notes") and v is not None}
    assert got == {"stage": "new", "notes": "in time"}


def test_no_edits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EDIT).parquet(str(tmp_path / "in"))
    collect_edits(stream, str(tmp_path / "log"), str(tmp_path / "state"), lateness="1 hour").awaitTermination()
    assert latest_edits(spark, str(tmp_path / "log")).isEmpty()
