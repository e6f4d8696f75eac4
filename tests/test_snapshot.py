"""The snapshot of scored leads as files."""

from pathlib import Path

from leadfit.schemas import LEAD_TABLE, conform
from leadfit.sources.sinks import write_snapshot_json


def test_rows_are_written_compressed(spark, tmp_path):
    """Lines of leads are gzip files that read back whole, rows without an industry too; the two documents are plain."""
    rows = spark.createDataFrame([("a", "Toys"), ("b", None)], "lead_key string, industry string")
    write_snapshot_json(conform(rows, LEAD_TABLE), spark.range(1), str(tmp_path / "out"))
    for name, end in (("leads", ".json.gz"), ("details", ".json.gz"), ("raw_industries", ".json.gz"), ("stats", ".json"), ("settings", ".json")):
        parts = [p.name for p in Path(tmp_path / "out" / name).glob("part-*")]
        assert parts and all(p.endswith(end) for p in parts), name
    back = spark.read.schema("lead_key string, industry string").json(str(tmp_path / "out" / "raw_industries"))
    assert sorted(map(tuple, back.collect()), key=str) == [("a", "Toys"), ("b", None)]
    assert spark.read.schema("lead_key string").json(str(tmp_path / "out" / "details")).count() == 2
