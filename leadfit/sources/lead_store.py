"""A stored lead table that a batch changes only where it touches it.

Each batch adds the rows it inserts, the new state of the rows it fills, and the keys of both: domain to lead, name and
city to lead. All four lie in hash buckets, so a batch reads the key buckets of its own domains and names and the lead
buckets of what it matched, and writes nothing else. The list of finished batches is a versioned table; files of a batch
that never finished are not in it and are not read.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.operators.merging import fill_stored, match_keys, named_cities, new_leads, union_rows
from leadfit.operators.skew import HOT_ROWS
from leadfit.schemas import LEAD_FIELDS, LEAD_TABLE
from leadfit.sources.tables import VersionedTable, materialize

BUCKETS = 256
PARTS = {
    "inserted": LEAD_TABLE, "updated": LEAD_TABLE,
    "domains": {"domain": "string", "lead_key": "string"},
    "names": {"name_key": "string", "city": "string", "lead_key": "string", "seq": "string"},
}
BUCKET_OF = {"inserted": "lead_key", "updated": "lead_key", "domains": "domain", "names": "name_key"}


class LeadStore:
    """Leads in buckets below a root folder. The number of buckets is fixed by the first batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = VersionedTable(spark, f"{self.root}/commits")
        done = self._batches()
        self.buckets = done[0]["buckets"] if done else buckets

    def _batches(self) -> list:
        done = self.commits.read()
        return done.orderBy("batch_no").collect() if done is not None else []  # one line for each batch

    def versions(self) -> list[int]:
        return [r["batch_no"] for r in self._batches()]

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _part(self, name: str, batches: list, buckets: list[int] | None = None) -> DataFrame:
        schema = ", ".join(f"{c} {t}" for c, t in PARTS[name].items()) + ", batch string, bucket int"
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("batch").isin([r["folder"] for r in batches]))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _current(self, batches: list, buckets: list[int] | None = None) -> DataFrame:
        """Leads as they stand: the last state of those that were filled, the others as inserted."""
        updated = self._part("updated", batches, buckets)
        last = updated.groupBy("lead_key").agg(F.max_by(F.struct(*LEAD_TABLE), "batch").alias("r")).select("r.*")
        inserted = self._part("inserted", batches, buckets)
        return inserted.join(updated.select("lead_key").distinct(), "lead_key", "left_anti").select(*LEAD_TABLE).unionByName(last)

    def read(self) -> DataFrame | None:
        done = self._batches()
        return self._current(done) if done else None

    def changes(self, batch_no: int) -> tuple[DataFrame, DataFrame]:
        """The leads a batch changed as they were, and those it changed or inserted as they became. Input of `facet_deltas`."""
        done = self._batches()
        own = [r for r in done if r["batch_no"] == batch_no]
        updated = self._part("updated", own)
        earlier = [r for r in done if r["batch_no"] < batch_no]
        before = self._current(earlier, self._touched(updated, "lead_key")).join(updated.select("lead_key"), "lead_key", "left_semi")
        return before.select(*LEAD_TABLE), self._part("inserted", own).unionByName(updated).select(*LEAD_TABLE)

    def _touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets of the keys that occur: at most `buckets` numbers."""
        return [r["b"] for r in rows.where(F.col(key).isNotNull()).select(self._bucket(key).alias("b")).distinct().collect()]

    def _append(self, name: str, folder: str, rows: DataFrame) -> None:
        placed = rows.select(*PARTS[name], self._bucket(BUCKET_OF[name]).alias("bucket"))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={folder}")

    def upsert(self, incoming: DataFrame, batch_id: str, today: date, icp: dict | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
        """The batch's matches (incoming rows with `matched_key`) after writing what it changes: matched leads filled up,
        the others inserted, as `upsert_leads` does. `incoming` comes from `dedupe_merge`. A batch that is delivered
        again fills and adds nothing."""
        done = self._batches()
        batch_no = max((r["batch_no"] for r in done), default=0) + 1
        folder = f"{batch_no:012d}-{uuid.uuid4().hex}"
        merged = materialize(incoming, "batch")
        domains = self._part("domains", done, self._touched(merged, "domain")).select("domain", F.col("lead_key").alias("m1"))
        names = self._part("names", done, self._touched(merged, "name_key"))
        # a lead whose city was filled stands under its last name and city only
        names = names.groupBy("lead_key").agg(F.max_by(F.struct("name_key", "city", "seq"), "batch").alias("r")).select("lead_key", "r.*")
        matched = materialize(match_keys(merged, domains, named_cities(names), hot_rows), "batch-matched")
        hits = matched.where(F.col("matched_key").isNotNull()).select(F.col("matched_key").alias("lead_key")).distinct()
        before = self._current(done, self._touched(hits, "lead_key")).join(hits, "lead_key", "left_semi")
        filled = fill_stored(before.withColumn("_before", F.struct(*LEAD_FIELDS)), matched)
        updates = materialize(filled.where(~F.struct(*LEAD_FIELDS).eqNullSafe(F.col("_before"))), "batch-updates")
        inserts = materialize(new_leads(matched.where(F.col("matched_key").isNull()), batch_id, batch_no, icp, today), "batch-inserts")
        self._append("inserted", folder, inserts)
        self._append("updated", folder, updates)
        new_domains = updates.where(F.col("_before.domain").isNull()).select("domain", "lead_key")
        self._append("domains", folder, new_domains.unionByName(inserts.select("domain", "lead_key")).where(F.col("domain").isNotNull()))
        moved = updates.where(~F.struct("name_key", "city").eqNullSafe(F.struct("_before.name_key", "_before.city")))
        self._append("names", folder, union_rows(moved.select(*PARTS["names"]), inserts.select(*PARTS["names"])))
        lines = [(r["batch_no"], r["batch_id"], r["folder"], r["buckets"]) for r in done] + [(batch_no, batch_id, folder, self.buckets)]
        self.commits.write(self.spark.createDataFrame(lines, "batch_no long, batch_id string, folder string, buckets int").coalesce(1))
        return matched

    def compacted(self, root: str) -> LeadStore:
        """The same leads in a new store whose single batch holds their last states."""
        out = LeadStore(self.spark, root, self.buckets)
        leads = self.read()
        if leads is None:
            return out
        leads = materialize(leads, "leads")
        last = self._batches()[-1]
        folder = f"{last['batch_no']:012d}-{uuid.uuid4().hex}"
        out._append("inserted", folder, leads)
        out._append("updated", folder, leads.limit(0))
        out._append("domains", folder, leads.where(F.col("domain").isNotNull()))
        out._append("names", folder, leads)
        out.commits.write(self.spark.createDataFrame([(last["batch_no"], last["batch_id"], folder, self.buckets)], "batch_no long, batch_id string, folder string, buckets int").coalesce(1))
        return out
