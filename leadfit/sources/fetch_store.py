"""A stored page table that batches of fetches are merged into, without moving their HTML.

Each batch is written once, as it comes, as a segment whose rows are numbered. Which row of which segment is the current
one of a url stands in a narrow table of heads, in hash buckets of the url; only heads are aggregated, joined and
replaced. Segments without outdated rows are read as they are, the others are joined with the heads by row number.
The list of segments is a versioned table; files of a batch that never finished are not in it and are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.schemas import PAGE_FETCHES, conform
from leadfit.sources.tables import VersionedTable, materialize

BUCKETS = 256
HEADS = "url string, fetched_at timestamp, row_hash long, segment string, row_no long, status int, batch string, bucket int"
LINES = "segment_no long, segment string, n_rows long, live long, buckets int"


class FetchStore:
    """Fetch results by url below a root folder: the latest one of each url counts.

    `fields` are the columns kept, among them url, status and fetched_at. The number of buckets is fixed by the first batch.
    """

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, str] = PAGE_FETCHES, buckets: int = BUCKETS):
        self.spark, self.root, self.fields = spark, root.rstrip("/"), fields
        self.commits = VersionedTable(spark, f"{self.root}/commits")
        lines = self._lines()
        self.buckets = lines[0]["buckets"] if lines else buckets

    def _lines(self) -> list:
        done = self.commits.read()
        return done.orderBy("segment_no").collect() if done is not None else []  # one line for each segment

    def segments(self) -> dict[str, tuple[int, int]]:
        """Rows and current rows of each segment that is in use."""
        return {r["segment"]: (r["n_rows"], r["live"]) for r in self._lines()}

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, urls: DataFrame) -> list[int]:
        """Buckets of the urls that occur: at most `buckets` numbers."""
        return [r["b"] for r in urls.select(self._bucket("url").alias("b")).distinct().collect()]

    def _rows(self, segments: list[str]) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in self.fields.items()) + ", row_hash long, row_no long, segment string"
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows").where(F.col("segment").isin(segments))

    def _heads(self, lines: list, buckets: list[int] | None = None) -> DataFrame:
        if not lines:
            return self.spark.createDataFrame([], HEADS).drop("batch", "bucket")
        rows = self.spark.read.schema(HEADS).parquet(f"{self.root}/heads").where(F.col("batch").isin([r["segment"] for r in lines]))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        last = F.max(F.struct("fetched_at", "row_hash", "segment", "row_no", "status"))
        return rows.groupBy("url").agg(last.alias("r")).select("url", "r.*")

    def heads(self) -> DataFrame:
        """url, status and time of what is stored; reads no HTML. Input of `urls_to_refetch`."""
        return self._heads(self._lines()).select("url", "status", "fetched_at")

    def read(self, urls: DataFrame | None = None) -> DataFrame:
        """The current result of every url, or of the given ones (column `url`); no rows before the first batch."""
        lines = self._lines()
        if urls is None:
            whole = [r["segment"] for r in lines if r["live"] == r["n_rows"]]
            mixed = [r["segment"] for r in lines if r["live"] < r["n_rows"]]
            out = self._rows(whole)
            if mixed:
                heads = self._heads(lines).where(F.col("segment").isin(mixed)).select("segment", "row_no")
                out = out.unionByName(self._rows(mixed).join(heads, ["segment", "row_no"], "left_semi"))
            return out.select(*self.fields)
        asked = materialize(urls.select("url").where(F.col("url").isNotNull()).distinct(), "urls-asked")
        heads = materialize(self._heads(lines, self._touched(asked)).join(asked, "url", "left_semi"), "heads-asked")
        held = [r["segment"] for r in heads.select("segment").distinct().collect()]  # at most one for each segment
        return self._rows(held).join(heads.select("segment", "row_no"), ["segment", "row_no"], "left_semi").select(*self.fields)

    def upsert(self, fetches: DataFrame) -> int:
        """Merges a batch and returns how many urls have a new current result.

        Results without a response (status 0) and rows without url or status are not stored. Of several results of a url
        the latest counts, of one time that with the larger hash of its columns, in a batch and beside what is stored;
        a result without a time is older than all others. So a batch that is delivered again changes nothing.
        """
        lines = self._lines()
        number = max((r["segment_no"] for r in lines), default=0) + 1
        segment = f"{number:012d}-{uuid.uuid4().hex}"
        rows = conform(fetches, self.fields).where((F.col("status") != 0) & F.col("url").isNotNull())
        rows = rows.withColumn("row_hash", F.xxhash64(*[c for c in self.fields if c != "url"]))
        rows.withColumn("row_no", F.monotonically_increasing_id()).write.parquet(f"{self.root}/rows/segment={segment}")
        written = self._rows([segment])  # the numbers as written: they outlive any task

        newest = F.max(F.struct("fetched_at", "row_hash", "row_no", "status"))
        batch = materialize(written.groupBy("url").agg(newest.alias("n")), "fetch-batch")
        before = self._heads(lines, self._touched(batch) if lines else None).select("url", F.col("segment").alias("replaced"), F.struct("fetched_at", "row_hash").alias("old"))
        newer = F.col("replaced").isNull() | (F.struct("n.fetched_at", "n.row_hash") > F.col("old"))
        changed = materialize(batch.join(before, "url", "left").where(newer).select("url", "n.*", "replaced"), "fetch-changes")
        counts = {r["replaced"]: r["n"] for r in changed.groupBy("replaced").agg(F.count(F.lit(1)).alias("n")).collect()}
        live = sum(counts.values())
        if not live:
            return 0  # the segment is not listed and never read
        placed = changed.select("url", "fetched_at", "row_hash", F.lit(segment).alias("segment"), "row_no", "status", self._bucket("url").alias("bucket"))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/heads/batch={segment}")
        kept = [(r["segment_no"], r["segment"], r["n_rows"], r["live"] - counts.get(r["segment"], 0), r["buckets"]) for r in lines]
        # a segment without current rows leaves the list: each of its urls has a newer head
        kept = [r for r in kept if r[3]] + [(number, segment, written.count(), live, self.buckets)]
        self.commits.write(self.spark.createDataFrame(kept, LINES).coalesce(1))
        return live

    def compacted(self, root: str) -> FetchStore:
        """The same results in a new store of one segment without outdated rows."""
        out = FetchStore(self.spark, root, self.fields, self.buckets)
        out.upsert(self.read())
        return out
