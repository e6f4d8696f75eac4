"""A stored index for the text search over name, domain and city.

Postings tell which leads hold a run of three characters; they lie in folders by a hash of the run. A search reads the
postings of its rarest runs only, intersects them and checks what is left against the searched texts, which lie in folders
by a hash of the lead. A changed lead is added again: its old postings may still name it, the check then refuses it.
Postings hold that hash instead of the key, which is several times as long; leads of equal hash are told apart by the check.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.operators.brands import grams
from leadfit.operators.filters import search_text
from leadfit.sources.tables import VersionedTable, materialize

BUCKETS = 256
RUN = 3
SEARCHED = ("name", "domain", "city")
PARTS = {"postings": "gram string, lead_key long", "texts": "lead_key string, name string, domain string, city string", "counts": "gram string, n long"}
BUCKET_OF = {"postings": "gram", "texts": "lead_key", "counts": "gram"}


def runs_of(q: str, literal: bool = False) -> list[str]:
    """Runs of three characters that each hit must hold; none where the pattern has no such run between its wildcards."""
    pieces = [q.lower()] if literal else re.split("[%_]", q.lower())
    return sorted({p[k:k + RUN] for p in pieces for k in range(len(p) - RUN + 1)})


class SearchIndex:
    """Postings below a root folder. The number of buckets is fixed by the first batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = VersionedTable(spark, f"{self.root}/commits")
        lines = self._lines()
        self.buckets = lines[0]["buckets"] if lines else buckets

    def _lines(self) -> list:
        done = self.commits.read()
        return done.orderBy("batch").collect() if done is not None else []  # one line for each batch

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _part(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        schema, batches = f"{PARTS[name]}, batch string, bucket int", [r["batch"] for r in self._lines()]
        if not batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("batch").isin(batches))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _append(self, name: str, batch: str, rows: DataFrame, dealt: bool = False) -> None:
        """Each bucket is written by one task; rows that are dealt already stay in their tasks, and each writes all its buckets."""
        placed = rows.withColumn("bucket", self._bucket(BUCKET_OF[name]))
        if not dealt:
            placed = placed.repartition("bucket")
        placed.sortWithinPartitions("bucket", BUCKET_OF[name]).write.partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch}")

    def add(self, leads: DataFrame, rows_of_a_part: int = 5_000_000) -> None:
        """Indexes new leads and leads whose name, domain or city changed: lead_key, unique in a batch, and the three columns.

        Leads are dealt to tasks so that each has about `rows_of_a_part` postings at most, which it sorts and writes; only the
        texts are shuffled.
        """
        lines = self._lines()
        batch = f"{len(lines) + 1:012d}-{uuid.uuid4().hex}"
        texts = materialize(leads.select("lead_key", *SEARCHED), "search-texts")
        # a text has fewer runs than characters
        most = texts.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in SEARCHED), F.lit(0).cast("bigint")))).first()[0] or 0
        held = F.array_distinct(F.concat(*[F.coalesce(grams(F.lower(c), RUN), F.array().cast("array<string>")) for c in SEARCHED]))
        dealt = texts.repartition(1 + most // rows_of_a_part, "lead_key")
        self._append("texts", batch, texts)
        self._append("postings", batch, dealt.select(F.explode(held).alias("gram"), F.xxhash64("lead_key").alias("lead_key")), dealt=True)
        written = self.spark.read.schema("gram string").parquet(f"{self.root}/postings/batch={batch}")
        self._append("counts", batch, written.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        lines = [(r["batch"], r["buckets"]) for r in lines] + [(batch, self.buckets)]
        self.commits.write(self.spark.createDataFrame(lines, "batch string, buckets int").coalesce(1))

    def _texts(self, hashes: DataFrame | None = None) -> DataFrame:
        """The last texts of all leads, or of those whose hash is listed."""
        if hashes is None:
            rows = self._part("texts")
        else:
            asked = F.pmod("hash", F.lit(self.buckets)).cast("int")
            buckets = [r["b"] for r in hashes.select(asked.alias("b")).distinct().collect()]  # at most `buckets` numbers
            rows = self._part("texts", buckets).where(F.col("lead_key").isNotNull()).withColumn("hash", F.xxhash64("lead_key")).join(hashes, "hash", "left_semi")
        return rows.groupBy("lead_key").agg(F.max_by(F.struct(*SEARCHED), "batch").alias("t")).select("lead_key", "t.*")

    def _buckets_of(self, rows: DataFrame, key: str) -> list[int]:
        """At most `buckets` numbers."""
        return [r["b"] for r in rows.select(self._bucket(key).alias("b")).distinct().collect()]

    def _hashes(self, runs: list[str], lists: int) -> DataFrame:
        """hash of the leads that hold the rarest `lists` of the runs, by the postings of these runs alone."""
        asked = self.spark.createDataFrame([(g,) for g in runs], "gram string")
        counts = self._part("counts", self._buckets_of(asked, "gram")).where(F.col("gram").isin(runs))
        sizes = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one line for each run asked for
        rarest = sorted(runs, key=lambda g: (sizes.get(g, 0), g))[:lists]
        chosen = self.spark.createDataFrame([(g,) for g in rarest], "gram string")
        postings = self._part("postings", self._buckets_of(chosen, "gram")).where(F.col("gram").isin(rarest))
        # a lead may hold a run in several batches
        found = postings.groupBy(F.col("lead_key").alias("hash")).agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest))
        return materialize(found.select("hash"), "search-candidates")

    def candidates(self, runs: list[str], lists: int = 4) -> DataFrame:
        """Leads that hold the rarest `lists` of the runs; their postings alone are read."""
        return self._texts(self._hashes(runs, lists)).select("lead_key")

    def search(self, q: str, literal: bool = False, lists: int = 4) -> DataFrame:
        """lead_key of the leads that `search_text` finds.

        A pattern without three characters in a row reads all texts, as the scan does, but no other columns.
        """
        runs = runs_of(q, literal)
        texts = self._texts(self._hashes(runs, lists)) if runs else self._texts()
        return texts.where(search_text(q, literal)).select("lead_key")
