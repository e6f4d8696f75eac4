"""Helpers shared by the corpus operators: the shared folder, written tables, given tables, learning folds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, where all is one machine, may go without the setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="leadfit-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def with_package(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...), after telling Python workers where this package lies, for sessions started without it on their
    path. On a cluster the package is installed or sent with --py-files; the path then points to nothing and is passed over."""
    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        return query(spark, *args)

    return run


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage and outlives lost executors.

    group_bytes bounds a row group, and so what a reading task holds at once of tables with large cells.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leadfit-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of docs can't clash with those that an operator adds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts: the fold that a document belongs to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sampled_labels(labels: DataFrame, label: str, per_class: int, parts: int = 0, held_out: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """At most per_class rows (doc_id, label) of each class, first by a hash of the id, and the size of each whole class.

    With parts, ids whose fold is held_out are left out. Rows without id or label are left out too; of several labels of
    one id the highest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if parts:
        rows = rows.where(id_remainder(F.col("doc_id").cast("long"), parts) != held_out)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one, two = (rows.where(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1))
    return one.unionByName(two), sizes


def sampled_texts(docs: DataFrame, sample: DataFrame, found: dict[str, Column]) -> DataFrame:
    """(doc_id, label, and what found names) of the sampled ids, one row of each: of several texts of one id that of the
    smallest hash. found is worked out from the column text before the shuffle. The sample is bounded by its limit, so it
    goes to every scan task."""
    rows = texts_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("hash"), *(c.alias(n) for n, c in found.items()))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", *found), F.struct("hash", *found)).alias("one"))
    return one.select("doc_id", "one.*")
