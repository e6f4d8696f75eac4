"""Intermediate tables and versioned lead tables on shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared checkpoint folder.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leadfit-")
    return f"{base.rstrip('/')}/leadfit/{name}-{uuid.uuid4().hex}"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Generated code in methods that HotSpot compiles; the session's own setting stands again afterwards.

    A projection of many long expressions becomes one method. Above 8,000 bytes HotSpot only interprets it, at several
    times the CPU for each row, while Spark by default allows 65,535. Below the limit such a projection is split instead.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    own = spark.conf.get(key)
    spark.conf.set(key, str(min(int(own), 8_000)))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: cuts the plan at a Parquet table that outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    with compiled_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A Parquet table as numbered version folders; readers take the newest finished one.

    A version is never overwritten, so a job may read the table it is about to replace.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        done = []
        for entry in fs.listStatus(root):
            path = entry.getPath()
            if path.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                done.append(int(path.getName()[1:]))
        return sorted(done)

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.root}/v{done[-1]:012d}") if done else None

    def write(self, df: DataFrame) -> DataFrame:
        done = self.versions()
        path = f"{self.root}/v{(done[-1] if done else 0) + 1:012d}"
        # an unfinished folder of a failed run has no _SUCCESS marker and may be replaced
        with compiled_methods(df.sparkSession):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
