"""Buy-box parameters as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.functions.scoring import complete_icp
from leadfit.functions.text import str_array
from leadfit.schemas import ICP


def params_row(spark: SparkSession, icp: dict | None = None, icp_id: int = 0) -> DataFrame:
    """One buy box as a one-row table."""
    row = spark.range(1).select(F.lit(icp_id).alias("icp_id"), _icp_struct(complete_icp(icp)).alias("icp"))
    return row.select("icp_id", "icp.*")


def _icp_struct(full: dict) -> Column:
    weights = F.map_from_arrays(str_array(full["weights"]), F.array(*[F.lit(w) for w in full["weights"].values()]))
    return F.struct(
        str_array(full["target_industries"]).alias("target_industries"),
        F.lit(full["employees_min"]).alias("employees_min"), F.lit(full["employees_max"]).alias("employees_max"),
        F.lit(full["min_years"]).alias("min_years"), weights.alias("weights"),
    ).cast(ICP)


def read_params(stored: DataFrame) -> DataFrame:
    """settings(key, value JSON) -> buy box of key 'icp' over the defaults, top-level keys only."""
    # an aggregate has one row even when no setting is stored
    given = stored.where(F.col("key") == "icp").agg(F.max("value").alias("value")).select(
        F.from_json("value", ICP).alias("given"))
    base = _icp_struct(complete_icp(None))
    both = given.select("given", base.alias("base"))
    fields = ["target_industries", "employees_min", "employees_max", "min_years", "weights"]
    return both.select(F.lit(0).alias("icp_id"), *[F.coalesce(f"given.{f}", f"base.{f}").alias(f) for f in fields])
