"""Edits of leads as they come in, in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDIT_FIELDS = ("stage", "notes")


def latest_by_span(edits: DataFrame, lateness: str, span: str = "1 hour") -> DataFrame:
    """Stream of edits (lead_key, stage, notes, edited_at) -> the latest value of each lead and field in each span of time.

    State: one value for each lead, field and span that the watermark has not passed; `lateness` behind the newest edit a
    span is closed, and edits that come later, from the next batch on, are refused (`numRowsDroppedByWatermark` of the
    query's progress). Equal
    times go to the larger value, as in `apply_edits`. NULL is no edit; edits without time or lead are left out.
    """
    rows = edits.where(F.col("lead_key").isNotNull()).withWatermark("edited_at", lateness).select(
        "lead_key", "edited_at", F.explode(F.create_map(*(x for f in EDIT_FIELDS for x in (F.lit(f), F.col(f))))).alias("field", "value"))
    return rows.where(F.col("value").isNotNull()).groupBy("lead_key", "field", F.window("edited_at", span)).agg(
        F.max(F.struct("edited_at", "value")).alias("last")).select("lead_key", "field", "last.*")


def collect_edits(edits: DataFrame, log: str, checkpoint: str, lateness: str, span: str = "1 hour") -> StreamingQuery:
    """Appends what a batch of edits changes to `log`; ends when none is left. Pass edits through `validate_edit` before.

    A batch that is repeated after a failure writes its own folder again.
    """
    spans = latest_by_span(edits, lateness, span)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log.rstrip('/')}/epoch={epoch}")

    # a log without edits can be read too
    write(edits.sparkSession.createDataFrame([], spans.schema), -1)
    return (
        spans.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_edits(spark: SparkSession, log: str) -> DataFrame:
    """(lead_key, edited_at, stage, notes) with the last value of each lead and field, one row each: input of `apply_edits`."""
    rows = spark.read.parquet(log)
    last = rows.groupBy("lead_key", "field").agg(F.max(F.struct("edited_at", "value")).alias("last"))
    return last.select(
        "lead_key", "last.edited_at", *(F.when(F.col("field") == f, F.col("last.value")).alias(f) for f in EDIT_FIELDS))
