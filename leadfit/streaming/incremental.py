"""New lead files picked up as they arrive."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadfit.plans.importing import import_canonical
from leadfit.sources.lead_files import scan_lead_files
from leadfit.sources.lead_store import LeadStore
from leadfit.sources.tables import VersionedTable


FILES_PER_BATCH = 1_000  # names of one batch's files come to the driver


def incremental_import(
    spark: SparkSession, folder: str, table: VersionedTable | LeadStore, checkpoint: str, today: date, files_per_batch: int = FILES_PER_BATCH,
    multi_line: bool = True,
) -> StreamingQuery:
    """Every new CSV file in `folder` goes through import and upsert; ends when none is left.

    The stream only says which files are new; each is then read by its own header and delimiter. The
    upsert makes a file that is delivered twice add nothing, whatever the checkpoint knows. Files
    that wait together are merged as one batch, up to `files_per_batch` of them. In a versioned
    table each batch writes all leads anew; a lead store writes only what the batch changes. Files
    known to have no quoted line breaks are read once with `multi_line=False`.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    starts = reader.text(folder).where(F.col("_metadata.file_block_start") == 0).select(F.col("_metadata.file_path").alias("file"))

    def upsert(batch: DataFrame, epoch: int) -> None:
        files = [r["file"] for r in batch.distinct().orderBy("file").collect()]
        if files:
            import_canonical(table, scan_lead_files(spark, *files, multi_line=multi_line), f"stream-{epoch}", today)

    return (
        starts.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
