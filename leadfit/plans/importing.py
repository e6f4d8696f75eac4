"""End to end: a lead file or table -> merged, upserted lead table and report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit.operators.merging import dedupe_merge, report_of_merged, upsert_leads
from leadfit.sources.lead_files import canonical_rows, normalize_leads, scan_lead_files
from leadfit.sources.lead_store import LeadStore
from leadfit.sources.tables import VersionedTable, materialize


def merged_leads(raw: DataFrame) -> DataFrame:
    """Raw rows with an `ord` column -> one row per company."""
    return dedupe_merge(normalize_leads(canonical_rows(raw)))


def import_rows(table: VersionedTable | LeadStore, raw: DataFrame, batch_id: str, today: date, icp: dict | None = None) -> DataFrame:
    """Merge a batch into the stored table: a versioned table gets its next version, a store what the batch changes."""
    return _import_merged(table, merged_leads(raw), batch_id, today, icp)


def import_canonical(table: VersionedTable | LeadStore, rows: DataFrame, batch_id: str, today: date, icp: dict | None = None) -> DataFrame:
    """As `import_rows`, for rows of `scan_lead_files`, whose cells are mapped and cleaned already."""
    return _import_merged(table, dedupe_merge(normalize_leads(rows)), batch_id, today, icp)


def import_with_report(
    table: VersionedTable | LeadStore, raw: DataFrame, batch_id: str, today: date, icp: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The leads after the batch and its `import_report`, from one pass over the raw rows.

    The merge counts what it merges, and both the leads and the report are taken from its written result; so the counts
    are right also where tasks run twice."""
    rows = normalize_leads(canonical_rows(raw), named_only=False)
    merged = materialize(dedupe_merge(rows, counts=True), "merged")
    leads = merged.where(F.col("key").isNotNull()).drop("n_rows", "n_without_site")
    return _import_merged(table, leads, batch_id, today, icp), report_of_merged(merged)


def _import_merged(table: VersionedTable | LeadStore, merged: DataFrame, batch_id: str, today: date, icp: dict | None) -> DataFrame:
    if isinstance(table, LeadStore):
        table.upsert(merged, batch_id, today, icp)
        return table.read()
    batch_no = max(table.versions(), default=0) + 1  # old versions may have been removed
    return table.write(upsert_leads(table.read(), merged, batch_id, batch_no, today, icp))


def import_csv(
    spark: SparkSession, table: VersionedTable | LeadStore, path: str, batch_id: str, today: date, icp: dict | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Files known to have no quoted line breaks are read once with multi_line=False."""
    return import_canonical(table, scan_lead_files(spark, path, multi_line=multi_line), batch_id, today, icp)
