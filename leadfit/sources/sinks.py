"""Exports and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit.operators import facets
from leadfit.operators.pages import store_fetches
from leadfit.operators.views import crm_columns, lead_detail, lead_view, sort_leads
from leadfit.sources.tables import materialize


def crm_export(leads: DataFrame) -> DataFrame:
    """CRM rows, best score first."""
    return crm_columns(sort_leads(leads))


def export_crm_csv(leads: DataFrame, path: str, single_file: bool = False) -> None:
    """Sorted CSV parts whose names follow the order; one file only when the caller asks for it."""
    out = crm_export(leads)
    out = out.coalesce(1) if single_file else out
    out.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"') \
        .option("emptyValue", "").csv(path)


def write_snapshot_json(leads: DataFrame, params: DataFrame, path: str) -> None:
    """leads/, details/ and raw_industries/ as JSON lines (gzip), stats/ and settings/ as one document each."""
    leads = materialize(leads, "snapshot-leads")  # read five times
    lead_view(sort_leads(leads)).write.json(f"{path}/leads", compression="gzip")
    lead_detail(leads).write.json(f"{path}/details", compression="gzip")
    leads.select("lead_key", "industry").write.option("ignoreNullFields", False).json(f"{path}/raw_industries", compression="gzip")
    facets.stats(leads).write.json(f"{path}/stats")
    params.write.json(f"{path}/settings")


def write_fetches(fetches: DataFrame, path: str) -> None:
    store_fetches(fetches).write.mode("errorifexists").parquet(path)


SCORE_TABLE = ["lead_key", "score", "tier", "confidence", "breakdown", "flags"]


def store_scores(scored: DataFrame, path: str) -> DataFrame:
    """Scores apart from signals, so that a new buy box rewrites only this table."""
    scored.select(*SCORE_TABLE).write.mode("errorifexists").parquet(path)
    return scored.sparkSession.read.parquet(path)
