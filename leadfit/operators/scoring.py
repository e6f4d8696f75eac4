"""Scoring of whole lead tables, for one buy box or many."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions import scoring as sc

SCORE_COLUMNS = ["score", "tier", "confidence", "breakdown", "flags"]


def _score(df: DataFrame, icp: sc.IcpColumns, today: date) -> DataFrame:
    """Three narrow projections: component triples, then sums over them, then the tier."""
    lead = F.col
    sig = lambda name: F.col("signals")[name]
    keep = [c for c in df.columns if c not in SCORE_COLUMNS]

    parts = {k: F.col(f"_{k}") for k in sc.COMPONENTS}
    staged = df.select(*keep, *[sc.PARTS[k](lead, sig, icp, today).alias(f"_{k}") for k in sc.COMPONENTS])
    scored = staged.select(
        *keep,
        sc.final_score(sc.raw_score(parts, icp), sig).alias("score"),
        sc.confidence(parts).alias("confidence"),
        sc.breakdown(parts, icp).alias("breakdown"),
        sc.flags(lead, sig).alias("flags"),
    )
    return scored.withColumn("tier", sc.tier(F.col("score")))


def score_leads(leads: DataFrame, icp: dict | None, today: date) -> DataFrame:
    """Leads (with their `signals` struct, NULL before enrichment) plus score columns."""
    return _score(leads, sc.IcpColumns.fixed(icp), today)


def cross_params(leads: DataFrame, params: DataFrame) -> DataFrame:
    """Every lead with every buy box, which is what a sweep asks for.

    The planner broadcasts the buy boxes where their bytes are few, so leads are not moved, and
    splits both sides otherwise.
    """
    packed = params.select("icp_id", F.struct(*[c for c in params.columns if c != "icp_id"]).alias("icp"))
    return leads.crossJoin(packed)


def rescore_all(leads: DataFrame, params: DataFrame, today: date) -> DataFrame:
    """Scores of every lead under every buy box, from stored signals only: a map-only pass."""
    crossed = cross_params(leads, params)
    return _score(crossed, sc.IcpColumns.from_struct(F.col("icp")), today).drop("icp")
