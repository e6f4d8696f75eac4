"""Predicates over scored leads, and checks of edits and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def search_text(q: str, literal: bool = False) -> Column:
    """Name, domain or city contains `q`, case ignored. % and _ are wildcards unless `literal`."""
    cols = [F.lower(c) for c in ("name", "domain", "city")]
    needle = q.lower()
    pattern = "%" + needle.replace("\\", "\\\\") + "%"  # a backslash stands for itself
    return _any([c.contains(needle) if literal else c.like(pattern) for c in cols])


def tier_in(tiers: str) -> Column:
    wanted = [t.strip().upper() for t in tiers.split(",") if t.strip()]
    return F.col("tier").isin(wanted) if wanted else F.lit(False)


def min_score(floor: int) -> Column:
    return F.col("score") >= floor


def industry_eq(industry: str) -> Column:
    """On the imported industry, not the one guessed from the site."""
    return F.lower("industry") == industry.lower()


def stage_in(stages: str) -> Column:
    return F.col("stage").isin(stages.split(","))


def has_direct_email() -> Column:
    return F.coalesce(F.col("email_status").isin(fv.DIRECT_EMAIL_STATUSES), F.lit(False))


def owner_transition() -> Column:
    return _any([F.col("signals.succession"), F.col("signals.family_owned")])


def status_eq(status: str) -> Column:
    return F.col("status") == status


def filter_leads(
    leads: DataFrame, *, q: str | None = None, tiers: str | None = None, min_score_: int = 0,
    industry: str | None = None, stage: str | None = None, has_email: bool = False,
    succession: bool = False, status: str | None = None, literal: bool = False,
) -> DataFrame:
    """All given conditions together; an empty or zero argument switches its condition off."""
    conditions = [
        search_text(q, literal) if q else None,
        tier_in(tiers) if tiers else None,
        min_score(min_score_) if min_score_ else None,
        industry_eq(industry) if industry else None,
        stage_in(stage) if stage else None,
        has_direct_email() if has_email else None,
        owner_transition() if succession else None,
        status_eq(status) if status else None,
    ]
    for c in conditions:
        if c is not None:
            leads = leads.where(c)
    return leads


def select_for_enrichment(leads: DataFrame, ids: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Leads to enrich: those listed (when a list is given) and, unless forced, only pending ones."""
    chosen = leads if force else leads.where(status_eq("pending"))
    return chosen if ids is None else chosen.join(ids.select("lead_key"), "lead_key", "left_semi")


def lead_by_id(leads: DataFrame, lead_key: str) -> DataFrame:
    return leads.where(F.col("lead_key") == lead_key)


def valid_edit() -> Column:
    stage_fine = F.col("stage").isNull() | F.col("stage").isin(fv.STAGES)
    notes_fine = F.col("notes").isNull() | (F.length("notes") <= fv.NOTES_MAX_CHARS)
    return stage_fine & notes_fine


def validate_edit(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)"""
    return edits.where(valid_edit()), edits.where(~valid_edit())


def valid_icp() -> Column:
    c = F.col
    return F.coalesce(
        (c("employees_min") <= c("employees_max")) & (c("employees_min") >= 0) & (c("employees_max") >= 1)
        & c("min_years").between(0, 100),
        F.lit(False),
    )


def validate_icp(params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined)"""
    return params.where(valid_icp()), params.where(~valid_icp())
