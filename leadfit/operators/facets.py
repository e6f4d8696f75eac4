"""Counts over the lead table. Each is one aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.operators.filters import has_direct_email, owner_transition
from leadfit.operators.views import best_industry, half_up


def _count(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def status_aggregates() -> list[Column]:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total"), *[_count(status == s, s) for s in fv.STATUSES],
        _count(status.isin("enriched", "failed"), "reviewed"),
    ]


def tier_aggregates() -> list[Column]:
    done = F.col("status") != "pending"
    return [_count(done & (F.col("tier") == t), f"tier_{t.lower()}") for t in fv.TIER_LABELS]


def stage_aggregates() -> list[Column]:
    return [_count(F.col("stage") == s, f"stage_{s}") for s in fv.STAGES]


def signal_aggregates() -> list[Column]:
    return [_count(owner_transition(), "owner_transition"), _count(has_direct_email(), "direct_email")]


def status_counts(leads: DataFrame) -> DataFrame:
    return leads.agg(*status_aggregates())


def tier_counts(leads: DataFrame) -> DataFrame:
    """Per tier, pending leads left out, zero where none."""
    return leads.agg(*tier_aggregates())


def stage_counts(leads: DataFrame) -> DataFrame:
    return leads.agg(*stage_aggregates())


def signal_counts(leads: DataFrame) -> DataFrame:
    return leads.agg(*signal_aggregates())


def stats(leads: DataFrame) -> DataFrame:
    """All counts in one pass."""
    return leads.agg(*status_aggregates(), *tier_aggregates(), *stage_aggregates(), *signal_aggregates())


def distinct_industries(leads: DataFrame) -> DataFrame:
    """Sorted choices for the industry filter."""
    return (
        leads.select(best_industry().alias("industry")).where(F.col("industry").isNotNull())
        .distinct().orderBy("industry")
    )


def facet_columns(leads: DataFrame, *more: str) -> DataFrame:
    """What `facet_rows` reads of leads, their key and `more` columns: a narrow table to rewrite at each change."""
    signals = F.struct(*[F.col("signals")[n].alias(n) for n in ("succession", "family_owned", "industry_guess")])
    return leads.select("lead_key", "status", "tier", "stage", "email_status", "industry", signals.alias("signals"), *more)


def facet_rows(leads: DataFrame) -> DataFrame:
    """facet, value: one row for each count a lead stands in; values of total and the two signals are empty."""
    def when(cond: Column, facet: str, value: Column = F.lit("")) -> Column:
        return F.when(cond, F.struct(F.lit(facet).alias("facet"), value.alias("value")))

    done, industry = F.col("status") != "pending", best_industry()
    held = F.array(
        when(F.lit(True), "total"), when(F.col("status").isNotNull(), "status", F.col("status")),
        when(done & F.col("tier").isNotNull(), "tier", F.col("tier")), when(F.col("stage").isNotNull(), "stage", F.col("stage")),
        when(owner_transition(), "owner_transition"), when(has_direct_email(), "direct_email"),
        when(industry.isNotNull(), "industry", industry),
    )
    return leads.select(F.explode(F.array_compact(held)).alias("f")).select("f.*")


def facet_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """facet, value, n: how the counts change when leads in the states of `before` take those of `after`.

    Inserted leads stand in `after` alone, deleted ones in `before` alone.
    """
    signed = facet_rows(after).withColumn("n", F.lit(1).cast("bigint"))
    if before is not None:
        signed = signed.unionByName(facet_rows(before).withColumn("n", F.lit(-1).cast("bigint")))
    return signed.groupBy("facet", "value").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """The row of `stats` from facet counts (facet, value, n)."""
    def n(facet: str, *values: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("facet") == facet) & F.col("value").isin(*values), F.col("n"))), F.lit(0).cast("bigint"))

    return counts.agg(
        n("total", "").alias("total"), *[n("status", s).alias(s) for s in fv.STATUSES], n("status", "enriched", "failed").alias("reviewed"),
        *[n("tier", t).alias(f"tier_{t.lower()}") for t in fv.TIER_LABELS], *[n("stage", s).alias(f"stage_{s}") for s in fv.STAGES],
        n("owner_transition", "").alias("owner_transition"), n("direct_email", "").alias("direct_email"),
    )


def industries_of_counts(counts: DataFrame) -> DataFrame:
    """The rows of `distinct_industries` from facet counts."""
    return counts.where((F.col("facet") == "industry") & (F.col("n") > 0)).select(F.col("value").alias("industry")).orderBy("industry")


def job_progress(outcomes: DataFrame) -> DataFrame:
    """outcomes(batch_id, status) -> total, done, failed, status, percent per batch."""
    done = F.count_if(F.col("status") != "pending")
    total = F.count(F.lit(1))
    return outcomes.groupBy("batch_id").agg(
        total.alias("total"), done.alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(done == total, "finished").otherwise("running").alias("status"),
        F.when(total > 0, half_up(done / total * 100)).otherwise(0).alias("percent"),
    )
