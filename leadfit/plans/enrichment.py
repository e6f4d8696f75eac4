"""End to end: pages of the leads' sites -> signals -> contacts -> score."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.text import blank_to_null
from leadfit.operators.contacts import enrich_contacts, enrich_status
from leadfit.operators.pages import clean_fetches, fetch_findings, site_pages
from leadfit.operators.scoring import score_leads
from leadfit.operators.site_signals import signals_struct, site_rollup, site_signals, with_name_brand
from leadfit.operators.skew import HOT_ROWS, balanced_left_join
from leadfit.schemas import LEAD_TABLE, conform
from leadfit.sources.tables import materialize


def signals_of_sites(fetches: DataFrame, today: date) -> DataFrame:
    """(domain, signals) of every site among the fetches.

    The findings are written once: home pages and linked pages are both taken from them, and the
    HTML must not be read twice. The signals are written for the same reason: enrichment uses them
    for the leads and to find e-mail hosts that many leads share.
    """
    findings = materialize(fetch_findings(clean_fetches(fetches), today), "page-findings")
    pages, status = site_pages(findings)
    return materialize(site_signals(site_rollup(pages, today), status, today), "site-signals")


def unmatched_signals():
    """Signals of a lead whose site is not among the fetches, or that has none."""
    no_site = F.col("domain").isNull()
    error = F.when(no_site, fv.NO_WEBSITE_ERROR).otherwise(fv.NO_FETCH_ERROR)
    return signals_struct({
        "reachable": F.lit(False), "blocked": F.lit(False), "crawl_error": error,
        "pages_crawled": F.array(), "evidence": F.create_map(),
    })


def attach_signals(leads: DataFrame, site: DataFrame) -> DataFrame:
    """Leads with signals; a lead without a known site is kept, with the reason as its error."""
    joined = balanced_left_join(leads.drop("signals"), site, ["domain"], ["lead_key"], hot_rows=None)
    filled = joined.withColumn("signals", F.coalesce("signals", unmatched_signals()))
    return filled.withColumn("signals", with_name_brand(F.col("signals"), F.col("name")))


def enrich_leads(
    leads: DataFrame, site: DataFrame, mx_hosts: DataFrame, today: date, icp: dict | None = None,
    enriched_at=None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The lead table after enrichment: signals, contacts, status, score.

    Frequent e-mail hosts are looked for among the addresses a lead can take, its own and its site's: no signals are
    joined for that.
    """
    addresses = leads.select("email").unionByName(site.select(F.explode("signals.emails").alias("email")))
    with_contacts = enrich_contacts(attach_signals(leads, site), mx_hosts, hot_rows, hosts_of=addresses)
    done = with_contacts.withColumns({
        "status": enrich_status(F.col("signals.reachable")),
        "error": blank_to_null(F.col("signals.crawl_error")),
        "enriched_at": F.lit(enriched_at).cast("timestamp"),
    })
    return conform(score_leads(done, icp, today), LEAD_TABLE)


def enrich_selected(
    leads: DataFrame, site: DataFrame, mx_hosts: DataFrame, today: date, icp: dict | None = None,
    ids: DataFrame | None = None, force: bool = False, enriched_at=None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole lead table after enriching the listed leads (all when no list is given).

    Unless forced, leads that were enriched before are left alone.
    """
    if ids is None:
        marked = leads.withColumn("_listed", F.lit(True))
    else:
        listed = ids.select("lead_key").distinct().withColumn("_listed", F.lit(True))
        marked = leads.join(listed, "lead_key", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    due = F.col("_listed") if force else F.col("_listed") & (F.col("status") == "pending")
    done = enrich_leads(
        marked.where(due).select(*leads.columns), site, mx_hosts, today, icp, enriched_at, hot_rows)
    return done.unionByName(conform(marked.where(~due), LEAD_TABLE))
