"""Choosing and checking contact details of leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.functions import contacts as ct
from leadfit.functions.scoring import lead_owner
from leadfit.functions.text import blank_to_null, normalize_phone
from leadfit.operators.skew import HOT_ROWS, balanced_left_join


def mx_join(
    leads: DataFrame, mx_hosts: DataFrame, email: str = "email", row_id: str = "lead_key", hot_rows: int = HOT_ROWS,
    hosts_of: DataFrame | None = None,
) -> DataFrame:
    """Leads with `has_mx` of their e-mail host: TRUE, FALSE, or NULL when it was not checked.

    A free mail host can hold a large share of all addresses, hence the balanced join. `hosts_of` is a
    cheaper table with at least the addresses of `leads`, to find frequent hosts in.
    """
    hosted = leads.withColumn("_host", ct.email_host(ct.tidy_email(email)))
    checks = mx_hosts.groupBy(F.lower("host").alias("_host")).agg(F.bool_or("has_mx").alias("has_mx"))
    counted = hosts_of if hosts_of is not None else hosted
    counted = counted.select(ct.email_host(ct.tidy_email(email)).alias("_host"))
    return balanced_left_join(hosted, checks, ["_host"], [row_id], hot_rows=hot_rows, hot_source=counted).drop("_host")


def fill_contacts(leads: DataFrame) -> DataFrame:
    """Missing e-mail and phone from the site's signals; the phone is normalised."""
    sig = lambda n: F.col("signals")[n]
    owner = lead_owner(F.col, sig)
    email = F.coalesce(blank_to_null(F.col("email")), ct.best_email(sig("emails"), owner, F.col("domain")))
    phone = F.coalesce(blank_to_null(F.col("phone")), F.get(sig("phones"), F.lit(0)))
    return leads.withColumns({"email": email, "phone": normalize_phone(phone)})


def enrich_contacts(
    leads: DataFrame, mx_hosts: DataFrame, hot_rows: int = HOT_ROWS, hosts_of: DataFrame | None = None,
) -> DataFrame:
    """Filled contacts plus `email_status`. `hosts_of` as in `mx_join`."""
    checked = mx_join(fill_contacts(leads), mx_hosts, hot_rows=hot_rows, hosts_of=hosts_of)
    return checked.withColumn("email_status", ct.classify_email("email", F.col("has_mx"))).drop("has_mx")


def enrich_status(reachable: Column) -> Column:
    return F.when(reachable, "enriched").otherwise("failed")
