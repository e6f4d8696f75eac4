"""E-mail and phone rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.text import as_col, blank_to_null, is_free_mail_host, let, str_array


def email_local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def email_host(email: Column) -> Column:
    """Text after the first @."""
    return F.regexp_replace(email, "^[^@]*@", "")


def tidy_email(email: Column | str) -> Column:
    return blank_to_null(F.lower(F.trim(as_col(email))))


def is_role_local(local: Column) -> Column:
    return local.isin(fv.ROLE_LOCAL_PARTS)


def classify_email(email: Column | str, has_mx: Column) -> Column:
    """valid / role / personal_domain / invalid / unverified; NULL without an address.

    `has_mx` is TRUE, FALSE or NULL when the host could not be checked.
    """
    return let(tidy_email(email), lambda e: (
        F.when(e.isNull(), F.lit(None).cast("string"))
        .when(F.length(e) > fv.EMAIL_MAX_CHARS, "invalid")  # before the pattern, which recurses by label
        .when(~e.rlike(fv.EMAIL_SYNTAX), "invalid")
        .when(~has_mx, "invalid")
        .when(is_role_local(email_local(e)), "role")
        .when(is_free_mail_host(email_host(e)), "personal_domain")
        .when(has_mx.isNull(), "unverified")
        .otherwise("valid")
    ))


def email_rank(email: Column, owner_name: Column, domain: Column) -> Column:
    """0 owner's own address, 1 named address on the company domain, 2 role address on it, 3 other."""
    local, host = email_local(email), email_host(email)
    first = F.lower(F.get(F.split(F.trim(F.coalesce(owner_name, F.lit(""))), r"\s+"), F.lit(0)))
    on_domain = F.coalesce(F.endswith(host, domain), F.lit(False))
    return (
        F.when((first != "") & F.contains(local, first), 0)
        .when(on_domain & ~is_role_local(local), 1)
        .when(on_domain, 2)
        .otherwise(3)
    )


def best_email(emails: Column, owner_name: Column, domain: Column) -> Column:
    """Best ranked address; the earlier one wins among equals."""
    def ranked(owner: Column) -> Column:
        return F.transform(
            emails,
            lambda e, i: F.struct(email_rank(e, owner, domain).alias("rank"), i.alias("pos"), e.alias("email")),
        )

    return F.array_min(let(owner_name, ranked))["email"]


def extract_emails(html: Column | str, keep: int | None = fv.EMAILS_KEPT) -> Column:
    """Distinct lower-case addresses in order of appearance, image names and dummy hosts dropped.

    A match may only begin where a run of address characters begins (or right after the last
    match), which every leftmost match does anyway; without that, long unbroken runs such as
    encoded blobs would be rescanned from each of their characters.
    """
    src = as_col(html)
    run = "[A-Za-z0-9._%+-]"
    pattern = rf"(?:\G|(?<!{run})){run}++@" + fv.EMAIL_PATTERN.split("@", 1)[1]
    found = F.when(F.contains(src, F.lit("@")), F.regexp_extract_all(src, F.lit(pattern), 0)).otherwise(str_array([]))
    tidy = F.transform(found, lambda e: F.regexp_replace(F.lower(e), r"^\.+|\.+$", ""))

    def wanted(e: Column) -> Column:
        image = F.lit(False)
        for suffix in fv.EMAIL_IMAGE_SUFFIXES:
            image = image | e.endswith(suffix)
        return ~image & ~email_host(e).isin(fv.EMAIL_IGNORED_HOSTS)

    out = F.array_distinct(F.filter(tidy, wanted))
    return F.slice(out, 1, keep) if keep else out


def extract_phones(text: Column | str, keep: int | None = fv.PHONES_KEPT) -> Column:
    """Distinct phone numbers in visible text, as (ddd) ddd-dddd, in order of appearance."""
    found = F.regexp_extract_all(as_col(text), F.lit("(?=[+1(2-9])" + fv.PHONE_PATTERN), 0)  # refuses most places at once
    # the match itself holds 10 digits, plus a leading country code 1
    digits = F.transform(found, lambda m: F.right(F.regexp_replace(m, r"\D", ""), F.lit(10)))
    pretty = F.transform(
        digits,
        lambda d: F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3),
                           F.lit("-"), F.substring(d, 7, 4)),
    )
    out = F.array_distinct(pretty)
    return F.slice(out, 1, keep) if keep else out
