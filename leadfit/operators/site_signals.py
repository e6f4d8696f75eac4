"""Findings of a site's pages -> one `signals` value per site, then per lead."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadfit import fixed_values as fv
from leadfit.functions import signals as sg
from leadfit.functions.html import page_description
from leadfit.functions.text import str_array
from leadfit.operators.pages import EVIDENCE_KEYWORDS, page_rank
from leadfit.schemas import SIGNALS


def one_page_per_kind(pages: DataFrame) -> DataFrame:
    """A site has one page of each kind: the first url counts where a table holds several."""
    rest = [c for c in pages.columns if c not in ("domain", "kind")]
    first = F.min_by(F.struct(*rest), F.col("url"))
    return pages.groupBy("domain", "kind").agg(first.alias("p")).select("domain", "kind", "p.*")


def _quote(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("page"), text.alias("text"))


def _merge_lists(name: str, keep: int) -> Column:
    """Lists of the pages in page order, repeats dropped, cut. At most five short lists per site."""
    listed = F.collect_list(F.when(F.size(name) > 0, F.struct(F.col("_ord"), F.col(name).alias("v"))))
    flat = F.flatten(F.transform(F.array_sort(listed), lambda p: p["v"]))
    return F.slice(F.array_distinct(flat), 1, keep)


def site_rollup(pages: DataFrame, today: date) -> DataFrame:
    """One row per site from its pages' findings; the first page with a finding gives the evidence.

    `pages` holds one row per site and kind, so each site brings at most a handful of rows. All
    aggregates combine on the map side.
    """
    kind = F.col("kind")
    ranked = pages.withColumn("_ord", F.struct(page_rank(kind).alias("rank"), kind.alias("kind")))

    def first(value: Column, present: Column) -> Column:
        return F.min_by(value, F.when(present, F.col("_ord")))

    def first_quote(name: str) -> Column:
        return first(_quote(kind, F.col(name)), F.col(name).isNotNull())

    home_cols = ["text_head", "title", "title_brand", "meta_description", "socials", "mobile_friendly"]
    founded = F.col("founded")
    rolled = ranked.groupBy("domain").agg(
        F.array_sort(F.collect_set("kind")).alias("pages_crawled"),
        *[F.min_by(F.col(c), F.col("_ord")).alias(c) for c in home_cols],
        *[first_quote(f"{k}_quote").alias(f"{k}_ev") for k in [*EVIDENCE_KEYWORDS, "weak_franchise", "recurring"]],
        F.min_by(
            F.struct(founded["year"].alias("year"), _quote(kind, founded["quote"]).alias("ev")),
            F.when(founded.isNotNull(), F.struct(founded["year"], F.col("_ord"))),
        ).alias("founded"),
        F.max("copyright_year").alias("copyright_year"),
        first(
            F.struct(F.col("owner")["name"].alias("name"), _quote(kind, F.col("owner")["quote"]).alias("ev")),
            F.col("owner").isNotNull(),
        ).alias("owner"),
        first(F.col("employees_hint"), F.col("employees_hint").isNotNull()).alias("employees_hint"),
        _merge_lists("recurring_terms", fv.TERMS_KEPT).alias("recurring_terms"),
        _merge_lists("emails", fv.EMAILS_KEPT).alias("emails"),
        _merge_lists("phones", fv.PHONES_KEPT).alias("phones"),
        F.min("cms_rank").alias("cms_rank"),
        *[F.bool_or(t).alias(t) for t in fv.TECH_PATTERNS],
        F.slice(F.array_sort(F.collect_list(F.struct("_ord", "industry_hits"))), 1, fv.INDUSTRY_PAGES)
        .alias("_hits"),
    )
    zero = F.array(*[F.lit(0) for _ in fv.INDUSTRY_PATTERNS])
    hits = F.aggregate("_hits", zero, lambda a, p: F.zip_with(a, p["industry_hits"], lambda x, y: x + y))
    return rolled.withColumn("industry_guess", sg.industry_from_hits(hits)).drop("_hits")


def _evidence(pairs: dict[str, Column]) -> Column:
    """Map of the quotes that exist."""
    entries = F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs.items()
    ])
    return F.map_from_entries(F.array_compact(entries))


def site_signals(rolled: DataFrame, status: DataFrame, today: date) -> DataFrame:
    """(domain, signals) of every site asked; unreachable sites carry only their outcome."""
    joined = status.join(rolled, "domain", "left")
    has = lambda c: F.col(c).isNotNull()
    title_quote = F.when(has("title_brand"), _quote(F.lit("home"), F.concat(
        F.lit("Page title “"), F.substring("title", 1, fv.TITLE_QUOTE_CHARS),
        F.lit("” matches the national franchise brand “"), F.col("title_brand"), F.lit("”."),
    )))
    franchise_quote = F.coalesce(title_quote, F.col("franchise_ev"), F.col("weak_franchise_ev"))
    live = F.col("reachable")
    https = F.coalesce(F.col("https"), F.lit(False))
    features = {
        "https": https, "mobile_friendly": F.col("mobile_friendly"),
        "fresh": sg.is_fresh(F.col("copyright_year"), today), **{t: F.col(t) for t in fv.TECH_PATTERNS},
    }
    evidence = _evidence({
        "founded_year": F.col("founded")["ev"], "owner_name": F.col("owner")["ev"],
        "succession": F.col("succession_ev"), "family_owned": F.col("family_owned_ev"),
        "hiring": F.col("hiring_ev"), "franchise": franchise_quote, "pe_backed": F.col("pe_backed_ev"),
        "testimonials": F.col("testimonials_ev"), "recurring_revenue": F.col("recurring_ev"),
    })
    values = {
        "founded_year": F.col("founded")["year"],
        "years_in_business": F.lit(today.year) - F.col("founded")["year"],
        "copyright_year": F.col("copyright_year"),
        "owner_name": F.col("owner")["name"],
        **{k: has(f"{k}_ev") for k in ("succession", "family_owned", "hiring", "pe_backed", "testimonials")},
        "franchise": franchise_quote.isNotNull(),
        "recurring_terms": F.col("recurring_terms"), "employees_hint": F.col("employees_hint"),
        "emails": F.col("emails"), "phones": F.col("phones"), "socials": F.col("socials"),
        "tech": F.struct(
            sg.cms_name(F.col("cms_rank")).alias("cms"), https.alias("https"),
            F.coalesce("mobile_friendly", F.lit(False)).alias("mobile_friendly"),
            *[F.coalesce(t, F.lit(False)).alias(t) for t in fv.TECH_PATTERNS],
        ),
        "digital_maturity": sg.digital_maturity(features),
        "description": page_description(F.col("meta_description"), F.col("text_head")),
        "industry_guess": F.col("industry_guess"),
    }
    always = {
        "reachable": live, "blocked": F.col("blocked"), "crawl_error": F.col("error"),
        "pages_crawled": F.coalesce("pages_crawled", str_array([])),
        "evidence": F.when(live, evidence).otherwise(F.create_map().cast("map<string,struct<page:string,text:string>>")),
    }
    packed = {**always, **{k: F.when(live, v) for k, v in values.items()}}
    return joined.select("domain", signals_struct(packed).alias("signals"))


def signals_struct(values: dict[str, Column]) -> Column:
    """Named values in the order and types of the signals schema; absent ones are NULL."""
    fields = StructType.fromDDL(SIGNALS.removeprefix("struct<").removesuffix(">"))
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def name_brand_quote(name: Column, brand: Column) -> Column:
    return _quote(F.lit("company name"), F.concat(
        F.lit("“"), name, F.lit("” matches the national franchise brand “"), brand, F.lit("”."),
    ))


def with_name_brand(signals: Column, name: Column) -> Column:
    """Signals of a lead: a franchise brand in the company name overrides what the site shows."""
    brand = sg.first_brand(name)
    own = F.create_map(F.lit("franchise"), name_brand_quote(name, brand))
    rest = F.map_filter(signals["evidence"], lambda k, _v: k != "franchise")
    branded = signals.withField("franchise", F.lit(True)).withField("evidence", F.map_concat(rest, own))
    return F.when(brand.isNotNull(), branded).otherwise(signals)
