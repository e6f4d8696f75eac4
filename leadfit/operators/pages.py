"""Fetched pages: cleaning, freshness, robots rules, findings per page, pages of a site."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions import contacts as ct
from leadfit.functions import html as ht
from leadfit.functions import signals as sg
from leadfit.functions.text import blank_to_null
from leadfit.operators.skew import balanced_left_join

PAGE_RANK = {kind: i for i, kind in enumerate(fv.PAGE_KINDS)}
OTHER_RANK = 99


def page_rank(kind: Column) -> Column:
    out = F
    for name, rank in PAGE_RANK.items():
        out = out.when(kind == name, rank)
    return out.otherwise(OTHER_RANK)


# ---- fetch table -----------------------------------------------------------------

def store_fetches(fetches: DataFrame) -> DataFrame:
    """Latest stored result per url; results without a response (status 0) are never stored.

    Only the time and the row's own columns are compared in the map-side combine, so each task
    ships one row per url.
    """
    payload = [c for c in fetches.columns if c != "url"]
    latest = F.max_by(F.struct(*payload), F.struct("fetched_at", F.xxhash64(*payload)))
    return fetches.where(F.col("status") != 0).groupBy("url").agg(latest.alias("r")).select("url", "r.*")


def fresh_fetches(fetches: DataFrame, as_of: datetime) -> DataFrame:
    """Results at most 72 hours old."""
    return fetches.where(F.col("fetched_at") >= F.lit(as_of) - F.expr(f"INTERVAL {fv.FRESH_HOURS} HOURS"))


def urls_to_refetch(needed: DataFrame, fetches: DataFrame, as_of: datetime) -> DataFrame:
    """Needed urls without a fresh result, or whose stored result asks for a retry."""
    fresh = fresh_fetches(fetches, as_of)
    usable = fresh.where(~F.col("status").isin(fv.RETRY_STATUSES) & (F.col("status") != 0)).select("url")
    return needed.join(usable, "url", "left_anti").distinct()


def clean_fetches(fetches: DataFrame) -> DataFrame:
    """Adds `blocked` and `ok`; bodies of other content types are emptied."""
    content_type = F.col("content_type") if "content_type" in fetches.columns else F.lit(None).cast("string")
    cut = fetches.withColumn("html", ht.html_only(F.coalesce("html", F.lit("")), content_type))
    flagged = cut.withColumn("blocked", ht.is_blocked(F.col("status"), F.col("html")))
    return flagged.withColumn("ok", ht.fetch_ok(F.col("status"), F.col("blocked"), F.col("html")))


# ---- robots rules ------------------------------------------------------------------

def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """robots(origin, status, body) -> one row per origin with the ordered rules for this agent.

    A group begins at an agent line that follows no other agent line directly (comments and unknown fields aside) and
    holds the rule lines behind it, up to the next blank line or group. The first group that names the agent counts, else
    the first for all agents; groups without rules are none. Lines are rows here, so a long file takes time in proportion.
    """
    bot = agent.split("/")[0].lower()
    one_each = robots.where(F.col("status") == 200).groupBy("origin").agg(F.min("body").alias("body"))
    lines = one_each.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw")).select(
        "origin", "n", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line"))
    told = F.col("line").contains(":")
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    kind = F.when(F.col("line") == "", "blank").when(told & (field == "user-agent"), "agent").when(told & field.isin("allow", "disallow"), field)
    kinds = lines.select("origin", "n", kind.alias("kind"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).where(F.col("kind").isNotNull())
    order = Window.partitionBy("origin").orderBy("n")
    place = lambda k: F.max(F.when(F.col("kind") == k, F.col("n"))).over(order)
    is_agent = F.col("kind") == "agent"
    begins = is_agent & (F.coalesce(F.lag("kind").over(order), F.lit("blank")) != "agent")
    placed = kinds.withColumns({
        "begins": begins.cast("int"), "grouped": F.coalesce(place("agent") > F.coalesce(place("blank"), F.lit(-1)), F.lit(False))})
    placed = placed.withColumn("grp", F.sum("begins").over(order))
    rule = F.col("grouped") & F.col("kind").isin("allow", "disallow")
    entry = F.struct("n", F.col("value").alias("path"), ((F.col("kind") == "allow") | (F.col("value") == "")).alias("allow"))
    groups = placed.groupBy("origin", "grp").agg(
        F.max(is_agent & (F.col("value") == "*")).alias("star"),
        F.max(is_agent & (F.col("value") != "") & F.lit(bot).contains(F.lower("value"))).alias("named"),
        F.array_sort(F.collect_list(F.when(rule, entry))).alias("entries"))
    ruled = groups.where(F.size("entries") > 0).withColumn("rules", F.transform("entries", lambda e: F.struct(e["path"].alias("path"), e["allow"].alias("allow"))))
    own = F.min_by("rules", F.when(F.col("named") & ~F.col("star"), F.col("grp")))
    for_all = F.min_by("rules", F.when(F.col("star"), F.col("grp")))
    return ruled.groupBy("origin").agg(F.coalesce(own, for_all).alias("rules")).where(F.col("rules").isNotNull())


def robots_verdict(urls: DataFrame, robots: DataFrame, agent: str, hot_rows: int = 1_000_000) -> DataFrame:
    """urls(url) with `allowed`: the first rule whose path starts the url's path decides.

    The rules of an origin travel as one array, so a site with very many urls is never paired
    with its rules line by line.
    """
    origin = F.lower(F.regexp_extract("url", ht.ORIGIN, 1))
    target = F.regexp_extract(F.col("url"), ht.ORIGIN + "(.*)$", 2)
    placed = urls.withColumn("origin", origin).withColumn(
        "_path", F.when(target == "", "/").when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    )
    joined = balanced_left_join(placed, robots_rules(robots, agent), ["origin"], ["url"], hot_rows=hot_rows)
    hit = F.get(
        F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(F.col("_path"), r["path"])), F.lit(0)
    )
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("rules", "_path")


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, hot_rows: int = 1_000_000) -> DataFrame:
    return robots_verdict(urls, robots, agent, hot_rows).where("allowed").drop("allowed", "origin")


# ---- findings per page ---------------------------------------------------------------

EVIDENCE_KEYWORDS = list(fv.KEYWORD_PATTERNS)
FINDINGS = [
    "text_head", "title", "title_brand", "meta_description", "socials", "mobile_friendly",
    *[f"{k}_quote" for k in EVIDENCE_KEYWORDS], "weak_franchise_quote",
    "founded", "copyright_year", "owner", "recurring_terms", "recurring_quote", "employees_hint",
    "emails", "phones", "cms_rank", *fv.TECH_PATTERNS, "industry_hits",
]


def page_findings(pages: DataFrame, today: date) -> DataFrame:
    """Everything one page says, as small columns: a map-only pass that drops the HTML.

    Needs `html` (NULL for pages that are not to be read) and `is_home`; other columns pass
    through. Each projection builds on the one before, so text and matches are computed once.
    """
    keep = [c for c in pages.columns if c != "html"]
    home, html, text = F.col("is_home"), F.col("html"), F.col("text")
    read = pages.select(*keep, "html", ht.html_to_text("html").alias("text"), F.lower("html").alias("lowered"))
    low = F.col("_low")

    # matches
    plain = {**fv.KEYWORD_PATTERNS, "recurring": fv.RECURRING_PATTERN}
    matched = read.withColumn("_low", F.lower("text")).select(
        "*", *[sg.keyword_match(text, low, k, p).alias(f"_{k}") for k, p in plain.items()],
        F.when(sg.contains_any(low, fv.PATTERN_STEMS["weak_franchise"]), sg.weak_franchise_match(text))
        .alias("_weak_franchise"),
        F.array_min(sg.year_candidates(text, today)).alias("_founded"),
        sg.owner_hit(text).alias("_owner"),
        F.when(home, ht.html_title("html")).alias("title"),
    )
    # quotes around them, all by one expression
    marks = [*plain, "weak_franchise"]
    founded, owner = F.col("_founded"), F.col("_owner")
    spots = [sg.literal_spot(text, F.col(f"_{k}")) for k in marks]
    spots += [sg.founding_spot(text, founded), sg.owner_spot(text, owner)]
    quoted = matched.withColumn("_quotes", sg.quotes(text, spots))

    def quote(i: int) -> Column:
        return F.get("_quotes", F.lit(i))

    tech = [sg.contains_any(F.col("lowered"), sg.plain_words(p)).alias(n) for n, p in fv.TECH_PATTERNS.items()]
    return quoted.select(
        *keep,
        F.when(home, F.substring(text, 1, fv.DESCRIPTION_TEXT_CHARS)).alias("text_head"),
        "title",
        sg.first_brand(F.col("title")).alias("title_brand"),
        F.when(home, ht.meta_description(html)).alias("meta_description"),
        F.when(home, ht.social_links(F.transform(ht.anchors(html), lambda a: a["href"]))).alias("socials"),
        F.when(home, ht.has_viewport(html)).alias("mobile_friendly"),
        *[quote(i).alias(f"{k}_quote") for i, k in enumerate(marks)],
        F.when(founded.isNotNull(), F.struct(
            founded["year"].alias("year"), quote(len(marks)).alias("quote"))).alias("founded"),
        sg.copyright_year(html, today).alias("copyright_year"),
        F.when(owner.isNotNull(), F.struct(
            owner["name"].alias("name"), quote(len(marks) + 1).alias("quote"))).alias("owner"),
        F.when(F.col("_recurring").isNotNull(), sg.recurring_terms(text)).alias("recurring_terms"),
        sg.headcount(text).alias("employees_hint"),
        ct.extract_emails(html).alias("emails"),
        ct.extract_phones(text).alias("phones"),
        sg.cms_rank(F.col("lowered")).alias("cms_rank"),
        *tech,
        sg.industry_hits(text, low).alias("industry_hits"),
    )


# ---- pages of a site -------------------------------------------------------------------

def fetch_findings(fetches: DataFrame, today: date) -> DataFrame:
    """Cleaned fetches -> one row per fetch: place in its site, outcome, findings and links.

    Only usable pages are read. The HTML ends here; all later joins move small rows.
    """
    final = F.coalesce(blank_to_null(F.col("final_url")), F.col("url"))
    error = F.col("error") if "error" in fetches.columns else F.lit(None).cast("string")
    placed = fetches.select(
        "url", final.alias("final_url"), "status", "blocked", "ok", error.alias("error"),
        ht.url_key(F.col("url")).alias("url_key"), ht.site_host(F.col("url")).alias("host"),
        F.col("url").startswith("https://").alias("asked_https"),
        F.when(F.col("ok"), F.col("html")).alias("html"),
    ).withColumn("is_home", F.col("url_key") == F.concat(F.col("host"), F.lit("/")))
    linked = placed.withColumn("links", F.when(
        F.col("is_home") & F.col("ok"),
        ht.page_kind_links(F.col("html"), F.col("final_url"), F.col("host")),
    ))
    return page_findings(linked, today)


def home_page_fallback(findings: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One home page per host: https if usable or blocked, else http if so, else the last error."""
    wins = F.col("ok") | F.col("blocked")
    rank = F.when(wins & F.col("asked_https"), 0).when(wins, 1).when(~F.col("asked_https"), 2).otherwise(3)
    cols = ["url", "final_url", "status", "blocked", "ok", "error", *(extra or [])]
    return (
        findings.where("is_home").groupBy(F.col("host").alias("domain"))
        .agg(F.min_by(F.struct(*cols), F.struct(rank, F.col("url"))).alias("h"))
        .select("domain", "h.*")
    )


def site_status(homes: DataFrame) -> DataFrame:
    """domain, reachable, blocked, error, https of every site that was asked."""
    failed = F.coalesce(blank_to_null(F.col("error")), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return homes.select(
        "domain", F.col("ok").alias("reachable"), "blocked",
        F.when(F.col("ok"), None).when(F.col("blocked"), fv.BLOCKED_SITE_ERROR).otherwise(failed).alias("error"),
        F.when(F.col("ok"), F.col("final_url").startswith("https://")).alias("https"),
    )


def discovered_links(homes: DataFrame) -> DataFrame:
    """domain, kind, url, url_key: up to four links per site."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("links")[k].alias("url")) for k in fv.LINK_PATTERNS
    ])
    return (
        homes.where("ok").select("domain", F.explode(pairs).alias("p")).select("domain", "p.kind", "p.url")
        .where(F.col("url").isNotNull()).withColumn("url_key", ht.url_key(F.col("url")))
    )


def resolve_links_to_pages(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Discovered links with the findings of the fetched page behind them; usable pages only.

    Joined on the page, not the site, so a large site spreads over the shuffle. Pages that no link
    names are dropped before the findings are aggregated.
    """
    cols = ["final_url", *FINDINGS]
    named = findings.where("ok").join(links.select("url_key"), "url_key", "left_semi")
    per_page = (
        named.groupBy("url_key")
        .agg(F.min_by(F.struct(*cols), F.struct(~F.col("asked_https"), F.col("url"))).alias("p"))
    )
    return (
        links.select("domain", "kind", F.col("url").alias("link_url"), "url_key").join(per_page, "url_key")
        .select("domain", "kind", F.coalesce("p.final_url", "link_url").alias("url"),
                *[F.col("p")[c].alias(c) for c in FINDINGS])
    )


def site_pages(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, status): findings of the at most five pages of each reachable site, and site outcomes."""
    homes = home_page_fallback(findings, ["links", *FINDINGS])
    linked = resolve_links_to_pages(discovered_links(homes), findings)
    home_rows = homes.where("ok").select("domain", F.lit("home").alias("kind"), F.col("final_url").alias("url"), *FINDINGS)
    return home_rows.unionByName(linked), site_status(homes)
