"""Registered queries: one per operator, each over whole tables given or derived from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from checks.derived import AS_OF, BATCH_CUT, TODAY, Inputs
from leadfit import fixed_values as fv
from leadfit.functions import contacts as ct
from leadfit.functions import html as ht
from leadfit.functions import scoring as sc
from leadfit.functions import signals as sg
from leadfit.functions import text as tx
from leadfit.operators import briefs, facets, filters, merging, pages, scoring, site_signals, views
from leadfit.operators.brands import with_first_brand
from leadfit.operators.contacts import enrich_contacts, enrich_status, fill_contacts, mx_join
from leadfit.plans import enrichment, importing
from leadfit.plans.importing import import_rows, merged_leads
from leadfit.sources import lead_files, page_tables, sinks
from leadfit.sources.facet_counts import FacetCounts
from leadfit.sources.fetch_store import FetchStore
from leadfit.sources.lead_store import LeadStore
from leadfit.sources.params import read_params
from leadfit.sources.search_index import SearchIndex
from leadfit.sources.tables import VersionedTable, materialize, shared_dir
from leadfit.streaming.edits import collect_edits, latest_edits
from leadfit.streaming.incremental import incremental_import
from leadfit.streaming.refetch import due_urls, follow_fetches

DAY = date.fromisoformat(TODAY)
NOW = datetime.fromisoformat(AS_OF)
AGENT = "LeadBot/1.0 (+https://bot.example)"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Inputs(spark, folder))
    return fn


_STORED: dict[tuple, DataFrame] = {}


def stored(name: str):
    """A table written once per session and folder, as an application would keep it."""
    def wrap(build: Callable[[Inputs], DataFrame]):
        def get(i: Inputs) -> DataFrame:
            at = (i.spark.sparkContext.applicationId, i.folder, name)
            if at not in _STORED:
                _STORED[at] = materialize(build(i), name)
            return _STORED[at]
        return get
    return wrap


# ---- shared tables ---------------------------------------------------------------------

def raw(i: Inputs, part: str = "all") -> DataFrame:
    df = i.leads_raw()
    cut = F.lit(BATCH_CUT).cast("timestamp_ntz")
    if part == "before":
        df = df.where(F.col("o_orderdate") < cut)
    if part == "after":
        df = df.where(F.col("o_orderdate") >= cut)
    return df.drop("o_orderdate")


def normalized(i: Inputs, part: str = "all") -> DataFrame:
    return lead_files.normalize_leads(lead_files.canonical_rows(raw(i, part)))


@stored("leads-imported")
def imported(i: Inputs) -> DataFrame:
    return merging.upsert_leads(None, merged_leads(raw(i)), "b1", 1, DAY)


@stored("leads-before")
def imported_before(i: Inputs) -> DataFrame:
    return merging.upsert_leads(None, merged_leads(raw(i, "before")), "b1", 1, DAY)


@stored("page-findings-all")
def all_findings(i: Inputs) -> DataFrame:
    return pages.page_findings(i.site_pages().withColumn("is_home", F.col("kind") == "home"), DAY)


@stored("fetch-findings")
def crawl_findings(i: Inputs) -> DataFrame:
    return pages.fetch_findings(pages.clean_fetches(i.page_fetches()), DAY)


@stored("site-signals")
def signals_table(i: Inputs) -> DataFrame:
    found, status = pages.site_pages(crawl_findings(i))
    return site_signals.site_signals(site_signals.site_rollup(found, DAY), status, DAY)


@stored("leads-enriched")
def enriched(i: Inputs) -> DataFrame:
    return enrichment.enrich_leads(imported(i), signals_table(i), i.mx_hosts(), DAY, enriched_at=NOW)


def edits(i: Inputs) -> DataFrame:
    """Edits by lead key: the company number of an edit is that of the company's site."""
    site = F.concat(F.lit("s"), F.col("lead_no").cast("string"), F.lit(".test"))
    keys = imported(i).select("lead_key", "domain")
    return i.lead_edits().withColumn("domain", site).join(keys, "domain")


@stored("leads-worked")
def worked(i: Inputs) -> DataFrame:
    return views.apply_edits(enriched(i), edits(i))


def quoted(df: DataFrame, **quotes: str) -> DataFrame:
    """Long form: domain, kind, key, quote of the pages that have one."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("quote")) for k, c in quotes.items()])
    return df.select("domain", "kind", F.explode(rows).alias("r")).select("domain", "kind", "r.*").where(
        F.col("quote").isNotNull())


def joined(c: str):
    return F.array_join(c, ", ")


# ---- sources ---------------------------------------------------------------------------

def _csv_copy(i: Inputs, sep: str) -> str:
    path = shared_dir(i.spark, "lead-files")
    raw(i).drop("ord").write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"') \
        .csv(path)
    return path


@query
def scan_leads_csv(i):
    path = _csv_copy(i, ",")
    return lead_files.canonical_rows(lead_files.scan_leads_csv(i.spark, path)).drop("ord")


@query
def scan_leads_split(i):
    """Lead files in which each third city stands between line breaks, read in splits."""
    broken = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("\n"), "city", F.lit(" \r\n,\""))).otherwise(F.col("city"))
    path = shared_dir(i.spark, "lead-files")
    raw(i).withColumn("city", broken).drop("ord").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    rows = lead_files.scan_lead_files(i.spark, path)
    return rows.drop("ord").withColumn("city", F.regexp_replace("city", ' ,"$', ""))


@query
def detect_delimiter(i):
    path = _csv_copy(i, ";")
    sep = lead_files.detect_delimiter(i.spark, path)
    rows = lead_files.canonical_rows(lead_files.scan_leads_csv(i.spark, path, sep))
    return rows.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count("website").alias("sites")).select(
        "city", "n", "sites", F.lit(sep).alias("sep"))


@query
def scan_page_corpus(i):
    return page_tables.scan_page_corpus(i.given("pages")).select(
        "url", "status", "final_url", F.length("html").cast("bigint").alias("chars"), "blocked")


@query
def scan_recorded_sites(i):
    site = i.site_pages()
    path = F.regexp_replace(ht.url_path(F.col("url")), "(.)/+$", "$1")
    page_lines = site.select(F.to_json(F.create_map("domain", F.create_map(path, "html"))).alias("value"))
    codes = i.page_fetches().where(F.col("status") == 403).select(
        F.to_json(F.create_map("domain", F.create_map(F.lit("__status__"), F.lit("403")))).alias("value"))
    folder = shared_dir(i.spark, "recorded-sites")
    page_lines.unionByName(codes).write.text(folder)
    recorded, sites = page_tables.scan_recorded_sites(i.spark, folder)
    urls = site.select("url").unionByName(site.select(F.concat("url", F.lit("x")).alias("url"))).unionByName(
        i.given("pages").select("url"))
    return page_tables.recorded_fetches(urls, recorded, sites).select(
        "url", "status", "final_url", F.length("html").cast("bigint").alias("chars"), "blocked", "error")


@query
def read_params_table(i):
    value = F.to_json(F.struct(
        F.max("c_nationkey").alias("min_years"), F.create_map(F.lit("upside"), F.min("c_nationkey")).alias("weights")))
    settings = i.given("customer").agg(value.alias("value")).select(F.lit("icp").alias("key"), "value")
    return read_params(settings).select(
        "employees_min", "employees_max", "min_years", F.size("target_industries").alias("n_targets"),
        F.size("weights").alias("n_weights"), F.col("weights")["upside"].alias("weight_upside"))


# ---- projections ------------------------------------------------------------------------

@query
def map_headers(i):
    odd = ["Company_Name", "URL ", "Town", "State/Region", "Sector", "Employee_Count", "Annual Revenue", "CEO",
           "E-mail", "Phone Number"]
    df = raw(i)
    renamed = df.select("ord", *[F.col(f).alias(h) for f, h in zip(fv.HEADER_ALIASES, odd)],
                        F.lit("x").alias("Junk"), F.col("ord").cast("string").alias("Contact"))
    return lead_files.canonical_rows(renamed)


@query
def lead_view(i):
    return views.lead_view(worked(i)).select(
        "lead_key", "seq", "name", "domain", "industry", "employees", "owner_name", "email", "email_status", "phone",
        "status", "score", "tier", "confidence", "stage", "years_in_business", "tags.succession",
        "tags.family_owned", "tags.recurring", "tags.hiring")


@query
def lead_detail(i):
    s = "signals."
    return views.lead_detail(worked(i)).select(
        "lead_key", "name", "industry", "score", "notes", "error", "enriched_at", s + "reachable", s + "blocked",
        s + "franchise", s + "founded_year", s + "copyright_year", s + "digital_maturity", s + "employees_hint",
        F.coalesce(joined(s + "pages_crawled"), F.lit("")).alias("pages_crawled"), joined(s + "emails").alias("emails"),
        joined(s + "phones").alias("phones"), joined(s + "recurring_terms").alias("recurring_terms"),
        s + "description", s + "tech.cms", s + "tech.https", s + "tech.mobile_friendly", s + "tech.online_booking",
        s + "tech.live_chat", s + "tech.analytics", s + "tech.marketing_automation", s + "industry_guess")


@query
def display_labels(i):
    return views.display_labels(worked(i))


@query
def component_rows(i):
    return views.component_rows(worked(i))


@query
def crm_columns(i):
    return views.crm_columns(worked(i))


@query
def brief_facts(i):
    f = views.brief_facts(worked(i)).select("lead_key", "facts.*")
    lists = ["recurring_revenue_offers", "digital_gaps", "top_reasons", "risks"]
    return f.select(*[F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in f.columns])


@query
def evidence_rows(i):
    return views.evidence_rows(worked(i))


# ---- filters -----------------------------------------------------------------------------

def _kept(df: DataFrame) -> DataFrame:
    return df.select("lead_key", "name", "score", "tier", "stage")


def _filter_query(name: str, **args) -> None:
    QUERIES[name] = lambda spark, folder: _kept(filters.filter_leads(worked(Inputs(spark, folder)), **args))


_filter_query("search_text", q="Alder%1")
_filter_query("search_text_literal", q="NATION_1", literal=True)
_filter_query("tier_in", tiers=" a, B,,")
_filter_query("min_score", min_score_=40)
_filter_query("industry_eq", industry="hvac")
_filter_query("stage_in", stage="shortlist,contacted")
_filter_query("has_direct_email", has_email=True)
_filter_query("owner_transition", succession=True)
_filter_query("status_eq", status="failed")
_filter_query("combined_filters", q="s", tiers="B,C,D", min_score_=20, has_email=True, stage="new,passed")


@stored("search-index-folder")
def search_folder(i: Inputs) -> DataFrame:
    """The leads of the first batch and all as they are now, indexed one after the other."""
    path = shared_dir(i.spark, "search-index")
    for rows in (imported_before(i), worked(i)):
        SearchIndex(i.spark, path, buckets=16).add(rows)
    return i.spark.createDataFrame([(path,)], "path string")


def _index_query(name: str, q: str, literal: bool = False) -> None:
    def run(spark, folder):
        i = Inputs(spark, folder)
        index = SearchIndex(spark, search_folder(i).first()["path"])
        return _kept(worked(i).join(index.search(q, literal), "lead_key", "left_semi"))
    QUERIES[name] = run


_index_query("search_text_indexed", "Alder%1")
_index_query("search_text_literal_indexed", "NATION_1", literal=True)
_index_query("search_text_short_indexed", "_1")


@query
def select_for_enrichment(i):
    status = F.when(F.col("state").isNull(), "pending").otherwise(F.col("status"))
    leads = worked(i).withColumn("status", status)
    return filters.select_for_enrichment(leads, edits(i).select("lead_key")).select("lead_key", "name", "status")


@query
def enrich_selected(i):
    """Leads that were edited are enriched, the others stay as imported."""
    out = enrichment.enrich_selected(
        imported(i), signals_table(i), i.mx_hosts(), DAY, ids=edits(i).select("lead_key"))
    return out.select("lead_key", "status", "score")


@query
def named_rows_only(i):
    return lead_files.named_rows_only(lead_files.canonical_rows(raw(i))).select("ord", "name")


@query
def fetch_ok(i):
    return pages.clean_fetches(i.page_fetches()).where("ok").select("url", "status")


@query
def fresh_fetch(i):
    return pages.fresh_fetches(i.page_fetches(), NOW).select("url", "page_id")


@query
def is_blocked(i):
    return pages.clean_fetches(i.page_fetches()).select("url", "status", "blocked")


@query
def html_content_filter(i):
    return pages.clean_fetches(i.page_fetches()).select("url", F.length("html").cast("bigint").alias("chars"))


def robots(i: Inputs) -> DataFrame:
    origin = F.lower(F.regexp_extract("url", ht.ORIGIN, 1))
    kind = F.length("origin") % 4
    body = (
        F.when(kind == 0, "User-agent: *\nDisallow: /en/\nAllow: /")
        .when(kind == 1, "User-Agent: leadbot\nUser-agent: other\nAllow: /en/6\nDisallow: /en/ # none\n\n"
                         "User-agent: *\nDisallow: /")
        .when(kind == 2, "User-agent: *\nDisallow: /")
        .otherwise("# empty\nUser-agent: *\nDisallow:\n\nUser-agent: nobody\nDisallow: /")
    )
    return i.given("pages").select(origin.alias("origin")).distinct().select(
        "origin", F.when(kind == 2, 404).otherwise(200).alias("status"), body.alias("body"))


@query
def robots_filter(i):
    return pages.robots_filter(i.given("pages").select("page_id", "url"), robots(i), AGENT)


@query
def validate_edit(i):
    e = i.lead_edits().select(
        "event_id", F.coalesce("stage", F.lit("archived")).alias("stage"),
        F.repeat("notes", F.col("event_id").cast("int") % 1000).alias("notes"))
    good, bad = filters.validate_edit(e)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(
        bad.select("event_id", F.lit(False).alias("accepted")))


@query
def validate_icp(i):
    params = i.given("part").select(
        "p_partkey", (F.col("p_size") - 5).alias("employees_min"), (F.col("p_partkey") % 60).alias("employees_max"),
        (F.col("p_size") * 3).alias("min_years"))
    good, bad = filters.validate_icp(params)
    return good.select("p_partkey", F.lit(True).alias("accepted")).unionByName(
        bad.select("p_partkey", F.lit(False).alias("accepted")))


@query
def urls_to_refetch(i):
    needed = i.site_pages().select("url").unionByName(i.given("pages").select("url"))
    return pages.urls_to_refetch(needed, i.page_fetches(), NOW)


@query
def lead_by_id(i):
    key = F.md5(F.lit("b1|1|s1.test"))
    wanted = i.spark.range(1).select(key.alias("k")).first()["k"]
    return views.lead_detail(filters.lead_by_id(worked(i), wanted)).select(
        "lead_key", "name", "domain", "score", "stage", "notes", "error")


# ---- joins ---------------------------------------------------------------------------------

def _incoming(i: Inputs) -> DataFrame:
    return merging.dedupe_merge(normalized(i, "after"))


@query
def match_existing(i):
    return merging.match_existing(_incoming(i), imported_before(i)).select("ord", "key", "matched_key")


@query
def upsert_leads(i):
    out = merging.upsert_leads(imported_before(i), _incoming(i), "b2", 2, DAY)
    return out.select("lead_key", "seq", "batch_id", *merging.LEAD_FIELDS)


def _store_of_both(i: Inputs) -> LeadStore:
    store = LeadStore(i.spark, shared_dir(i.spark, "lead-store"), buckets=16)
    store.upsert(merged_leads(raw(i, "before")), "b1", DAY)
    store.upsert(_incoming(i), "b2", DAY)
    return store


@query
def upsert_store(i):
    """The same two batches into a store in buckets."""
    return _store_of_both(i).read().select("lead_key", "seq", "batch_id", *merging.LEAD_FIELDS)


@query
def upsert_store_repeated(i):
    """A batch that comes again, and the store written as one batch."""
    store = _store_of_both(i)
    store.upsert(_incoming(i), "b3", DAY)
    return store.compacted(shared_dir(i.spark, "lead-store")).read().groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("leads"), F.count("domain").alias("with_domain"))


@query
def import_counts(i):
    return merging.upsert_counts(merging.match_existing(_incoming(i), imported_before(i)))


@query
def union_of_inserts_and_updates(i):
    out = merging.upsert_leads(imported_before(i), _incoming(i), "b2", 2, DAY)
    return out.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("leads"), F.count("domain").alias("with_domain"), F.count("phone").alias("with_phone"))


@query
def resolve_links_to_pages(i):
    found = crawl_findings(i)
    links = pages.discovered_links(pages.home_page_fallback(found, ["links"]))
    return pages.resolve_links_to_pages(links, found).select("domain", "kind", "url")


@query
def home_page_fallback(i):
    return pages.site_status(pages.home_page_fallback(crawl_findings(i)))


@query
def mx_join_hosts(i):
    return mx_join(imported(i), i.mx_hosts()).select("lead_key", "email", "has_mx")


@query
def apply_edits(i):
    return views.apply_edits(enriched(i), edits(i)).select("lead_key", "stage", "notes")


def sweep(i: Inputs) -> DataFrame:
    """Five buy boxes, one per region."""
    r = F.col("r_regionkey").cast("int")
    return i.given("region").select(
        r.alias("icp_id"), F.array(F.lit("Plumbing"), F.initcap(F.col("r_name"))).alias("target_industries"),
        (r * 4).alias("employees_min"), (r * 40 + 20).alias("employees_max"), (r * 5).alias("min_years"),
        F.create_map(F.lit("maturity"), 20 + r * 4, F.lit("upside"), 10 - r * 2, F.lit("size"), 15 - r * 2)
        .cast("map<string,int>").alias("weights"))


@query
def weight_shares(i):
    return views.weight_shares(sweep(i))


@query
def cross_params(i):
    return scoring.cross_params(imported(i), sweep(i)).select("lead_key", "icp_id", "icp.min_years")


@query
def franchise_brand_join(i):
    return raw(i).select("ord", "name", sg.first_brand(F.col("name")).alias("brand"))


@query
def franchise_brand_table(i):
    return with_first_brand(raw(i), "name", i.brand_table(), ["ord"]).select("ord", "name", "brand")


@query
def unmatched_site(i):
    return enriched(i).where(F.col("status") == "failed").select("lead_key", "domain", "error")


# ---- aggregates -------------------------------------------------------------------------------

@query
def dedupe_merge(i):
    return merging.dedupe_merge(normalized(i))


@query
def import_with_report(i):
    """The report that comes with an import into a new table."""
    table = VersionedTable(i.spark, shared_dir(i.spark, "lead-table"))
    leads, report = importing.import_with_report(table, raw(i), "b1", DAY)
    return report.crossJoin(leads.agg(F.count(F.lit(1)).alias("leads")))  # one row each


@query
def import_report(i):
    rows = lead_files.canonical_rows(raw(i))
    return merging.import_report(rows, lead_files.normalize_leads(rows))


for _name in ["status_counts", "tier_counts", "stage_counts", "signal_counts", "distinct_industries"]:
    QUERIES[_name] = lambda spark, folder, f=getattr(facets, _name): f(worked(Inputs(spark, folder)))


@query
def stats(i):
    return facets.stats(worked(i))


@stored("facet-counts")
def kept_counts(i: Inputs) -> DataFrame:
    """Counts kept up to date: all leads, then the edits in three portions by time, the last one delivered twice."""
    counts = FacetCounts(i.spark, shared_dir(i.spark, "facet-counts"))
    leads, every = facets.facet_columns(enriched(i), "notes"), materialize(edits(i), "edits")
    counts.apply("import", None, leads)
    cut = [F.lit(t) for t in every.agg(*[F.percentile_approx(F.unix_micros("edited_at"), p) for p in (0.3, 0.7)]).first()]
    at = F.unix_micros("edited_at")
    for name, portion in (("e1", at <= cut[0]), ("e2", (at > cut[0]) & (at <= cut[1])), ("e3", at > cut[1])):
        part = every.where(portion)
        keys = part.select("lead_key").distinct()
        before = leads.join(keys, "lead_key", "left_semi")
        after = materialize(views.apply_edits(before, part), "edited")
        counts.apply(name, before, after)
        if name == "e3":
            counts.apply(name, before, after)
        leads = materialize(leads.join(keys, "lead_key", "left_anti").unionByName(after), "leads-now")
    return counts.read()


@query
def stats_kept(i):
    return facets.stats_of_counts(kept_counts(i))


@query
def industries_kept(i):
    return facets.industries_of_counts(kept_counts(i))


@query
def job_progress(i):
    outcomes = worked(i).select(
        F.coalesce("state", F.lit("none")).alias("batch_id"),
        F.when((F.col("state") == "R1") & F.col("phone").isNull(), "pending").otherwise(F.col("status")).alias("status"))
    return facets.job_progress(outcomes)


@query
def rescore_all(i):
    return scoring.rescore_all(enriched(i), sweep(i), DAY).select(
        "lead_key", "icp_id", "score", "tier", "confidence")


def rolled_sites(i: Inputs) -> DataFrame:
    return site_signals.site_rollup(site_signals.one_page_per_kind(all_findings(i)), DAY)


@query
def site_rollup(i):
    return rolled_sites(i).select(
        "domain", joined("pages_crawled").alias("pages_crawled"), F.col("founded")["year"].alias("founded_year"),
        F.col("owner")["name"].alias("owner_name"), "copyright_year", "employees_hint", *fv.TECH_PATTERNS,
        *[F.col(f"{k}_ev")["page"].alias(f"{k}_page") for k in ("succession", "family_owned", "hiring", "pe_backed")])


@query
def ordered_distinct_collect(i):
    return rolled_sites(i).select(
        "domain", *[joined(c).alias(c) for c in ("emails", "phones", "recurring_terms")])


@query
def founding_year(i):
    f = F.col("founded")
    return rolled_sites(i).where(f.isNotNull()).select(
        "domain", f["year"].alias("founded_year"), f["ev"]["page"].alias("page"), f["ev"]["text"].alias("quote"))


@query
def copyright_year(i):
    return rolled_sites(i).select("domain", "copyright_year")


@query
def industry_argmax(i):
    return rolled_sites(i).select("domain", "industry_guess")


@query
def confidence(i):
    return enriched(i).select("lead_key", "confidence")


# ---- first, top, order ---------------------------------------------------------------------------

def _page_anchors(i: Inputs) -> DataFrame:
    url = F.col("url")
    return i.given("pages").select(
        "page_id", "url", ht.page_links(F.col("html"), url, ht.site_host(url)).alias("links"), "html")


@query
def first_link_per_kind(i):
    p = i.site_pages()
    found = p.select("page_id", ht.page_kind_links(F.col("html"), F.col("url"), F.col("domain")).alias("l"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("l")[k].alias("url")) for k in fv.LINK_PATTERNS])
    return found.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*").where(F.col("url").isNotNull())


@query
def top3_reasons(i):
    return enriched(i).select("lead_key", F.array_join(sc.top_reasons(F.col("breakdown")), "; ").alias("why"))


@query
def best_email(i):
    return fill_contacts(enrichment.attach_signals(imported(i), signals_table(i))).select("lead_key", "email")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("lead_key", "name", "score", "confidence", "seq")


for _name, _sort, _order in [
    ("sort_leads", "score", "desc"), ("sort_leads_by_name", "name", "asc"), ("sort_leads_by_years", "years", "desc"),
    ("sort_leads_by_confidence", "confidence", "asc"),
]:
    QUERIES[_name] = lambda spark, folder, s=_sort, o=_order: _ranked(
        views.sort_leads(worked(Inputs(spark, folder)), s, o))


@query
def top_n_leads(i):
    return _ranked(views.top_n_leads(worked(i), 20))


# ---- strings and contacts ---------------------------------------------------------------------------

@query
def clean_text(i):
    return raw(i).select("ord", *[tx.clean_text(f).alias(f) for f in ("name", "city", "phone")]).unionByName(
        i.given("documents").select("doc_id", tx.clean_text("text"), F.lit(None), F.lit(None)).toDF(
            "ord", "name", "city", "phone"))


@query
def normalize_domain(i):
    return raw(i).select("ord", tx.normalize_domain("website").alias("from_site"), tx.normalize_domain("email").alias(
        "from_email"))


@query
def normalize_name(i):
    return raw(i).select("ord", tx.normalize_name("name").alias("name_key"))


@query
def parse_employees(i):
    return raw(i).select("ord", tx.parse_employees("employees").alias("employees"))


@query
def domain_from_email(i):
    return raw(i).select("ord", tx.domain_from_email(F.lower("email")).alias("domain"))


@query
def dedupe_key(i):
    return normalized(i).select("ord", "key")


@query
def normalize_phone(i):
    return raw(i).select("ord", tx.normalize_phone("phone").alias("phone"))


@query
def classify_email(i):
    return mx_join(imported(i), i.mx_hosts()).select(
        "lead_key", ct.classify_email("email", F.col("has_mx")).alias("email_status"))


@query
def email_rank(i):
    return raw(i).where(F.col("email").isNotNull()).select(
        "ord", ct.email_rank(F.lower("email"), F.col("owner_name"), tx.normalize_domain("website")).alias("rank"))


@query
def extract_emails(i):
    return i.given("documents").select(
        F.col("doc_id").alias("id"), joined(ct.extract_emails("text", None)).alias("emails")
    ).unionByName(i.site_pages().select("page_id", joined(ct.extract_emails("html", None))).toDF("id", "emails"))


@query
def extract_phones(i):
    return i.given("documents").select(
        F.col("doc_id").alias("id"), joined(ct.extract_phones("text", None)).alias("phones")
    ).unionByName(all_findings(i).select("page_id", joined("phones")).toDF("id", "phones"))


@query
def html_to_text(i):
    return i.given("pages").select("page_id", ht.html_to_text("html").alias("text"))


@query
def snippet(i):
    return quoted(all_findings(i), family_owned="family_owned_quote", hiring="hiring_quote",
                  testimonials="testimonials_quote", recurring_revenue="recurring_quote")


@query
def html_title_and_description(i):
    html = F.col("html")
    return i.site_pages().select(
        "page_id", ht.html_title("html").alias("title"),
        ht.page_description(ht.meta_description(html), F.substring(ht.html_to_text(html), 1, 220)).alias("description"))


@query
def social_links(i):
    hrefs = F.transform(ht.anchors("html"), lambda a: a["href"])
    return i.site_pages().select("page_id", ht.social_links(hrefs).alias("s")).select("page_id", "s.*")


@query
def resolve_url(i):
    url = F.col("url")
    rows = i.given("pages").select("page_id", "url", F.posexplode(ht.anchors("html")).alias("pos", "a"))
    full = rows.select("page_id", (F.col("pos") + 1).alias("pos"), F.col("a.href").alias("href"),
                       ht.resolve_url(F.col("a.href"), url).alias("resolved"), ht.site_host(url).alias("host"))
    inside = F.coalesce((ht.site_host(F.col("resolved")) == F.col("host")) & ~ht.url_path(F.col("resolved")).isin("", "/"),
                        F.lit(False))
    return full.select("page_id", "pos", "href", F.col("resolved").alias("url"), inside.alias("inside"))


@query
def page_kind(i):
    rows = _page_anchors(i).select("page_id", F.posexplode("links").alias("pos", "l"))
    return rows.select("page_id", "l.url", *[ht.is_page_kind(F.col("l.haystack"), k).alias(k) for k in fv.LINK_PATTERNS])


@query
def industry_match(i):
    targets = tx.str_array(fv.DEFAULT_ICP["target_industries"])
    return raw(i).where(F.col("industry").isNotNull()).select(
        "ord", "industry", tx.industry_matches(F.col("industry"), targets).alias("is_target"))


@query
def owner_split(i):
    first, last = tx.split_owner(F.col("owner_name"))
    return raw(i).select("ord", first.alias("first"), last.alias("last"),
                         tx.first_name(F.col("owner_name")).alias("greeting"))


# ---- signals of pages ---------------------------------------------------------------------------------

@query
def keyword_signals(i):
    return quoted(all_findings(i), **{k: f"{k}_quote" for k in fv.KEYWORD_PATTERNS})


@query
def franchise_strong(i):
    own = F.coalesce(F.col("signals.evidence")["franchise"]["page"], F.lit(""))
    return enriched(i).where(F.col("signals.franchise")).select(
        "lead_key", "name", own.alias("page"), F.col("signals.evidence")["franchise"]["text"].alias("quote"))


@query
def franchise_weak(i):
    return quoted(all_findings(i), weak_franchise="weak_franchise_quote")


@query
def recurring_terms(i):
    return all_findings(i).select("domain", "kind", F.coalesce(joined("recurring_terms"), F.lit("")).alias("terms"))


@query
def year_candidates(i):
    text = ht.html_to_text("html")
    rows = i.site_pages().select("domain", "kind", F.explode(sg.year_candidates(text, DAY)).alias("c"))
    return rows.select("domain", "kind", "c.year", "c.family", (F.col("c.pos") + 1).alias("pos"))


@query
def owner_name(i):
    o = F.col("owner")
    return all_findings(i).where(o.isNotNull()).select("domain", "kind", o["name"].alias("owner"), o["quote"].alias("quote"))


@query
def employees_hint(i):
    return all_findings(i).select("domain", "kind", "employees_hint")


@query
def tech_profile(i):
    return rolled_sites(i).select("domain", sg.cms_name(F.col("cms_rank")).alias("cms"), "mobile_friendly",
                                  *fv.TECH_PATTERNS)


@query
def digital_maturity(i):
    return signals_table(i).select("domain", "signals.reachable", "signals.digital_maturity")


@query
def enrich_contacts_of_leads(i):
    leads = enrichment.attach_signals(imported(i), signals_table(i))
    return enrich_contacts(leads, i.mx_hosts()).select("lead_key", "email", "phone", "email_status")


@query
def enrich_status_of_leads(i):
    leads = enrichment.attach_signals(imported(i), signals_table(i))
    return leads.select("lead_key", enrich_status(F.col("signals.reachable")).alias("status"),
                        F.col("signals.crawl_error").alias("error"))


# ---- scoring --------------------------------------------------------------------------------------------

def _component_query(key: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = enriched(Inputs(spark, folder)).select("lead_key", F.explode("breakdown").alias("b"))
        return rows.where(F.col("b.key") == key).select(
            "lead_key", "b.ratio", "b.points", "b.max", "b.reason", "b.known")
    return run


for _key in fv.COMPONENT_LABELS:
    QUERIES[f"score_{_key}"] = _component_query(_key)


@query
def score_combined(i):
    return scoring.score_leads(enriched(i), None, DAY).select(
        "lead_key", F.aggregate("breakdown", F.lit(0.0), lambda a, b: a + b["points"]).alias("points"), "score",
        "tier", "confidence")


@query
def score_deductions(i):
    s = F.col("signals")
    return enriched(i).where(s["pe_backed"] | s["franchise"]).select(
        "lead_key", F.coalesce(s["pe_backed"], F.lit(False)).alias("pe_backed"),
        F.coalesce(s["franchise"], F.lit(False)).alias("franchise"), "score")


@query
def score_flags(i):
    rows = enriched(i).select("lead_key", F.posexplode("flags").alias("pos", "f"))
    return rows.select("lead_key", (F.col("pos") + 1).alias("pos"), "f.level", "f.text")


@query
def score_tier(i):
    return enriched(i).select("lead_key", "score", "tier")


@query
def scores_before_enrichment(i):
    return scoring.score_leads(imported(i), None, DAY).select(
        "lead_key", "score", "tier", "confidence",
        F.array_join(F.transform("flags", lambda f: f["text"]), "; ").alias("flag_texts"))


# ---- briefs ------------------------------------------------------------------------------------------------

def _brief_row(df: DataFrame) -> DataFrame:
    b = F.col("brief")
    return df.select(
        "lead_key", b["source"].alias("source"), b["summary"].alias("summary"),
        F.array_join(b["why_it_fits"], "; ").alias("why"), F.array_join(b["risks"], "; ").alias("risks"),
        F.array_join(b["questions"], "; ").alias("questions"), b["email_subject"].alias("subject"),
        b["email_body"].alias("body"))


@query
def template_brief(i):
    return _brief_row(briefs.template_brief(worked(i)))


def brief_responses(i: Inputs) -> DataFrame:
    """Last message of a conversation as the supplied answer for the company of that number."""
    texts = i.given("conversations").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("text"), F.max_by("role", "turn").alias("role"))
    whole = F.to_json(F.struct(
        F.col("text").alias("summary"), F.array("role").alias("why_it_fits"), F.array("role").alias("risks"),
        F.array("role").alias("questions"), F.lit("Hi").alias("email_subject"), F.col("text").alias("email_body")))
    part = F.to_json(F.struct(F.col("text").alias("summary")))
    n = F.col("conv_id") % 4
    answer = (
        F.when(n == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(n == 1, part).when(n == 2, F.col("text"))
        .otherwise(whole))
    site = F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit(".test"))
    return texts.select(site.alias("domain"), answer.alias("text")).join(
        imported(i).select("lead_key", "domain"), "domain").select("lead_key", "text")


@query
def parse_brief_responses(i):
    return _brief_row(briefs.parse_brief_responses(worked(i), brief_responses(i)))


# ---- sinks and streaming ---------------------------------------------------------------------------------------

@query
def export_crm_csv(i):
    path = shared_dir(i.spark, "crm")
    sinks.export_crm_csv(worked(i), path)
    schema = ", ".join(f"`{c}` string" for c in fv.CRM_COLUMNS)
    back = i.spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in fv.CRM_COLUMNS])


@query
def write_snapshot_json(i):
    path = snapshot_folder(i).first()["path"]
    rows = i.spark.read.schema("lead_key string, score int, tier string, industry string").json(f"{path}/leads")
    raw_ind = i.spark.read.schema("lead_key string, industry string").json(f"{path}/raw_industries")
    details = i.spark.read.schema("lead_key string, notes string").json(f"{path}/details")
    return rows.join(raw_ind.withColumnRenamed("industry", "raw_industry"), "lead_key").join(details, "lead_key")


@stored("snapshot-folder")
def snapshot_folder(i: Inputs) -> DataFrame:
    path = shared_dir(i.spark, "snapshot")
    sinks.write_snapshot_json(worked(i), sweep(i), path)
    return i.spark.createDataFrame([(path,)], "path string")


@query
def snapshot_stats(i):
    """The counts of a snapshot as its reader finds them."""
    names = facets.stats(worked(i)).columns
    return i.spark.read.schema(", ".join(f"{c} long" for c in names)).json(f"{snapshot_folder(i).first()['path']}/stats")


@query
def snapshot_settings(i):
    """The buy boxes of a snapshot as its reader finds them."""
    schema = "icp_id int, target_industries array<string>, employees_min int, employees_max int, min_years int, weights map<string,int>"
    rows = i.spark.read.schema(schema).json(f"{snapshot_folder(i).first()['path']}/settings")
    return rows.select("icp_id", F.lower(joined("target_industries")).alias("industries"), "employees_min", "employees_max", "min_years",
                       *[F.col("weights")[w].alias(w) for w in ("maturity", "upside", "size")])


def fetched_again(i: Inputs) -> DataFrame:
    """Every page once more: each second one later than before, the others earlier."""
    shift = F.expr("make_interval(0, 0, 0, 0, CAST(page_id % 2 AS INT) * 2 - 1)")
    return i.page_fetches().withColumn("fetched_at", F.col("fetched_at") + shift).withColumn(
        "html", F.concat("html", F.lit(" again"), F.col("page_id").cast("string")))


@query
def store_fetches(i):
    path = shared_dir(i.spark, "fetches")
    sinks.write_fetches(i.page_fetches().unionByName(fetched_again(i)), path)
    return i.spark.read.parquet(path).select("url", "status", F.length("html").cast("bigint").alias("chars"))


@query
def store_fetches_merged(i):
    """The same fetches as two batches, and the first once more, merged into a store."""
    store = FetchStore(i.spark, shared_dir(i.spark, "fetch-store"), buckets=16)
    for batch in (i.page_fetches(), fetched_again(i), i.page_fetches()):
        store.upsert(batch)
    return store.read().select("url", "status", F.length("html").cast("bigint").alias("chars"))


@query
def urls_to_refetch_stored(i):
    """What is due by the heads of a store; no HTML is read."""
    store = FetchStore(i.spark, shared_dir(i.spark, "fetch-store"), buckets=16)
    store.upsert(i.page_fetches())
    needed = i.site_pages().select("url").unionByName(i.given("pages").select("url"))
    return pages.urls_to_refetch(needed, store.heads(), NOW)


@query
def store_scores(i):
    return sinks.store_scores(enriched(i), shared_dir(i.spark, "scores")).select(
        "lead_key", "score", "tier", "confidence", F.size("breakdown").alias("components"),
        F.size("flags").alias("n_flags"))


LEAD_FIELD_NAMES = list(fv.HEADER_ALIASES)
LEAD_FILE_HEADS = [(",", LEAD_FIELD_NAMES), (";", LEAD_FIELD_NAMES[::-1]), ("\t", sorted(LEAD_FIELD_NAMES))]


def lead_files_arrive(i: Inputs, folder: str, part: str, sep: str, order: list[str]) -> None:
    # files in the order of rows, which decides between equal ones
    raw(i, part).orderBy("ord").select(*[F.col(f).alias(fv.HEADER_ALIASES[f][0].upper()) for f in order]).write.mode("append") \
        .option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(folder)


@query
def incremental_import_stream(i):
    """Both halves of the lead list and a repeat of the first arrive as files."""
    folder = shared_dir(i.spark, "arrivals")
    for part, (sep, order) in zip(("before", "after", "before"), LEAD_FILE_HEADS):
        lead_files_arrive(i, folder, part, sep, order)
    table = VersionedTable(i.spark, shared_dir(i.spark, "lead-table"))
    incremental_import(i.spark, folder, table, shared_dir(i.spark, "stream-state"), DAY) \
        .awaitTermination()
    return table.read().groupBy(F.col("domain").isNotNull().alias("has_domain")).agg(
        F.count(F.lit(1)).alias("leads"), F.count_distinct("domain").alias("domains"))


@query
def incremental_import_store(i):
    """Files that arrive one half after the other, the second twice; each batch writes only what it changes."""
    folder, state = shared_dir(i.spark, "arrivals"), shared_dir(i.spark, "stream-state")
    store = LeadStore(i.spark, shared_dir(i.spark, "lead-store"), buckets=16)
    for part, (sep, order) in zip(("before", "after", "after"), LEAD_FILE_HEADS):
        lead_files_arrive(i, folder, part, sep, order)
        incremental_import(i.spark, folder, store, state, DAY).awaitTermination()
    return store.read().groupBy("batch_id").agg(F.count(F.lit(1)).alias("leads"), F.count("domain").alias("with_domain"))


def follow_arrivals(i: Inputs, parts: list[DataFrame], follow: Callable[[DataFrame], StreamingQuery]) -> None:
    """Tables that arrive one after another; the stream takes up each as it is there."""
    folder = shared_dir(i.spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(folder)
        follow(i.spark.readStream.schema(part.schema).parquet(folder)).awaitTermination()


@query
def urls_to_refetch_stream(i):
    """What is due after a stream of all fetches, each twice and the later one not always last, and a tick of the clock."""
    tick = i.spark.range(1).select(F.lit(None).cast("string").alias("url"), F.lit(0).alias("status"), F.lit(NOW).alias("fetched_at"))
    heads = [f.select("url", F.col("status").cast("int").alias("status"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
             for f in (fetched_again(i), i.page_fetches(), tick)]
    log, state = shared_dir(i.spark, "turns"), shared_dir(i.spark, "stream-state")
    follow_arrivals(i, heads, lambda fetches: follow_fetches(fetches, log, state))
    needed = i.site_pages().select("url").unionByName(i.given("pages").select("url"))
    return due_urls(needed, i.spark.read.parquet(log))


@query
def apply_edits_stream(i):
    """Edits that arrive in no order of time, in three batches."""
    rows = edits(i).select("lead_key", F.col("edited_at").cast("timestamp").alias("edited_at"), "stage", "notes")
    turn = F.pmod(F.xxhash64("lead_key", "edited_at"), F.lit(3))
    parts = [rows.where(turn == n) for n in range(3)]
    log, state = shared_dir(i.spark, "edit-log"), shared_dir(i.spark, "stream-state")
    follow_arrivals(i, parts, lambda found: collect_edits(found, log, state, lateness="40 days", span="1 day"))
    return views.apply_edits(enriched(i), latest_edits(i.spark, log)).select("lead_key", "stage", "notes")


@query
def import_batches(i):
    """Two batches and a repeat of the second through the versioned table."""
    table = VersionedTable(i.spark, shared_dir(i.spark, "lead-table"))
    for name, part in (("b1", "before"), ("b2", "after"), ("b3", "after")):
        import_rows(table, raw(i, part), name, DAY)
    return table.read().groupBy("batch_id").agg(F.count(F.lit(1)).alias("leads"), F.count("domain").alias("with_domain"))
