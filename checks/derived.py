"""Inputs derived from the given tables by SQL that Spark and the oracle engine both run.

Every text is plain SQL common to both; the few differing functions go through `DIALECTS`.
All rows of the source tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TODAY = "2026-09-16"
AS_OF = "2026-09-16 12:00:00"
AS_OF_EPOCH = 1789560000  # AS_OF in UTC
BATCH_CUT = "1998-04-25"

DIALECTS = {
    "spark": {"ts": "timestamp_seconds({})", "ntz": "CAST({} AS TIMESTAMP)"},
    "oracle": {"ts": "make_timestamp(CAST(({}) * 1000000 AS BIGINT))", "ntz": "{}"},
}


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pick(key: str, values: list[str | None]) -> str:
    """CASE over key % len(values); values are SQL expressions, None is NULL."""
    arms = " ".join(f"WHEN {i} THEN {v if v is not None else 'NULL'}" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {arms} END"


K, C = "o_orderkey", "o_custkey"
_NO = _s(C)
_SITE = f"'s' || {_NO} || '.test'"
_NUM4 = f"lpad({_s(C + ' % 10000')}, 4, '0')"
_SUFFIX = _pick(K, ["''", "' LLC'", "', Inc.'", "'  Ltd '"])
_WORD = _pick(C, ["'Alder'", "'Birch & Sons'", "'The Cobalt'", "'Dune'", "'Ember'"])
_TRADE = _pick(C, ["'Heating'", "'Plumbing'", "'Roofing Co'", "'Dental'", "'Freight'", "'Studio'", "'Accounting'"])

# 5 spellings of a website, 4 of a name, 7 of a headcount ... so that rows of one company differ
LEADS_RAW = f"""
SELECT CAST({K} AS BIGINT) AS ord,
  CASE WHEN {K} % 97 = 0 THEN '  '
       WHEN {C} % 29 = 0 THEN 'Molly Maid of Town ' || {_NO} || {_SUFFIX}
       ELSE {_WORD} || ' ' || {_TRADE} || ' ' || {_NO} || {_SUFFIX} END AS name,
  {_pick(K, [_SITE, f"'https://www.s' || {_NO} || '.test/'", f"'WWW.S' || {_NO} || '.Test/about?x=1'", None,
             "'not a website'", f"'http://user@s' || {_NO} || '.test:8080/x'"])} AS website,
  {_pick(K, [None, "'  ' || n_name || '  '", "n_name", "n_name", "n_name"])} AS city,
  CASE WHEN {C} % 3 = 0 THEN NULL ELSE 'R' || {_s('n_regionkey')} END AS state,
  CASE WHEN ({K} + {C}) % 4 = 0 THEN NULL ELSE
  {_pick(C, ["'HVAC'", "'Plumbing'", "'Dental'", "'Commercial Cleaning'", "'Toys'", "c_mktsegment"])} END AS industry,
  {_pick(K, [None, _s(f'{C} % 200'), f"{_s(f'{C} % 50')} || '-' || {_s(f'{C} % 50 + 40')}",
             f"'1,' || lpad({_s(f'{C} % 1000')}, 3, '0')", "'0'", f"'about ' || {_s(f'{C} % 90')} || ' people'",
             "'unknown'"])} AS employees,
  {_pick(K, [None, f"'$' || {_s(f'{C} % 20')} || 'M'", f"'$' || {_s(f'{C} % 20')} || 'M'"])} AS revenue_estimate,
  CASE WHEN {K} % 4 <> 1 THEN NULL WHEN {C} % 11 = 0 THEN 'Cher' ELSE
  {_pick(C, ["'Ada'", "'Ben'", "'Cleo'", "'Dan'"])} || ' ' ||
  {_pick(C, ["'Stone'", "'Van Rivers'", "'Fields'"])} END AS owner_name,
  {_pick(K, [f"'Info@s' || {_NO} || '.test'", f"'ada.stone@s' || {_NO} || '.test'",
             f"'owner' || {_NO} || '@gmail.com'", "'bad@@mail'",
             f"'x' || {_NO} || '@m' || {_s(f'{C} % 40')} || '.example'", None, None, None, None])} AS email,
  {_pick(K, [None, f"'555-201-' || {_NUM4}", f"'(555) 202 ' || {_NUM4}", f"'1.555.203.' || {_NUM4}",
             f"'ext ' || {_s(f'{C} % 100')} || ' '"])} AS phone,
  o_orderdate
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

# five pages per site: home, about, services, contact, careers
P = "page_id"
SITE_NO = f"CAST(floor({P} / 5.0) AS BIGINT)"
N = "n"
_NS = _s(N)
_WHEN = lambda cond, text: f"CASE WHEN {cond} THEN {text} ELSE '' END"
_SUFFIX_HTML = " || ".join([
    _WHEN("kind = 'home'", f"""'<nav><a href="/about#team">About us</a> <a href="services/">What we do</a> """
          f"""<a href="https://www.s' || {_NS} || '.test/contact">Reach us</a> """
          f"""<a class="x>y" href="//s' || {_NS} || '.test/careers?src=nav">Jobs</a> """
          f"""<a href="https://facebook.com/s' || {_NS} || '">fb</a> <a href="mailto:a@s.test">mail</a></nav>'"""),
    _WHEN(f"{P} % 2 = 0", "'<meta name=\"viewport\" content=\"width=device-width\">'"),
    _pick(P, [f"""'<meta content="  Shop &amp; service no ' || {_NS} || ' &ldquo;here&rdquo; " name="description">'""",
              "'<meta property=\"og:description\" content=\"Open &#8217;til late\">'", "''"]),
    _WHEN(f"{P} % 4 = 1", f"' <p>Proudly family-owned since 19' || lpad({_s(f'50 + {N} % 50')}, 2, '0') || ' in town. "
                          f"Est. 2031 or since 1989.</p>'"),
    _WHEN(f"{P} % 4 = 2", f"'<p>Serving people for over ' || {_s(f'{N} % 60')} || ' years with care.</p>'"),
    _pick(P, ["'<p>See our Maintenance Plans and annual service contracts; recurring visits.</p>'", "''", "''",
              "'<p>Ask about MEMBERSHIP&nbsp;and our service agreements.</p>'", "''", "''"]),
    _pick(P, ["''", "'<div>Mary Smith, the owner, still opens the door each day.</div>'", "''",
              "'<div>President Carl Novak leads more than 210 employees.</div>'", "''",
              "'<div>Our Team, owner of it all. Ask our founder Jo Ann-Lee today.</div>'", "''"]),
    _WHEN(f"{P} % 8 = 1", "'<p>Locally owned and operated.</p>'"),
    _WHEN(f"{P} % 16 = 1", "'<p>Part of the Molly Maid network.</p>'"),
    _WHEN(f"{P} % 27 = 4", "'<p>Become a franchisee today</p>'"),
    _WHEN(f"{P} % 9 = 4", "'<p>We are <b>now hiring</b> &mdash; join our team!</p>'"),
    _WHEN(f"{P} % 11 = 3", "'<p>She is planning her retirement next year.</p>'"),
    _WHEN(f"{P} % 13 = 2", "'<p>A firm backed by North &lt;Lake&gt; Capital since 2019.</p>'"),
    _WHEN(f"{P} % 14 = 6", "'<p>Read our reviews</p>'"),
    _WHEN(f"{P} % 3 <> 1", f"'<footer>&copy; 2001 - 20' || lpad({_s(f'{N} % 27')}, 2, '0') || ' Town Co</footer>'"),
    _WHEN("kind = 'contact'", f"'<p>Mail Info@s' || {_NS} || '.test or ada@s' || {_NS} || "
                              f"'.test, not me@example.com; see logo@2x.png. Call (555) 201-' || "
                              f"lpad({_s(f'{N} % 10000')}, 4, '0') || ' or +1 555-202-0199.</p>'"),
    _WHEN(f"{P} % 10 = 7", "'<p>Our team of 42 technicians is ready.</p>'"),
    _pick(N, ["'<p>heating and furnace repair</p>'", "'<p>plumbing and drain work, new plumbing</p>'",
              "'<p>dental care by a dentist</p>'", "'<p>good things</p>'"]),
    _WHEN(f"{P} % 6 = 1", "'<link href=\"/wp-content/x.css\">'"),
    _WHEN(f"{P} % 7 = 2", "'<script src=\"https://www.googletagmanager.com/g.js\">var book = 1;</script>'"),
    _WHEN(f"{P} % 9 = 1", "'<p>Book Online</p>'"),
    _WHEN(f"{P} % 12 = 5", "'<iframe src=\"https://tawk.to/x\"></iframe>'"),
    _WHEN(f"{P} % 15 = 3", "'<script>mailchimp()</script>'"),
])
_TITLE = (
    f"CASE WHEN {N} % 9 = 1 THEN replace(html, '<title>', '<title>TruGreen of Town ') "
    f"WHEN {N} % 11 = 2 AND kind = 'home' THEN replace(html, '<title>', '<title>Just a moment ') ELSE html END"
)
SITE_PAGES = f"""
SELECT page_id, n, domain, kind, CASE WHEN n % 7 = 3 THEN 'http://' ELSE 'https://' END || domain || path AS url,
  {_TITLE} || {_SUFFIX_HTML} AS html
FROM (
  SELECT page_id, {SITE_NO} AS n, 's' || {_s(SITE_NO)} || '.test' AS domain, html,
    {_pick(P, ["'home'", "'about'", "'services'", "'contact'", "'careers'"])} AS kind,
    {_pick(P, ["'/'", "'/about'", "'/services'", "'/contact'", "'/careers?src=nav'"])} AS path
  FROM {{pages}}
)
"""

PAGE_FETCHES = f"""
SELECT url, CAST(CASE WHEN kind = 'home' AND n % 13 = 5 THEN 403 WHEN kind = 'home' AND n % 13 = 7 THEN 0
    WHEN page_id % 17 = 4 THEN 404 WHEN page_id % 19 = 7 THEN 503 ELSE 200 END AS INT) AS status,
  CASE WHEN n % 7 = 3 THEN replace(url, 'http://', 'https://') ELSE url END AS final_url,
  CASE WHEN kind = 'home' AND n % 13 = 5 THEN 'Please solve the CAPTCHA' WHEN kind = 'home' AND n % 13 = 7 THEN ''
    ELSE html END AS html,
  CASE WHEN page_id % 21 = 8 THEN 'application/pdf' WHEN page_id % 3 = 0 THEN 'text/html; charset=utf-8'
    ELSE NULL END AS content_type,
  CASE WHEN kind = 'home' AND n % 13 = 7 THEN 'Timed out' ELSE NULL END AS error,
  {{ts:{AS_OF_EPOCH} - 3600 * (page_id % 100)}} AS fetched_at, page_id, n, domain, kind
FROM {{site_pages}}
"""

MX_HOSTS = f"""
SELECT host, CASE WHEN k % 3 = 0 THEN TRUE WHEN k % 3 = 1 THEN FALSE ELSE NULL END AS has_mx FROM (
  SELECT host, max(k) AS k FROM (
    SELECT 's' || {_NO} || '.test' AS host, {C} AS k FROM {{orders}}
    UNION ALL SELECT 'm' || {_s(f'{C} % 40')} || '.example' AS host, {C} % 40 AS k FROM {{orders}}
    UNION ALL SELECT 'gmail.com' AS host, 0 AS k FROM {{orders}}
  ) GROUP BY host
)
"""

# one brand for each customer, in an order of its own; some lie inside others ("heating 1" in "heating 12")
BRAND_TABLE = f"""
SELECT CAST({C.replace('o_', 'c_')} * 7919 % 1000003 AS BIGINT) AS ord,
  {_pick('c_custkey', ["'Heating '", "'plumbing '", "'MAID OF TOWN '", "'ember dental '"])} || {_s('c_custkey')} AS brand
FROM {{customer}}
"""

# edits of leads by the people in the event log; user ids stand for company numbers
LEAD_EDITS = """
SELECT user_id AS lead_no, event_id,
  CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'shortlist' WHEN 'purchase' THEN 'contacted'
    WHEN 'signup' THEN 'passed' ELSE NULL END AS stage,
  CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 7 = 1 THEN '' ELSE NULL END AS notes,
  {ntz:ts} AS edited_at
FROM {events}
"""


def render(sql: str, dialect: str, names: dict[str, str]) -> str:
    """Fill table names and dialect functions."""
    out = sql
    for fn, template in DIALECTS[dialect].items():
        mark = "{" + fn + ":"
        while mark in out:
            start = out.index(mark)
            end = out.index("}", start)
            out = out[:start] + template.format(out[start + len(mark):end]) + out[end + 1:]
    for name, target in names.items():
        out = out.replace("{" + name + "}", target)
    return out


# tables that feed costly map-only work, each one file here, which one task would read: key and rows of a task at most
DEALT = {"orders": ("o_orderkey", 250_000), "pages": ("page_id", 2_500), "documents": ("doc_id", 10_000)}


class Inputs:
    """Given and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in DEALT:
            return table
        key, rows = DEALT[name]
        # by the rows (of the file footers), too: the cores are those registered by now, early in a session only some
        return table.repartition(max(self.spark.sparkContext.defaultParallelism, -(-table.count() // rows)), key)

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(render(text, "spark", {}), **tables)

    def leads_raw(self) -> DataFrame:
        return self._sql(LEADS_RAW, orders=self.given("orders"), customer=self.given("customer"),
                         nation=self.given("nation"))

    def site_pages(self) -> DataFrame:
        return self._sql(SITE_PAGES, pages=self.given("pages"))

    def page_fetches(self) -> DataFrame:
        return self._sql(PAGE_FETCHES, site_pages=self.site_pages())

    def mx_hosts(self) -> DataFrame:
        return self._sql(MX_HOSTS, orders=self.given("orders"))

    def brand_table(self) -> DataFrame:
        return self._sql(BRAND_TABLE, customer=self.given("customer"))

    def lead_edits(self) -> DataFrame:
        return self._sql(LEAD_EDITS, events=self.given("events"))
