"""Oracle building blocks: named common table expressions and small SQL text helpers."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from checks import derived as dv
from leadfit import fixed_values as fv

YEAR = int(dv.TODAY[:4])


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def clean(c: str) -> str:
    return f"nullif(trim(regexp_replace(replace({c}, chr(160), ' '), '\\s+', ' ', 'g')), '')"


def name_key(c: str) -> str:
    step = f"regexp_replace(replace(lower({c}), '&', ' and '), {q(fv.LEGAL_WORDS)}, ' ', 'g')"
    step = f"regexp_replace({step}, '[^a-z0-9 ]', ' ', 'g')"
    return f"trim(regexp_replace({step}, '\\s+', ' ', 'g'))"


def domain(c: str) -> str:
    v = f"lower(trim({c}))"
    v = f"CASE WHEN contains({v}, '@') AND NOT contains({v}, '/') THEN substr({v}, strpos({v}, '@') + 1) ELSE {v} END"
    v = f"CASE WHEN regexp_matches({v}, '^[a-z]+://') THEN {v} ELSE 'http://' || {v} END"
    host = f"regexp_extract({v}, '^[a-z]+://(?:[^/?#]*@)?([^/?#:@]*)', 1)"
    host = f"trim(regexp_replace({host}, '^www\\.', ''), '.')"
    return f"CASE WHEN regexp_matches({host}, {q(fv.HOST_PATTERN)}) THEN {host} END"


def employees(c: str) -> str:
    found = f"regexp_extract_all({c}, '\\d[\\d,]*')"
    num = lambda i: f"try_cast(replace({found}[{i}], ',', '') AS BIGINT)"
    return f"CAST(CASE WHEN len({found}) >= 2 THEN ({num(1)} + {num(2)}) // 2 ELSE {num(1)} END AS INT)"


def phone(c: str) -> str:
    d = f"regexp_replace({c}, '\\D', '', 'g')"
    d = f"CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END"
    return (f"CASE WHEN {c} = '' THEN NULL WHEN length({d}) = 10 THEN '(' || substr({d}, 1, 3) || ') ' || "
            f"substr({d}, 4, 3) || '-' || substr({d}, 7) ELSE trim({c}) END")


RAW_FIELDS = list(fv.HEADER_ALIASES)
FIELDS = ["name", "name_key", "domain", "city", "state", "industry", "employees", "revenue_estimate",
          "owner_name", "email", "phone"]  # phone last: the SQL below relies on it


def norm_sql(src: str) -> str:
    cleaned = ", ".join(f"{clean(f)} AS {f}" for f in RAW_FIELDS)
    return f"""
SELECT *, coalesce(domain, name_key || '|' || lower(coalesce(city, ''))) AS key FROM (
  SELECT ord, name, {name_key('name')} AS name_key,
    coalesce({domain('website')}, CASE WHEN {domain('em')} NOT IN {in_list(fv.FREE_MAIL_HOSTS)} THEN {domain('em')} END)
      AS domain,
    city, state, industry, {employees('employees')} AS employees, revenue_estimate, owner_name, em AS email, phone
  FROM (SELECT *, lower(email) AS em FROM (SELECT ord, {cleaned} FROM {src})) WHERE name IS NOT NULL)"""


def merged_sql(src: str, key: str = "key", extra: str = "") -> str:
    parts = []
    for f in FIELDS:
        missing = f"{f} IS NULL OR {f} = " + ("0" if f == "employees" else "''")
        e = f"arg_min({f}, ord) FILTER (WHERE NOT ({missing}))"
        if f == "name_key":
            e = f"coalesce({e}, '')"
        if f == "employees":
            e = f"coalesce({e}, arg_min_null({f}, ord))"
        parts.append(f"{e} AS {f}")
    return f"SELECT {key}, min(ord) AS ord, {', '.join(parts)} FROM {src} {extra} GROUP BY {key}"


# ---- text ------------------------------------------------------------------------
_A = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(
    rf"{t}\b{_A}>.*?(?:</{t}\b[^>]*>|\z)" for t in ["script", "style", "noscript", "svg", "template", "rt", "rp"]
) + ")"
_TAG = rf"(?s)<[a-zA-Z/!?]{_A}>|<[a-zA-Z/!?][^>]*>"
# every reference that occurs in the data; &amp; last
_ENTITIES = {"&#8217;": "’"} | {
    f"&{n};": chr(name2codepoint[n]) for n in ["middot", "copy", "quot", "lt", "gt", "nbsp", "ldquo", "rdquo", "mdash"]
}


def entities(c: str) -> str:
    for ref, char in _ENTITIES.items():
        c = f"replace({c}, {q(ref)}, {q(char)})"
    return f"replace({c}, '&amp;', '&')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace(replace({c}, chr(160), ' '), '\\s+', ' ', 'g'))"


def html_text(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, {q(_HIDDEN)}, ' ', 'g'), {q(_TAG)}, ' ', 'g')"
    return collapse(entities(bare))


def html_title(c: str) -> str:
    return f"nullif(trim({entities(f'''regexp_extract({c}, '(?is)<title[^>]*>(.*?)</title>', 1)''')}), '')"


def attr(tag: str, name: str) -> str:
    pat = rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return f"""trim(regexp_extract({tag}, {q(pat)}, 1), '"''')"""


META = rf"(?is)<meta\b{_A}>"
ANCHOR = rf"(?is)<a(\s{_A})>(.*?)(?:</a\s*>|\z)"


def first_meta(html: str, name: str, value: str) -> str:
    test = attr("x", name)
    return f"list_filter(regexp_extract_all({html}, {q(META)}), lambda x: {test} = {q(value)})[1]"


def site_host(url: str) -> str:
    return (f"nullif(regexp_replace(regexp_extract(lower({url}), '^https?://(?:[^/?#]*@)?([^/?#:@]*)', 1), "
            f"'^www\\.', ''), '')")


def path_of(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def url_key(url: str) -> str:
    path = f"regexp_replace({path_of(url)}, '/+$', '')"
    return (f"{site_host(url)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
            f"regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1)")


def resolve(href: str, base: str) -> str:
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    bare = f"split_part({href}, '#', 1)"
    folder = f"coalesce(nullif(regexp_replace({path_of(base)}, '[^/]*$', ''), ''), '/')"
    return (f"CASE WHEN {bare} = '' THEN split_part({base}, '#', 1) "
            f"WHEN regexp_matches({bare}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {bare} "
            f"WHEN starts_with({bare}, '//') THEN split_part({base}, '//', 1) || {bare} "
            f"WHEN starts_with({bare}, '/') THEN {origin} || {bare} "
            f"WHEN starts_with({bare}, '?') THEN {origin} || {path_of(base)} || {bare} "
            f"ELSE {origin} || {folder} || {bare} END")


def anchors_sql(src: str, html: str, base: str, dom: str, keep: str) -> str:
    """One row per link with a target: pos, href, url, path, hay, inside."""
    return f"""
SELECT {keep}, pos, href, url, path, hay,
  coalesce({site_host('url')} = dom_ AND path NOT IN ('', '/'), FALSE) AS inside FROM (
  SELECT *, {path_of('url')} AS path, {path_of('url')} || ' ' || {html_text('inner_')} AS hay FROM (
    SELECT *, {resolve('href', 'base_')} AS url FROM (
      SELECT *, trim({entities(attr('a_', 'href'))}) AS href FROM (
        SELECT {keep}, {base} AS base_, {dom} AS dom_,
          unnest(regexp_extract_all({html}, {q(ANCHOR)}, 1)) AS a_, unnest(regexp_extract_all({html}, {q(ANCHOR)}, 2))
          AS inner_, generate_subscripts(regexp_extract_all({html}, {q(ANCHOR)}, 1), 1) AS pos
        FROM {src})
      WHERE regexp_matches(a_, '(?i)[\\s"'']href\\s*='))))"""


def snippet(text: str, s: str, e: str) -> str:
    """Quote around [s, e); all three are plain column names."""
    s0, e0, n = f"greatest(0, {s} - 70)", f"least(length({text}), {e} + 70)", f"length({text})"
    lead = f"strpos(substr({text}, {s0} + 1, {s} - {s0}), ' ')"
    back = f"strpos(reverse(substr({text}, {e} + 1, {e0} - {e})), ' ')"
    a = f"(CASE WHEN {s0} > 0 AND {lead} > 0 THEN {s0} + {lead} ELSE {s0} END)"
    b = f"(CASE WHEN {e0} < {n} AND {back} > 0 AND {e0} - {back} > {e} THEN {e0} - {back} ELSE {e0} END)"
    return (f"CASE WHEN {a} > 0 THEN '…' ELSE '' END || trim(substr({text}, {a} + 1, {b} - {a})) || "
            f"CASE WHEN {b} < {n} THEN '…' ELSE '' END")


def blocked(status: str, html: str) -> str:
    return (f"coalesce(({status} IN (401, 403, 429) AND regexp_matches({html}, '(?i){fv.BLOCK_BODY}')) OR "
            f"regexp_matches(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1), '(?i){fv.BLOCK_TITLES}'), FALSE)")


def first_brand(c: str) -> str:
    return f"list_filter({lst(fv.FRANCHISE_BRANDS)}, lambda b: contains(lower({c}), b))[1]"


def all_matches_sql(src: str, pattern: str, fam: int, cols: str = "page_id") -> str:
    """One row per match of the pattern in `text`: fam, pos, grp (group 1), s, e."""
    ms, gs = f"regexp_extract_all(text, {q(pattern)}, 0)", f"regexp_extract_all(text, {q(pattern)}, 1)"
    ps = f"regexp_split_to_array(text, {q(pattern)})"
    return f"""
SELECT {cols}, {fam} AS fam, pos, gs[pos] AS grp, s, s + length(ms[pos]) AS e FROM (
  SELECT *, CAST(list_sum(list_transform(ps[1:pos], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:pos - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
    SELECT {cols}, {ms} AS ms, {gs} AS gs, {ps} AS ps, unnest(range(1, len({ms}) + 1)) AS pos FROM {src}))"""


def email_list(html: str) -> str:
    host = "substr(x, strpos(x, '@') + 1)"
    bad = " OR ".join(f"x LIKE '%{s}'" for s in fv.EMAIL_IMAGE_SUFFIXES)
    return (f"list_filter(list_transform(regexp_extract_all({html}, {q(fv.EMAIL_PATTERN)}), "
            f"lambda m: trim(lower(m), '.')), lambda x: NOT ({bad} OR {host} IN {in_list(fv.EMAIL_IGNORED_HOSTS)}))")


def phone_list(text: str) -> str:
    return (f"list_transform(regexp_extract_all({text}, {q(fv.PHONE_PATTERN)}), lambda m: regexp_replace("
            f"regexp_replace(m, '\\D', '', 'g'), '^1?(\\d{{3}})(\\d{{3}})(\\d{{4}})$', '(\\1) \\2-\\3'))")


def distinct_in_order(src: str, key: str, lists: str, order: str, keep: int) -> str:
    """key, items: first `keep` distinct items over all lists of a key, in order, joined by ', '."""
    return f"""
SELECT {key}, string_agg(item, ', ' ORDER BY rn) AS items, count(*) AS n FROM (
  SELECT {key}, item, row_number() OVER (PARTITION BY {key} ORDER BY ord_, pos_) AS rn FROM (
    SELECT {key}, item, ord_, pos_, row_number() OVER (PARTITION BY {key}, item ORDER BY ord_, pos_) AS seen FROM (
      SELECT {key}, {order} AS ord_, unnest({lists}) AS item, generate_subscripts({lists}, 1) AS pos_ FROM {src}))
  WHERE seen = 1) WHERE rn <= {keep} GROUP BY {key}"""


CTES: dict[str, str] = {}
_GIVEN = ["region", "nation", "customer", "orders", "events", "documents", "pages", "conversations", "labels"]


def _derived(text: str, **names: str) -> str:
    return dv.render(text, "oracle", {**{t: t for t in _GIVEN}, **names})


CTES["leads_raw"] = _derived(dv.LEADS_RAW)
CTES["raw_before"] = f"SELECT * FROM leads_raw WHERE o_orderdate < TIMESTAMP '{dv.BATCH_CUT} 00:00:00'"
CTES["raw_after"] = f"SELECT * FROM leads_raw WHERE o_orderdate >= TIMESTAMP '{dv.BATCH_CUT} 00:00:00'"
for _n, _src in {"all": "leads_raw", "before": "raw_before", "after": "raw_after"}.items():
    CTES[f"norm_{_n}"] = norm_sql(_src)
    CTES[f"merged_{_n}"] = merged_sql(f"norm_{_n}")
CTES["site_raw"] = _derived(dv.SITE_PAGES)
CTES["fetch_raw"] = _derived(dv.PAGE_FETCHES, site_pages="site_raw")
CTES["mx_hosts"] = _derived(dv.MX_HOSTS)
CTES["lead_edits"] = _derived(dv.LEAD_EDITS)
CTES["brand_table"] = _derived(dv.BRAND_TABLE)


def stored_sql(src: str) -> str:
    rest = ", ".join(f for f in FIELDS if f != "phone")
    return (f"SELECT md5('b1|1|' || key) AS lead_key, '000000000001:' || lpad(CAST(ord AS STRING), 20, '0') AS seq, "
            f"{rest}, {phone('phone')} AS phone, 'b1' AS batch_id FROM {src}")


CTES["stored_before"] = stored_sql("merged_before")
CTES["stored_all"] = stored_sql("merged_all")


def _fill(f: str) -> str:
    blank = "0" if f == "employees" else "''"
    return (f"CASE WHEN (s.{f} IS NULL OR s.{f} = {blank}) AND f.{f} IS NOT NULL AND f.{f} <> {blank} "
            f"THEN f.{f} ELSE s.{f} END AS {f}")


def upsert_ctes(prefix: str, stored: str, incoming: str, batch: int) -> None:
    """CTEs <prefix>_matched, _fills, _upserted of one batch against the stored leads."""
    CTES[f"{prefix}_matched"] = f"""
SELECT i.*, coalesce(a.lead_key, b.lead_key) AS matched_key FROM {incoming} i
LEFT JOIN {stored} a ON i.domain = a.domain
LEFT JOIN (SELECT name_key, city, arg_min(lead_key, seq) AS lead_key FROM {stored} GROUP BY name_key, city) b
  ON i.name_key = b.name_key AND i.city IS NOT DISTINCT FROM b.city"""
    CTES[f"{prefix}_fills"] = merged_sql(f"{prefix}_matched", "matched_key", "WHERE matched_key IS NOT NULL")
    CTES[f"{prefix}_upserted"] = f"""
SELECT s.lead_key, s.seq, {', '.join(_fill(f) for f in FIELDS)}, s.batch_id
FROM {stored} s LEFT JOIN {prefix}_fills f ON s.lead_key = f.matched_key
UNION ALL
SELECT md5('b{batch}|{batch}|' || key) AS lead_key, '{batch:012d}:' || lpad(CAST(ord AS STRING), 20, '0') AS seq,
  {', '.join(f for f in FIELDS if f != 'phone')}, {phone('phone')} AS phone, 'b{batch}' AS batch_id
FROM {prefix}_matched WHERE matched_key IS NULL"""


upsert_ctes("second", "stored_before", "merged_after", 2)
CTES["matched"] = "SELECT * FROM second_matched"
CTES["upserted"] = f"SELECT lead_key, seq, {', '.join(FIELDS)}, batch_id FROM second_upserted"

# ---- pages of sites ------------------------------------------------------------------
CTES["page_text"] = f"SELECT page_id, domain, kind, url, html, {html_text('html')} AS text FROM site_raw"
CTES["fetch_clean"] = f"""
SELECT *, status BETWEEN 200 AND 299 AND NOT blocked AND length(html) > 0 AS ok FROM (
  SELECT * EXCLUDE (html), h AS html, {blocked('status', 'h')} AS blocked FROM (
    SELECT *, CASE WHEN coalesce(content_type, '') = '' OR contains(content_type, 'html')
      THEN html ELSE '' END AS h FROM fetch_raw))"""
CTES["homes"] = f"""
SELECT * FROM (
  SELECT *, {site_host('url')} AS dom, row_number() OVER (PARTITION BY {site_host('url')} ORDER BY
    CASE WHEN (ok OR blocked) AND starts_with(url, 'https://') THEN 0 WHEN ok OR blocked THEN 1
      WHEN NOT starts_with(url, 'https://') THEN 2 ELSE 3 END, url) AS rn
  FROM fetch_clean WHERE {url_key('url')} = {site_host('url')} || '/') WHERE rn = 1"""
CTES["site_state"] = f"""
SELECT dom AS domain, ok AS reachable, blocked, CASE WHEN ok THEN NULL WHEN blocked THEN {q(fv.BLOCKED_SITE_ERROR)}
  ELSE coalesce(error, 'HTTP ' || CAST(status AS STRING)) END AS error,
  CASE WHEN ok THEN starts_with(final_url, 'https://') END AS https FROM homes"""
CTES["home_anchors"] = anchors_sql("(SELECT * FROM homes WHERE ok)", "html", "final_url", "dom", "dom")


def kinds_sql(src: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {q(k)} AS kind, arg_min(url, pos) AS url FROM {src} WHERE inside AND "
        f"regexp_matches(hay, {q('(?i)' + p)}) GROUP BY {key}" for k, p in fv.LINK_PATTERNS.items())


CTES["site_links"] = kinds_sql("home_anchors", "dom")
CTES["crawled"] = f"""
SELECT dom AS domain, 'home' AS kind, final_url AS url, page_id, html FROM homes WHERE ok
UNION ALL
SELECT l.dom, l.kind, coalesce(nullif(f.final_url, ''), l.url), f.page_id, f.html FROM site_links l
JOIN (SELECT *, {url_key('url')} AS k FROM fetch_clean WHERE ok) f ON {url_key('l.url')} = f.k"""
_RANK = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {i}" for i, k in enumerate(fv.PAGE_KINDS)) + " ELSE 99 END"


def findings(prefix: str, src: str) -> None:
    """CTEs <prefix>_page, _hits, _quotes for pages (domain, kind, page_id, html)."""
    CTES[f"{prefix}_page"] = f"""
SELECT domain, kind, {_RANK} AS ord, html, lower(html) AS low, {html_text('html')} AS text,
  domain || '/' || kind AS page_id FROM {src}"""
    key_patterns = {**fv.KEYWORD_PATTERNS, "recurring_revenue": fv.RECURRING_PATTERN}
    page = f"{prefix}_page"
    simple = " UNION ALL ".join(
        f"SELECT domain, kind, ord, text, {q(k)} AS key, NULL AS val, "
        f"length(regexp_extract(text, {q(f'(?is)^(.*?)(?:{p})')}, 1)) AS s, "
        f"length(regexp_extract(text, {q(f'(?is)^(.*?)(?:{p})')}, 1)) + length(regexp_extract(text, {q('(?i)' + p)})) AS e "
        f"FROM {page} WHERE regexp_matches(text, {q('(?i)' + p)})" for k, p in key_patterns.items())
    weak = fv.FRANCHISE_WEAK_PHRASES
    years1 = all_matches_sql(page, "(?i)" + fv.FOUNDED_PATTERN, 0, "domain, kind, ord, text")
    years2 = all_matches_sql(page, "(?i)" + fv.YEARS_PATTERN, 1, "domain, kind, ord, text")
    CTES[f"{prefix}_years"] = f"""
SELECT * FROM (
  SELECT *, CASE fam WHEN 0 THEN CAST(grp AS INT) ELSE {YEAR} - CAST(grp AS INT) END AS year
  FROM (SELECT * FROM ({years1}) UNION ALL SELECT * FROM ({years2})))
WHERE (fam = 0 AND year BETWEEN 1850 AND {YEAR}) OR (fam = 1 AND CAST(grp AS INT) BETWEEN 3 AND 150)"""
    own1 = all_matches_sql(page, fv.OWNER_NAME_FIRST, 0, "domain, kind, ord, text")
    own2 = all_matches_sql(page, fv.OWNER_ROLE_FIRST, 1, "domain, kind, ord, text")
    CTES[f"{prefix}_owners"] = f"""
SELECT * FROM (SELECT * FROM ({own1}) UNION ALL SELECT * FROM ({own2}))
WHERE split_part(grp, ' ', 1) NOT IN {in_list(fv.NOT_A_FIRST_NAME)}"""
    CTES[f"{prefix}_hits"] = f"""
SELECT * FROM ({simple})
UNION ALL
SELECT domain, kind, ord, text, 'weak_franchise', NULL, length(regexp_extract(text, {q(f'(?is)^(.*?)(?:{weak})')}, 1)),
  length(regexp_extract(text, {q(f'(?is)^(.*?)(?:{weak})')}, 1)) + length(regexp_extract(text, {q('(?i)' + weak)}))
FROM {page} WHERE regexp_matches(text, {q('(?i)' + weak)}) AND
  (regexp_matches(text, {q('(?i)' + fv.FRANCHISE_WORDS)}) OR {first_brand('text')} IS NOT NULL)
UNION ALL
SELECT domain, kind, ord, text, 'founded_year', CAST(year AS STRING), s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY year, fam, pos) AS rn FROM {prefix}_years) WHERE rn = 1
UNION ALL
SELECT domain, kind, ord, text, 'owner_name', grp, s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, kind ORDER BY fam, pos) AS rn FROM {prefix}_owners) WHERE rn = 1"""
    CTES[f"{prefix}_quotes"] = f"SELECT domain, kind, ord, key, val, {snippet('text', 's', 'e')} AS quote FROM {prefix}_hits"
    CTES[f"{prefix}_first"] = f"""
SELECT domain, key, kind AS page, val, quote FROM (
  SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY
    CASE WHEN key = 'founded_year' THEN CAST(val AS INT) ELSE 0 END, ord) AS rn FROM {prefix}_quotes) WHERE rn = 1"""
    terms = f"list_transform(regexp_extract_all(text, {q('(?i)' + fv.RECURRING_PATTERN)}), lambda t: lower(t))"
    CTES[f"{prefix}_terms"] = distinct_in_order(page, "domain", terms, "ord", 6)
    CTES[f"{prefix}_emails"] = distinct_in_order(page, "domain", email_list("html"), "ord", 8)
    CTES[f"{prefix}_phones"] = distinct_in_order(page, "domain", phone_list("text"), "ord", 4)
    counts = ", ".join(
        f"sum(len(regexp_extract_all(lower(text), {q(p)}))) AS i{i}" for i, p in enumerate(fv.INDUSTRY_PATTERNS.values()))
    cells = ", ".join(f"i{i}" for i in range(len(fv.INDUSTRY_PATTERNS)))
    CTES[f"{prefix}_industry"] = f"""
SELECT domain, CASE WHEN list_max(h) >= 2 THEN {lst(fv.INDUSTRY_PATTERNS)}[list_position(h, list_max(h))] END AS guess
FROM (SELECT domain, [{cells}] AS h FROM (SELECT domain, {counts} FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM {page}) WHERE rn <= 3 GROUP BY domain))"""
    cms = " ".join(f"WHEN contains(low, {q(m)}) THEN {i}" for i, m in enumerate(fv.CMS_MARKERS.values()))
    flags = ", ".join(f"bool_or(regexp_matches(low, {q(p)})) AS {t}" for t, p in fv.TECH_PATTERNS.items())
    CTES[f"{prefix}_tech"] = f"""
SELECT domain, {lst(fv.CMS_MARKERS)}[min(CASE {cms} END) + 1] AS cms, {flags},
  max(list_max(list_filter(list_transform(regexp_extract_all(html, {q('(?i)' + fv.COPYRIGHT_PATTERN)}, 1),
    lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1995 AND {YEAR}))) AS copyright_year,
  arg_min(CAST(nullif(regexp_extract(text, {q('(?i)' + fv.HEADCOUNT_PATTERN)}, 1), '') AS INT), ord)
    FILTER (WHERE regexp_matches(text, {q('(?i)' + fv.HEADCOUNT_PATTERN)})) AS hint,
  string_agg(kind, ', ' ORDER BY kind) AS kinds
FROM {page} GROUP BY domain"""
    meta = f"coalesce({first_meta('html', 'name', 'description')}, {first_meta('html', 'property', 'og:description')})"
    CTES[f"{prefix}_home"] = f"""
SELECT domain, {html_title('html')} AS title, {first_brand(html_title('html'))} AS title_brand,
  {first_meta('html', 'name', 'viewport')} IS NOT NULL AS mobile,
  substr(trim(coalesce(nullif({entities(attr(meta, 'content'))}, ''), substr(text, 1, 220))), 1, 300) AS description
FROM {page} WHERE kind = 'home'"""


findings("crawled", "crawled")


def _ev(key: str, col: str) -> str:
    return f"(SELECT {col} FROM crawled_first f WHERE f.domain = s.domain AND f.key = {q(key)})"


CTES["franchise_quote"] = """
SELECT domain, page, quote FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pri) AS rn FROM (
    SELECT domain, 0 AS pri, 'home' AS page,
      'Page title “' || substr(title, 1, 120) || '” matches the national franchise brand “' || title_brand || '”.' AS quote
    FROM crawled_home WHERE title_brand IS NOT NULL
    UNION ALL SELECT domain, 1, page, quote FROM crawled_first WHERE key = 'franchise'
    UNION ALL SELECT domain, 2, page, quote FROM crawled_first WHERE key = 'weak_franchise')) WHERE rn = 1"""
CTES["site_evidence"] = """
SELECT domain, key, page, quote FROM crawled_first WHERE key NOT IN ('franchise', 'weak_franchise')
UNION ALL SELECT domain, 'franchise', page, quote FROM franchise_quote"""
CTES["evidence_flags"] = """
SELECT domain, bool_or(key = 'succession') AS succession, bool_or(key = 'family_owned') AS family_owned,
  bool_or(key = 'hiring') AS hiring, bool_or(key = 'pe_backed') AS pe_backed, bool_or(key = 'testimonials') AS testimonials,
  bool_or(key = 'franchise') AS franchise,
  max(CASE WHEN key = 'founded_year' THEN CAST(val AS INT) END) AS founded_year,
  max(CASE WHEN key = 'owner_name' THEN val END) AS owner_name
FROM (SELECT domain, key, val FROM crawled_first WHERE key NOT IN ('franchise', 'weak_franchise')
      UNION ALL SELECT domain, 'franchise', NULL FROM franchise_quote) GROUP BY domain"""
_T = "coalesce(t.{0}, FALSE)"
CTES["signals"] = f"""
SELECT *, 15 * CAST(https AS INT) + 20 * CAST(mobile_friendly AS INT)
    + CASE WHEN copyright_year >= {YEAR - 1} THEN 20 ELSE 0 END + 15 * CAST(online_booking AS INT)
    + 10 * CAST(live_chat AS INT) + 10 * CAST(analytics AS INT) + 10 * CAST(marketing_automation AS INT) AS digital_maturity
FROM (
SELECT s.domain, s.reachable, s.blocked, s.error AS crawl_error, coalesce(t.kinds, '') AS pages_crawled,
  CASE WHEN s.reachable THEN coalesce(e.franchise, FALSE) END AS franchise, e.founded_year,
  {YEAR} - e.founded_year AS years_in_business, t.copyright_year, e.owner_name AS site_owner,
  CASE WHEN s.reachable THEN coalesce(e.succession, FALSE) END AS succession,
  CASE WHEN s.reachable THEN coalesce(e.family_owned, FALSE) END AS family_owned,
  CASE WHEN s.reachable THEN coalesce(e.hiring, FALSE) END AS hiring,
  CASE WHEN s.reachable THEN coalesce(e.pe_backed, FALSE) END AS pe_backed,
  CASE WHEN s.reachable THEN coalesce(e.testimonials, FALSE) END AS testimonials,
  CASE WHEN s.reachable THEN coalesce(r.items, '') END AS recurring_terms,
  CASE WHEN s.reachable THEN coalesce(r.n, 0) END AS n_terms, t.hint AS employees_hint,
  CASE WHEN s.reachable THEN coalesce(m.items, '') END AS emails,
  CASE WHEN s.reachable THEN coalesce(p.items, '') END AS phones,
  t.cms, CASE WHEN s.reachable THEN coalesce(s.https, FALSE) END AS https,
  CASE WHEN s.reachable THEN coalesce(h.mobile, FALSE) END AS mobile_friendly,
  {', '.join(f"CASE WHEN s.reachable THEN coalesce(t.{t}, FALSE) END AS {t}" for t in fv.TECH_PATTERNS)},
  h.description, i.guess AS industry_guess
FROM site_state s LEFT JOIN crawled_tech t ON s.domain = t.domain LEFT JOIN evidence_flags e ON s.domain = e.domain
LEFT JOIN crawled_terms r ON s.domain = r.domain LEFT JOIN crawled_emails m ON s.domain = m.domain
LEFT JOIN crawled_phones p ON s.domain = p.domain LEFT JOIN crawled_home h ON s.domain = h.domain
LEFT JOIN crawled_industry i ON s.domain = i.domain)"""

# ---- leads with signals, contacts, scores ------------------------------------------------
_NAME_BRAND = first_brand("name")
CTES["lead_signals"] = f"""
SELECT l.*, g.* EXCLUDE (domain, reachable, blocked, crawl_error, pages_crawled, franchise),
  coalesce(g.reachable, FALSE) AS reachable, coalesce(g.blocked, FALSE) AS blocked,
  CASE WHEN g.domain IS NOT NULL THEN g.crawl_error WHEN l.domain IS NULL THEN {q(fv.NO_WEBSITE_ERROR)}
    ELSE {q(fv.NO_FETCH_ERROR)} END AS crawl_error,
  coalesce(g.pages_crawled, '') AS pages_crawled,
  CASE WHEN {_NAME_BRAND} IS NOT NULL THEN TRUE ELSE g.franchise END AS franchise
FROM stored_all l LEFT JOIN signals g ON l.domain = g.domain"""


def host_of(email: str) -> str:
    return f"substr({email}, strpos({email}, '@') + 1)"


def rank_email(e: str, owner: str, dom: str) -> str:
    local = f"split_part({e}, '@', 1)"
    first = f"lower(split_part(coalesce({owner}, ''), ' ', 1))"
    on = f"coalesce(ends_with({host_of(e)}, {dom}), FALSE)"
    return (f"CASE WHEN {first} <> '' AND contains({local}, {first}) THEN 0 WHEN {on} AND {local} NOT IN "
            f"{in_list(fv.ROLE_LOCAL_PARTS)} THEN 1 WHEN {on} THEN 2 ELSE 3 END")


def classify(email: str, mx: str) -> str:
    return (f"CASE WHEN {email} IS NULL THEN NULL WHEN NOT regexp_matches({email}, {q(fv.EMAIL_SYNTAX)}) THEN 'invalid' "
            f"WHEN NOT {mx} THEN 'invalid' WHEN split_part({email}, '@', 1) IN {in_list(fv.ROLE_LOCAL_PARTS)} THEN 'role' "
            f"WHEN {host_of(email)} IN {in_list(fv.FREE_MAIL_HOSTS)} THEN 'personal_domain' "
            f"WHEN {mx} IS NULL THEN 'unverified' ELSE 'valid' END")


CTES["site_best_email"] = f"""
SELECT lead_key, arg_min(e, rnk * 100 + pos) AS best FROM (
  SELECT lead_key, e, pos, {rank_email('e', 'coalesce(owner_name, site_owner)', 'domain')} AS rnk FROM (
    SELECT lead_key, owner_name, site_owner, domain, unnest(string_split(emails, ', ')) AS e,
      generate_subscripts(string_split(emails, ', '), 1) AS pos FROM lead_signals WHERE emails <> '')) GROUP BY lead_key"""
CTES["lead_contacts"] = f"""
SELECT l.* EXCLUDE (email, phone), coalesce(l.email, b.best) AS email,
  {phone("coalesce(l.phone, nullif(split_part(l.phones, ', ', 1), ''))")} AS phone
FROM lead_signals l LEFT JOIN site_best_email b ON l.lead_key = b.lead_key"""
CTES["enriched"] = f"""
SELECT c.*, {classify('c.email', 'm.has_mx')} AS email_status,
  CASE WHEN reachable THEN 'enriched' ELSE 'failed' END AS status, 'new' AS stage
FROM lead_contacts c LEFT JOIN mx_hosts m ON {host_of('c.email')} = m.host"""


def parts_sql(src: str, icp: dict | None = None, cols: dict[str, str] | None = None) -> str:
    """Adds r_<key>, why_<key>, known_<key> for the seven components; buy box fixed or from columns."""
    d = {**fv.DEFAULT_ICP, **(icp or {})}
    cols = cols or {
        "targets": lst(d["target_industries"]), "lo": str(d["employees_min"]), "hi": str(d["employees_max"]),
        "min_years": str(d["min_years"]),
    }
    lo, hi, my, targets = cols["lo"], cols["hi"], cols["min_years"], cols["targets"]
    yrs, emp, ind = "years_in_business", "coalesce(nullif(employees, 0), employees_hint)", "coalesce(industry, industry_guess)"
    own = "coalesce(owner_name, site_owner)"
    t = lambda *p: " || ".join(x if x.startswith("'") else f"CAST({x} AS STRING)" for x in p)
    up = "greatest(0.1::DOUBLE, least(1.0::DOUBLE, (100 - coalesce(digital_maturity, 50)) / 70::DOUBLE))"
    gaps = (f"list_filter([CASE WHEN copyright_year <= {YEAR - 3} THEN 'site last updated around ' || "
            f"CAST(copyright_year AS STRING) END, CASE WHEN NOT coalesce(online_booking, FALSE) THEN 'no online booking' END, "
            f"CASE WHEN NOT coalesce(mobile_friendly, FALSE) THEN 'not mobile friendly' END, "
            f"CASE WHEN NOT coalesce(https, FALSE) THEN 'no HTTPS' END], lambda x: x IS NOT NULL)")
    hit = f"len(list_filter({targets}, lambda x: contains(lower({ind}), lower(x)) OR contains(lower(x), lower({ind})))) > 0"
    direct, general = "coalesce(email_status IN ('valid', 'personal_domain'), FALSE)", \
        "coalesce(email_status IN ('role', 'unverified'), FALSE)"
    ph = "(phone IS NOT NULL OR coalesce(phones, '') <> '')"
    have = (f"concat_ws(', ', CASE WHEN {direct} THEN 'direct email' WHEN {general} THEN 'general inbox' END, "
            f"CASE WHEN {ph} THEN 'phone' END, CASE WHEN {own} IS NOT NULL THEN 'owner name' END)")
    dash = "'–'"
    rules = {
        "maturity": [
            (f"{yrs} IS NULL", "0.3", "'Founding year not found on the website'", "FALSE"),
            (f"{yrs} >= 2 * {my}", "1.0", t("'In business about '", yrs, "' years'"), "TRUE"),
            (f"{yrs} >= {my}", "0.75", t("'In business about '", yrs, "' years'"), "TRUE"),
            (f"{yrs} >= {my} / 2", "0.4", t("'Only about '", yrs, "' years old'"), "TRUE"),
            (None, "0.1", t("'Young business (about '", yrs, "' years)'"), "TRUE")],
        "size": [
            (f"{emp} IS NULL", "0.35", "'Headcount unknown'", "FALSE"),
            (f"{emp} BETWEEN {lo} AND {hi}", "1.0",
             t("'About '", emp, "' employees, inside your '", lo, dash, hi, "' range'"), "TRUE"),
            (f"{emp} BETWEEN {lo} * 0.5 AND {hi} * 1.5", "0.5",
             t("'About '", emp, "' employees, just outside your '", lo, dash, hi, "' range'"), "TRUE"),
            (None, "0.0", t("'About '", emp, "' employees, outside your '", lo, dash, hi, "' range'"), "TRUE")],
        "industry": [
            (f"{ind} IS NULL", "0.35", "'Industry unknown'", "FALSE"),
            (hit, "1.0", t(ind, "' is a target industry'"), "TRUE"),
            (None, "0.15", t(ind, "' is not in your target list'"), "TRUE")],
        "recurring": [
            ("NOT reachable", "0.2", "'Website not reviewed'", "FALSE"),
            ("n_terms >= 2", "1.0", "'Recurring revenue offers: ' || "
             "array_to_string(string_split(recurring_terms, ', ')[1:3], ', ')", "TRUE"),
            ("n_terms = 1", "0.6", "'Mentions ' || recurring_terms", "TRUE"),
            (None, "0.0", "'No maintenance plans or contracts mentioned'", "TRUE")],
        "succession": [
            ("NOT reachable", "0.2", "'Website not reviewed'", "FALSE"),
            ("succession", "1.0", "'Website mentions retirement or succession'", "TRUE"),
            (f"family_owned AND coalesce({yrs}, 0) >= 25", "0.7",
             "'Long-running family business, likely thinking about the next generation'", "TRUE"),
            (f"site_owner IS NOT NULL AND coalesce({yrs}, 0) >= 20", "0.5", t("'Founder-led for '", yrs, "'+ years'"), "TRUE"),
            (f"coalesce({yrs}, 0) >= 30", "0.4", "'30+ years old, owner likely nearing transition age'", "TRUE"),
            (None, "0.0", "'No transition signals found'", "TRUE")],
        "upside": [
            ("NOT reachable", "0.0", "'Website not reviewed'", "FALSE"),
            (f"len({gaps}) > 0 AND {up} >= 0.5", up, f"'Room to modernize: ' || array_to_string({gaps}[1:3], ', ')", "TRUE"),
            (None, up, "'Already digitally mature'", "TRUE")],
        "reachability": [
            (None, f"least(1.0, CASE WHEN {direct} THEN 0.5::DOUBLE WHEN {general} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + "
                   f"CASE WHEN {ph} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + "
                   f"CASE WHEN {own} IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)",
             f"CASE WHEN {have} <> '' THEN 'Have ' || {have} ELSE 'No contact details found' END", "TRUE")],
    }

    def case(key: str, i: int, cast: str) -> str:
        arms = "".join(f"WHEN {r[0]} THEN {r[i]} " for r in rules[key] if r[0])
        last = rules[key][-1][i]
        return f"CAST({f'CASE {arms} ELSE {last} END' if arms else last} AS {cast})"

    cells = ", ".join(f"{case(k, 1, 'DOUBLE')} AS r_{k}, {case(k, 2, 'STRING')} AS why_{k}, "
                      f"{case(k, 3, 'BOOLEAN')} AS known_{k}" for k in rules)
    return f"SELECT *, {cells} FROM {src}"


KEYS = list(fv.COMPONENT_LABELS)


def score_sql(src: str, weights: dict[str, str] | None = None, total: str | None = None) -> str:
    """From parts: p_<key>, m_<key>, score, confidence, tier, flags (texts joined by ' | ')."""
    w = weights or {k: str(v) for k, v in fv.DEFAULT_ICP["weights"].items()}
    total = total or str(sum(fv.DEFAULT_ICP["weights"].values()))
    cells = ", ".join(
        f"round_even(r_{k} * {w[k]} * 100 / {total}, 1) AS p_{k}, round_even({w[k]} * 100 / {total}::DOUBLE, 1) AS m_{k}"
        for k in KEYS)
    raw = "(" + " + ".join(f"r_{k} * {w[k]}" for k in KEYS) + f") * 100 / {total}"
    score = (f"CAST(round_even(greatest(0.0, least(100.0, {raw} - CASE WHEN pe_backed THEN 25 ELSE 0 END "
             f"- CASE WHEN franchise THEN 15 ELSE 0 END)), 0) AS INT)")
    known = " + ".join(f"CAST(known_{k} AS INT)" for k in KEYS)
    flags = (
        "list_filter([CASE WHEN pe_backed THEN 'risk:Appears to already be owned by an investor or parent company' END, "
        "CASE WHEN franchise THEN 'risk:Franchise location, usually needs franchisor approval to sell' END, "
        "CASE WHEN blocked THEN 'watch:Website shows a bot check. Review it manually.' "
        "WHEN NOT reachable AND domain IS NOT NULL THEN 'watch:Website unreachable (' || coalesce(crawl_error, 'no response') || ')' END, "
        "CASE WHEN domain IS NULL THEN 'watch:No website on record' END, "
        "CASE WHEN email_status = 'invalid' THEN 'watch:Email address looks invalid' END, "
        "CASE WHEN hiring THEN 'good:Currently hiring, a sign of demand' END], lambda x: x IS NOT NULL)")
    return f"""
SELECT *, CASE WHEN score >= 72 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 38 THEN 'C' ELSE 'D' END AS tier FROM (
  SELECT *, {cells}, {raw} AS raw_score, {score} AS score,
    CAST(round_even(({known}) / 7::DOUBLE * 100, 0) AS INT) AS confidence, {flags} AS flags FROM {src})"""


CTES["scored_parts"] = parts_sql("enriched")
CTES["scored"] = score_sql("scored_parts")
# the table right after import: no signals yet
CTES["fresh"] = (
    "SELECT l.*, FALSE AS reachable, FALSE AS blocked, NULL::STRING AS crawl_error, NULL::BOOLEAN AS franchise, "
    "NULL::INT AS founded_year, NULL::INT AS years_in_business, NULL::INT AS copyright_year, NULL::STRING AS site_owner, "
    "NULL::BOOLEAN AS succession, NULL::BOOLEAN AS family_owned, NULL::BOOLEAN AS hiring, NULL::BOOLEAN AS pe_backed, "
    "NULL::STRING AS recurring_terms, 0 AS n_terms, NULL::INT AS employees_hint, NULL::STRING AS phones, "
    "NULL::BOOLEAN AS https, NULL::BOOLEAN AS mobile_friendly, NULL::BOOLEAN AS online_booking, "
    "NULL::INT AS digital_maturity, NULL::STRING AS industry_guess, NULL::STRING AS email_status, "
    "'pending' AS status, 'new' AS stage FROM stored_all l")
CTES["fresh_parts"] = parts_sql("fresh")
CTES["fresh_scored"] = score_sql("fresh_parts")
CTES["reasons"] = " UNION ALL ".join(
    f"SELECT lead_key, {i} AS i, {q(k)} AS key, {q(fv.COMPONENT_LABELS[k])} AS label, p_{k} AS points, m_{k} AS max, "
    f"round_even(r_{k}, 2) AS ratio, why_{k} AS reason, known_{k} AS known FROM scored" for i, k in enumerate(KEYS))
CTES["top_reasons"] = """
SELECT lead_key, string_agg(reason, '; ' ORDER BY rn) AS why FROM (
  SELECT *, row_number() OVER (PARTITION BY lead_key ORDER BY points DESC, i) AS rn FROM reasons) WHERE rn <= 3
GROUP BY lead_key"""
# the working table of most queries: enriched leads with the edits of the event log applied
CTES["edit_heads"] = """
SELECT lead_no, arg_max(stage, edited_at) FILTER (WHERE stage IS NOT NULL) AS stage,
  arg_max(notes, edited_at) FILTER (WHERE notes IS NOT NULL) AS notes FROM lead_edits GROUP BY lead_no"""

_NAMES = None


def with_ctes(body: str) -> str:
    """Body with the common table expressions it needs, in order of dependency."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_]+", re.sub(r"'(?:[^']|'')*'", "''", sql))):
            if word in CTES and word not in order:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + "\n" + body
