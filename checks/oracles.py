"""SQL twins of the registered queries."""

from __future__ import annotations

from checks import derived as dv
from checks.ctes import (
    CTES, FIELDS, KEYS, RAW_FIELDS, anchors_sql, attr, blocked, classify, clean, distinct_in_order, domain,
    email_list, employees, entities, findings, first_brand, first_meta, host_of, html_text, html_title, in_list,
    kinds_sql, lst, name_key, parts_sql, path_of, phone, phone_list, q, rank_email, score_sql, site_host,
    upsert_ctes, with_ctes,
)
from leadfit import fixed_values as fv
from leadfit.operators import briefs as bf

findings("every", "site_raw")
CTES["worked"] = """
SELECT s.* EXCLUDE (stage), coalesce(e.stage, 'new') AS stage, e.notes FROM scored s
LEFT JOIN edit_heads e ON s.domain = 's' || CAST(e.lead_no AS STRING) || '.test'"""
CTES["page_anchors"] = anchors_sql("pages", "html", "url", site_host("url"), "page_id")
CTES["site_anchors"] = anchors_sql("site_raw", "html", "url", "domain", "page_id")

ORACLES: dict[str, str] = {}
O = ORACLES
FREE, ROLE = in_list(fv.FREE_MAIL_HOSTS), in_list(fv.ROLE_LOCAL_PARTS)
NOTES_MAX = 5000
_cleaned = ", ".join(f"{clean(f)} AS {f}" for f in RAW_FIELDS)
_KEPT = "lead_key, name, score, tier, stage"
BEST_IND, BEST_EMP = "coalesce(industry, industry_guess)", "coalesce(nullif(employees, 0), employees_hint)"
BEST_OWN = "coalesce(owner_name, site_owner)"
_TECH = ", ".join(fv.TECH_PATTERNS)

# ---- sources
O["scan_leads_csv"] = f"SELECT {_cleaned} FROM leads_raw"
O["scan_leads_split"] = O["scan_leads_csv"]
O["detect_delimiter"] = f"""SELECT {clean('city')} AS city, count(*) AS n, count({clean('website')}) AS sites, ';' AS sep
FROM leads_raw GROUP BY 1"""
O["scan_page_corpus"] = f"""SELECT url, 200 AS status, url AS final_url, length(html) AS chars,
{blocked('200', 'html')} AS blocked FROM pages"""
_p = f"CASE WHEN regexp_replace({path_of('u.url')}, '/+$', '') = '' THEN '/' ELSE regexp_replace({path_of('u.url')}, '/+$', '') END"
O["scan_recorded_sites"] = f"""
SELECT url, status, CASE WHEN status = 0 THEN '' WHEN html IS NULL THEN url
    ELSE 'https://' || host || CASE WHEN path = '/' THEN '' ELSE path END END AS final_url,
  length(coalesce(html, '')) AS chars, {blocked('status', "coalesce(html, '')")} AS blocked,
  CASE WHEN status = 0 THEN '{fv.UNRESOLVED_HOST_ERROR}' END AS error
FROM (SELECT u.url, u.host, u.path, p.html, CASE WHEN s.domain IS NULL THEN 0 WHEN p.html IS NULL THEN 404 ELSE s.code END AS status
  FROM (SELECT url, {site_host('u.url')} AS host, {_p} AS path FROM (
      SELECT url FROM site_raw UNION ALL SELECT url || 'x' FROM site_raw UNION ALL SELECT url FROM pages) u) u
  LEFT JOIN (SELECT domain, max(CASE WHEN kind = 'home' AND n % 13 = 5 THEN 403 ELSE 200 END) AS code
             FROM site_raw GROUP BY domain) s ON u.host = s.domain
  LEFT JOIN (SELECT domain, html, CASE kind WHEN 'home' THEN '/' ELSE '/' || kind END AS path FROM site_raw) p
    ON u.host = p.domain AND u.path = p.path)"""
O["read_params_table"] = """SELECT 5 AS employees_min, 150 AS employees_max, max(c_nationkey) AS min_years, 11 AS n_targets,
1 AS n_weights, min(c_nationkey) AS weight_upside FROM customer"""

# ---- projections
O["map_headers"] = f"SELECT ord, {_cleaned} FROM leads_raw"
_TAGS = ("coalesce(succession, FALSE) AS succession, coalesce(family_owned, FALSE) AS family_owned, "
         "coalesce(n_terms > 0, FALSE) AS recurring, coalesce(hiring, FALSE) AS hiring")
O["lead_view"] = f"""SELECT lead_key, seq, name, domain, {BEST_IND} AS industry, {BEST_EMP} AS employees, {BEST_OWN} AS owner_name,
email, email_status, phone, status, score, tier, confidence, stage, years_in_business, {_TAGS} FROM worked"""
O["lead_detail"] = f"""SELECT lead_key, name, {BEST_IND} AS industry, score, notes, crawl_error AS error,
'2026-09-16T12:00:00+00:00' AS enriched_at, reachable, blocked, franchise, founded_year, copyright_year, digital_maturity,
employees_hint, pages_crawled, emails, phones, recurring_terms, description, cms, https, mobile_friendly, {_TECH},
industry_guess FROM worked"""
_lab = lambda c, d, i: "CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {q(v[i])}" for k, v in d.items())
O["display_labels"] = f"""SELECT lead_key, CASE WHEN status = 'pending' THEN 'Not scored yet' WHEN confidence < 50 THEN
'Needs manual review' ELSE CASE tier {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.TIER_LABELS.items())} END END AS fit_label,
CASE WHEN pe_backed OR franchise THEN 'Risk' END AS risk_tag,
{_lab('email_status', fv.EMAIL_STATUS_LABELS, 0)} ELSE 'No email' END AS email_label,
{_lab('email_status', fv.EMAIL_STATUS_LABELS, 1)} END AS email_tone, concat_ws(', ', city, state) AS place FROM worked"""
_grp = "CASE key " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.COMPONENT_GROUPS.items()) + " END"
_grpl = "CASE key " + " ".join(f"WHEN {q(k)} THEN {q(fv.GROUP_LABELS[v])}" for k, v in fv.COMPONENT_GROUPS.items()) + " END"
O["component_rows"] = f"""SELECT lead_key, key, label, {_grp} AS "group", {_grpl} AS group_label,
CAST(floor(points + 0.5) AS INT) AS points_shown, CAST(floor(max + 0.5) AS INT) AS max_shown, points, max, ratio, reason, known
FROM reasons"""
_risk = "array_to_string(list_transform(list_filter(flags, lambda f: f NOT LIKE 'good:%'), lambda f: regexp_replace(f, '^[a-z]+:', '')), '{}')"
_first = f"CASE WHEN strpos({BEST_OWN}, ' ') > 0 THEN substr({BEST_OWN}, 1, strpos({BEST_OWN}, ' ') - 1) ELSE coalesce({BEST_OWN}, '') END"
_last = f"CASE WHEN strpos({BEST_OWN}, ' ') > 0 THEN substr({BEST_OWN}, strpos({BEST_OWN}, ' ') + 1) ELSE '' END"
_crm = ["name", "coalesce(domain, '')", _first, _last, "coalesce(email, '')", "coalesce(phone, '')", "coalesce(city, '')",
        "coalesce(state, '')", f"coalesce({BEST_IND}, '')", f"coalesce(CAST(nullif({BEST_EMP}, 0) AS STRING), '')",
        "coalesce(CAST(founded_year AS STRING), '')", "score", "tier", "CAST(confidence AS STRING) || '%'",
        "coalesce(email_status, '')", "why", _risk.format("; "), "stage", "coalesce(notes, '')"]
O["crm_columns"] = "SELECT " + ", ".join(f'{e} AS "{c}"' for e, c in zip(_crm, fv.CRM_COLUMNS)) + \
    " FROM worked JOIN top_reasons USING (lead_key)"
O["export_crm_csv"] = O["crm_columns"].replace("score AS", "CAST(score AS STRING) AS")
O["brief_facts"] = f"""SELECT lead_key, name AS company, concat_ws(', ', city, state) AS location, {BEST_IND} AS industry,
{BEST_EMP} AS employees, {BEST_OWN} AS owner_name, years_in_business, description,
replace(recurring_terms, ', ', '; ') AS recurring_revenue_offers, family_owned, succession AS succession_language,
why_upside AS digital_gaps, score, why AS top_reasons, {_risk.format('; ')} AS risks FROM worked JOIN top_reasons USING (lead_key)"""
_elab = "CASE key " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.EVIDENCE_LABELS.items()) + " END"
_plab = "CASE page " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.PAGE_LABELS.items()) + " ELSE page END"
CTES["lead_evidence"] = f"""
SELECT lead_key, name, key, page, quote FROM worked w JOIN site_evidence e ON w.domain = e.domain AND w.reachable
  WHERE NOT (key = 'franchise' AND {first_brand('name')} IS NOT NULL)
UNION ALL SELECT lead_key, name, 'franchise', 'company name', '“' || name || '” matches the national franchise brand “' ||
  {first_brand('name')} || '”.' FROM worked WHERE {first_brand('name')} IS NOT NULL"""
O["evidence_rows"] = f"""SELECT lead_key, key, {_elab} AS label, {_plab} AS page, quote AS text FROM lead_evidence
WHERE key IN {in_list(fv.EVIDENCE_LABELS)}"""

# ---- filters
_F = {
    "search_text": "lower(name) LIKE '%alder%1%' OR lower(domain) LIKE '%alder%1%' OR lower(city) LIKE '%alder%1%'",
    "search_text_literal": "contains(lower(name), 'nation_1') OR contains(lower(domain), 'nation_1') OR contains(lower(city), 'nation_1')",
    "tier_in": "tier IN ('A', 'B')", "min_score": "score >= 40", "industry_eq": "lower(industry) = 'hvac'",
    "stage_in": "stage IN ('shortlist', 'contacted')", "has_direct_email": "email_status IN ('valid', 'personal_domain')",
    "owner_transition": "succession OR family_owned", "status_eq": "status = 'failed'",
    "combined_filters": "(lower(name) LIKE '%s%' OR lower(domain) LIKE '%s%' OR lower(city) LIKE '%s%') AND tier IN ('B', 'C', 'D') "
                        "AND score >= 20 AND email_status IN ('valid', 'personal_domain') AND stage IN ('new', 'passed')",
}
for _k, _c in _F.items():
    O[_k] = f"SELECT {_KEPT} FROM worked WHERE {_c}"
O["search_text_indexed"], O["search_text_literal_indexed"] = O["search_text"], O["search_text_literal"]
O["search_text_short_indexed"] = f"SELECT {_KEPT} FROM worked WHERE name LIKE '%_1%' OR domain LIKE '%_1%' OR city LIKE '%_1%'"
O["select_for_enrichment"] = """SELECT lead_key, name, 'pending' AS status FROM worked WHERE state IS NULL AND domain IN (
SELECT 's' || CAST(lead_no AS STRING) || '.test' FROM lead_edits)"""
O["enrich_selected"] = """SELECT lead_key, CASE WHEN touched IS NULL THEN 'pending' ELSE status END AS status,
CASE WHEN touched IS NULL THEN first_score ELSE score END AS score FROM (
  SELECT f.lead_key, f.phone, f.score AS first_score, s.score, s.status, e.domain AS touched FROM fresh_scored f
  JOIN scored s ON f.lead_key = s.lead_key
  LEFT JOIN (SELECT DISTINCT 's' || CAST(lead_no AS STRING) || '.test' AS domain FROM lead_edits) e ON f.domain = e.domain)"""
O["named_rows_only"] = f"SELECT ord, {clean('name')} AS name FROM leads_raw WHERE {clean('name')} IS NOT NULL"
O["fetch_ok"] = "SELECT url, status FROM fetch_clean WHERE ok"
O["fresh_fetch"] = f"SELECT url, page_id FROM fetch_raw WHERE fetched_at >= TIMESTAMP '{dv.AS_OF}' - INTERVAL 72 HOUR"
O["is_blocked"] = "SELECT url, status, blocked FROM fetch_clean"
O["html_content_filter"] = "SELECT url, length(html) AS chars FROM fetch_clean"
O["robots_filter"] = """SELECT page_id, url FROM (
  SELECT *, length(origin) % 4 AS v FROM (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) AS origin,
    regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages))
WHERE v IN (2, 3) OR (v = 0 AND NOT starts_with(path, '/en/'))
  OR (v = 1 AND (starts_with(path, '/en/6') OR NOT starts_with(path, '/en/')))"""
O["validate_edit"] = f"""SELECT event_id, stage IS NOT NULL AND
(notes IS NULL OR length(notes) * (event_id % 1000) <= {NOTES_MAX}) AS accepted FROM lead_edits"""
O["validate_icp"] = """SELECT p_partkey, p_size - 5 <= p_partkey % 60 AND p_size - 5 >= 0 AND p_partkey % 60 >= 1
AND p_size * 3 BETWEEN 0 AND 100 AS accepted FROM part"""
O["urls_to_refetch"] = f"""SELECT url FROM (SELECT url FROM site_raw UNION SELECT url FROM pages) EXCEPT
SELECT url FROM fetch_raw WHERE fetched_at >= TIMESTAMP '{dv.AS_OF}' - INTERVAL 72 HOUR AND status NOT IN (0, 429, 500, 502, 503, 504)"""
O["lead_by_id"] = """SELECT lead_key, name, domain, score, stage, notes, crawl_error AS error FROM worked
WHERE lead_key = md5('b1|1|s1.test')"""

# ---- joins
O["match_existing"] = "SELECT ord, key, matched_key FROM matched"
O["upsert_leads"] = f"SELECT lead_key, seq, batch_id, {', '.join(FIELDS)} FROM upserted"
O["import_counts"] = "SELECT count(*) FILTER (WHERE matched_key IS NULL) AS added, count(matched_key) AS already_in_pipeline FROM matched"
O["union_of_inserts_and_updates"] = """SELECT batch_id, count(*) AS leads, count(domain) AS with_domain, count(phone) AS with_phone
FROM upserted GROUP BY batch_id"""
O["resolve_links_to_pages"] = "SELECT domain, kind, url FROM crawled WHERE kind <> 'home'"
O["home_page_fallback"] = "SELECT domain, reachable, blocked, error, https FROM site_state"
O["mx_join_hosts"] = f"SELECT lead_key, email, has_mx FROM stored_all LEFT JOIN mx_hosts ON {host_of('email')} = host"
O["apply_edits"] = "SELECT lead_key, stage, notes FROM worked"
O["weight_shares"] = f"""SELECT CAST(r_regionkey AS INT) AS icp_id, k AS key, CAST(CASE k WHEN 'maturity' THEN 20 + 4 * r_regionkey
WHEN 'upside' THEN 10 - 2 * r_regionkey WHEN 'size' THEN 15 - 2 * r_regionkey ELSE 0 END AS INT) AS weight,
CAST(floor(weight / 45.0 * 100 + 0.5) AS INT) AS share_percent
FROM region CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in fv.COMPONENT_LABELS)}) t(k)"""
O["cross_params"] = "SELECT lead_key, CAST(r_regionkey AS INT) AS icp_id, CAST(r_regionkey * 5 AS INT) AS min_years FROM stored_all, region"
O["franchise_brand_join"] = f"SELECT ord, name, {first_brand('name')} AS brand FROM leads_raw"
O["franchise_brand_table"] = """SELECT l.ord, l.name, b.brand FROM leads_raw l LEFT JOIN (
  SELECT n.name, arg_min(lower(t.brand), t.ord) AS brand FROM (SELECT DISTINCT name FROM leads_raw) n
  JOIN brand_table t ON contains(lower(n.name), lower(t.brand)) GROUP BY n.name) b ON l.name = b.name"""
O["unmatched_site"] = "SELECT lead_key, domain, crawl_error AS error FROM enriched WHERE NOT reachable"

# ---- aggregates
O["dedupe_merge"] = f"SELECT key, ord, {', '.join(FIELDS)} FROM merged_all"
O["import_report"] = f"""SELECT r.n AS rows_read, count(DISTINCT key) AS unique_in_file, count(*) - count(DISTINCT key) AS duplicates_in_file,
r.n - count(*) AS skipped_missing_name, count(*) FILTER (WHERE domain IS NULL) AS missing_website
FROM norm_all, (SELECT count(*) AS n FROM leads_raw) r GROUP BY r.n"""
O["import_with_report"] = f"SELECT *, unique_in_file AS leads FROM ({O['import_report']})"
_status = """count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'enriched') AS enriched,
count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status <> 'pending') AS reviewed"""
_tiers = ", ".join(f"count(*) FILTER (WHERE status <> 'pending' AND tier = '{t}') AS tier_{t.lower()}" for t in "ABCD")
_stages = ", ".join(f"count(*) FILTER (WHERE stage = '{s}') AS stage_{s}" for s in fv.STAGES)
_sigs = """count(*) FILTER (WHERE succession OR family_owned) AS owner_transition,
count(*) FILTER (WHERE email_status IN ('valid', 'personal_domain')) AS direct_email"""
O["status_counts"] = f"SELECT {_status} FROM worked"
O["tier_counts"] = f"SELECT {_tiers} FROM worked"
O["stage_counts"] = f"SELECT {_stages} FROM worked"
O["signal_counts"] = f"SELECT {_sigs} FROM worked"
O["stats"] = f"SELECT {_status}, {_tiers}, {_stages}, {_sigs} FROM worked"
O["distinct_industries"] = f"SELECT DISTINCT {BEST_IND} AS industry FROM worked WHERE {BEST_IND} IS NOT NULL"
O["stats_kept"], O["industries_kept"], O["snapshot_stats"] = O["stats"], O["distinct_industries"], O["stats"]
O["snapshot_settings"] = """SELECT k AS icp_id, 'plumbing, ' || lower(r_name) AS industries, k * 4 AS employees_min,
k * 40 + 20 AS employees_max, k * 5 AS min_years, 20 + k * 4 AS maturity, 10 - k * 2 AS upside, 15 - k * 2 AS size
FROM (SELECT CAST(r_regionkey AS INT) AS k, r_name FROM region)"""
O["job_progress"] = """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE st <> 'pending') AS done,
count(*) FILTER (WHERE st = 'failed') AS failed, CASE WHEN bool_and(st <> 'pending') THEN 'finished' ELSE 'running' END AS status,
CAST(floor(count(*) FILTER (WHERE st <> 'pending') / count(*)::DOUBLE * 100 + 0.5) AS INT) AS percent
FROM (SELECT coalesce(state, 'none') AS batch_id, CASE WHEN state = 'R1' AND phone IS NULL THEN 'pending' ELSE status END AS st
FROM worked) GROUP BY batch_id"""
CTES["swept"] = f"""SELECT *, CAST(r_regionkey AS INT) AS rk, CAST(r_regionkey AS INT) * 4 AS emp_lo, CAST(r_regionkey AS INT) * 40 + 20 AS emp_hi,
CAST(r_regionkey AS INT) * 5 AS min_yrs, ['Plumbing', upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2))] AS tgts FROM enriched, region"""
CTES["swept_parts"] = parts_sql("swept", cols={"targets": "tgts", "lo": "emp_lo", "hi": "emp_hi", "min_years": "min_yrs"})
CTES["swept_scored"] = score_sql(
    "swept_parts",
    {"maturity": "(20 + rk * 4)", "size": "(15 - rk * 2)", "industry": "15", "recurring": "15", "succession": "15",
     "upside": "(10 - rk * 2)", "reachability": "10"}, "100")
O["rescore_all"] = "SELECT lead_key, rk AS icp_id, score, tier, confidence FROM swept_scored"
CTES["every_flags"] = """
SELECT domain, max(CASE WHEN key = 'founded_year' THEN CAST(val AS INT) END) AS founded_year,
  max(CASE WHEN key = 'owner_name' THEN val END) AS owner_name,
  max(CASE WHEN key = 'succession' THEN page END) AS succession_page,
  max(CASE WHEN key = 'family_owned' THEN page END) AS family_owned_page,
  max(CASE WHEN key = 'hiring' THEN page END) AS hiring_page, max(CASE WHEN key = 'pe_backed' THEN page END) AS pe_backed_page
FROM every_first GROUP BY domain"""
O["site_rollup"] = f"""SELECT t.domain, kinds AS pages_crawled, founded_year, owner_name, copyright_year, hint AS employees_hint,
{_TECH}, succession_page, family_owned_page, hiring_page, pe_backed_page
FROM every_tech t LEFT JOIN every_flags f ON t.domain = f.domain"""
O["ordered_distinct_collect"] = """SELECT t.domain, coalesce(e.items, '') AS emails, coalesce(p.items, '') AS phones,
coalesce(r.items, '') AS recurring_terms FROM every_tech t LEFT JOIN every_emails e ON t.domain = e.domain
LEFT JOIN every_phones p ON t.domain = p.domain LEFT JOIN every_terms r ON t.domain = r.domain"""
O["founding_year"] = "SELECT domain, CAST(val AS INT) AS founded_year, page, quote FROM every_first WHERE key = 'founded_year'"
O["copyright_year"] = "SELECT domain, copyright_year FROM every_tech"
O["industry_argmax"] = "SELECT domain, guess AS industry_guess FROM every_industry"
O["confidence"] = "SELECT lead_key, confidence FROM scored"

# ---- first, top, order
O["first_link_per_kind"] = "SELECT * FROM (" + kinds_sql("site_anchors", "page_id") + ")"
O["top3_reasons"] = "SELECT lead_key, why FROM top_reasons"
O["best_email"] = "SELECT lead_key, email FROM lead_contacts"
_rank = "SELECT lead_key, name, score, confidence, seq FROM worked ORDER BY "
O["sort_leads"] = _rank + "score DESC, confidence DESC, seq"
O["sort_leads_by_name"] = _rank + "lower(name), seq"
O["sort_leads_by_years"] = _rank + "coalesce(nullif(years_in_business, 0), -1) DESC, seq"
O["sort_leads_by_confidence"] = _rank + "confidence, seq"
O["top_n_leads"] = _rank + "score DESC, confidence DESC, seq LIMIT 20"

# ---- strings and contacts
O["clean_text"] = f"""SELECT ord, {clean('name')} AS name, {clean('city')} AS city, {clean('phone')} AS phone FROM leads_raw
UNION ALL SELECT doc_id, {clean('text')}, NULL, NULL FROM documents"""
O["normalize_domain"] = f"SELECT ord, {domain('website')} AS from_site, {domain('email')} AS from_email FROM leads_raw"
O["normalize_name"] = f"SELECT ord, {name_key('name')} AS name_key FROM leads_raw"
O["parse_employees"] = f"SELECT ord, {employees('employees')} AS employees FROM leads_raw"
O["domain_from_email"] = f"SELECT ord, CASE WHEN {domain('email')} NOT IN {FREE} THEN {domain('email')} END AS domain FROM leads_raw"
O["dedupe_key"] = "SELECT ord, key FROM norm_all"
O["normalize_phone"] = f"SELECT ord, {phone('phone')} AS phone FROM leads_raw"
O["classify_email"] = f"""SELECT lead_key, {classify('email', 'has_mx')} AS email_status FROM stored_all
LEFT JOIN mx_hosts ON {host_of('email')} = host"""
O["email_rank"] = f"""SELECT ord, {rank_email('lower(email)', 'owner_name', domain('website'))} AS rank FROM leads_raw WHERE email IS NOT NULL"""
CTES["mail_sources"] = "SELECT doc_id AS id, 0 AS src, text AS body FROM documents UNION ALL SELECT page_id, 1, html FROM site_raw"
CTES["mail_keyed"] = "SELECT CAST(src AS STRING) || '/' || CAST(id AS STRING) AS k, * FROM mail_sources"
CTES["mail_found"] = distinct_in_order("mail_keyed", "k", email_list("body"), "0", 1000000)
O["extract_emails"] = "SELECT id, coalesce(items, '') AS emails FROM mail_keyed LEFT JOIN mail_found USING (k)"
CTES["call_keyed"] = f"""SELECT '0/' || CAST(doc_id AS STRING) AS k, doc_id AS id, text AS body, 1000000 AS keep FROM documents
UNION ALL SELECT '1/' || CAST(page_id AS STRING), page_id, text, 4 FROM page_text"""
CTES["call_found"] = distinct_in_order("call_keyed", "k", phone_list("body"), "0", 1000000)
O["extract_phones"] = """SELECT id, coalesce(CASE WHEN keep = 4 THEN array_to_string(string_split(items, ', ')[1:4], ', ') ELSE items END, '') AS phones
FROM call_keyed LEFT JOIN call_found USING (k)"""
O["html_to_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
_quotes = "SELECT domain, kind, key, quote FROM every_quotes WHERE key IN "
O["snippet"] = _quotes + "('family_owned', 'hiring', 'testimonials', 'recurring_revenue')"
_meta = f"coalesce({first_meta('html', 'name', 'description')}, {first_meta('html', 'property', 'og:description')})"
O["html_title_and_description"] = f"""SELECT page_id, {html_title('html')} AS title,
substr(trim(coalesce(nullif({entities(attr(_meta, 'content'))}, ''), substr(text, 1, 220))), 1, 300) AS description FROM page_text"""
O["social_links"] = "SELECT p.page_id, " + ", ".join(
    f"arg_min(href, pos) FILTER (WHERE contains(href, '{n}.com')) AS {n}" for n in fv.SOCIAL_NETWORKS
) + " FROM site_raw p LEFT JOIN site_anchors a ON p.page_id = a.page_id GROUP BY p.page_id"
O["resolve_url"] = "SELECT page_id, CAST(pos AS INT) AS pos, href, url, inside FROM page_anchors"
O["page_kind"] = "SELECT page_id, url, " + ", ".join(
    f"regexp_matches(hay, {q('(?i)' + p)}) AS {k}" for k, p in fv.LINK_PATTERNS.items()) + " FROM page_anchors WHERE inside"
_tg = lst(fv.DEFAULT_ICP["target_industries"])
O["industry_match"] = f"""SELECT ord, industry, len(list_filter({_tg}, lambda x: contains(lower(industry), lower(x))
OR contains(lower(x), lower(industry)))) > 0 AS is_target FROM leads_raw WHERE industry IS NOT NULL"""
_of = _first.replace(BEST_OWN, "owner_name")
O["owner_split"] = f"""SELECT ord, {_of} AS first, {_last.replace(BEST_OWN, 'owner_name')} AS last,
coalesce(nullif({_of}, ''), 'there') AS greeting FROM leads_raw"""

# ---- signals of pages
O["keyword_signals"] = _quotes + in_list(fv.KEYWORD_PATTERNS)
O["franchise_strong"] = "SELECT lead_key, name, page, quote FROM lead_evidence WHERE key = 'franchise'"
O["franchise_weak"] = _quotes + "('weak_franchise')"
CTES["page_terms"] = distinct_in_order(
    "every_page", "page_id", f"list_transform(regexp_extract_all(text, {q('(?i)' + fv.RECURRING_PATTERN)}), lambda t: lower(t))", "0", 6)
O["recurring_terms"] = "SELECT domain, kind, coalesce(items, '') AS terms FROM every_page LEFT JOIN page_terms USING (page_id)"
O["year_candidates"] = "SELECT domain, kind, year, fam AS family, CAST(pos AS INT) AS pos FROM every_years"
O["owner_name"] = "SELECT domain, kind, val AS owner, quote FROM every_quotes WHERE key = 'owner_name'"
O["employees_hint"] = f"""SELECT domain, kind, CAST(nullif(regexp_extract(text, {q('(?i)' + fv.HEADCOUNT_PATTERN)}, 1), '') AS INT) AS employees_hint
FROM every_page"""
O["tech_profile"] = f"SELECT t.domain, cms, mobile AS mobile_friendly, {_TECH} FROM every_tech t LEFT JOIN every_home h ON t.domain = h.domain"
O["digital_maturity"] = "SELECT domain, reachable, digital_maturity FROM signals"
O["enrich_contacts_of_leads"] = "SELECT lead_key, email, phone, email_status FROM enriched"
O["enrich_status_of_leads"] = "SELECT lead_key, status, crawl_error AS error FROM enriched"

# ---- scoring
for _k in KEYS:
    O[f"score_{_k}"] = f"""SELECT lead_key, round_even(r_{_k}, 2) AS ratio, p_{_k} AS points, m_{_k} AS max, why_{_k} AS reason,
known_{_k} AS known FROM scored"""
O["score_combined"] = f"SELECT lead_key, {' + '.join('p_' + k for k in KEYS)} AS points, score, tier, confidence FROM scored"
O["score_deductions"] = """SELECT lead_key, coalesce(pe_backed, FALSE) AS pe_backed, coalesce(franchise, FALSE) AS franchise, score
FROM scored WHERE pe_backed OR franchise"""
O["score_flags"] = """SELECT lead_key, CAST(pos AS INT) AS pos, split_part(f, ':', 1) AS level, substr(f, strpos(f, ':') + 1) AS text FROM (
SELECT lead_key, unnest(flags) AS f, generate_subscripts(flags, 1) AS pos FROM scored)"""
O["score_tier"] = "SELECT lead_key, score, tier FROM scored"
O["scores_before_enrichment"] = """SELECT lead_key, score, tier, confidence,
array_to_string(list_transform(flags, lambda f: substr(f, strpos(f, ':') + 1)), '; ') AS flag_texts FROM fresh_scored"""

# ---- briefs
_ind = f"lower(coalesce({BEST_IND}, 'business'))"
_place = "CASE WHEN concat_ws(', ', city, state) <> '' THEN ' in ' || concat_ws(', ', city, state) ELSE '' END"
_yrs = "CAST(nullif(years_in_business, 0) AS STRING)"
_risks = _risk.format("; ")
_brief = {
    "summary": f"name || ': ' || {_ind} || ' company' || {_place} || coalesce(', about ' || {_yrs} || ' years old', '') || "
               f"'. Fit score ' || CAST(score AS STRING) || ' of 100.'",
    "why": "why", "risks": f"CASE WHEN {_risks} <> '' THEN {_risks} ELSE {q(bf.NO_RISKS)} END",
    "questions": f"CASE WHEN n_terms > 0 THEN {q(bf.FIRST_QUESTION_RECURRING)} ELSE {q(bf.FIRST_QUESTION_ONE_OFF)} END || "
                 f"'; ' || {q('; '.join(bf.OTHER_QUESTIONS))}",
    "subject": "'What comes next for ' || name || '?'",
    "body": f"'Hello ' || coalesce(nullif({_first}, ''), 'there') || ',\n\nwhile looking at ' || {_ind} || ' companies' || {_place} || "
            f"' I found ' || name || '. Keeping a company going for ' || coalesce({_yrs} || ' years', 'so long') || "
            f"' says a lot about how you treat customers and staff.\n\nI want to buy one company, run it myself and keep its name "
            f"and people. Would you have a quarter of an hour next week for a first talk?\n\nKind regards\n[Your name]'",
}
CTES["plain_brief"] = "SELECT lead_key, domain, " + ", ".join(f"{e} AS {c}" for c, e in _brief.items()) + \
    " FROM worked JOIN top_reasons USING (lead_key)"
O["template_brief"] = f"SELECT lead_key, 'template' AS source, {', '.join(_brief)} FROM plain_brief"
CTES["answers"] = """SELECT 's' || CAST(conv_id AS STRING) || '.test' AS domain, arg_max(text, turn) AS text,
arg_max(role, turn) AS role, conv_id % 4 IN (0, 3) AS good FROM conversations GROUP BY conv_id"""
_ans = {"summary": "a.text", "why": "a.role", "risks": "a.role", "questions": "a.role", "subject": "'Hi'", "body": "a.text"}
O["parse_brief_responses"] = "SELECT b.lead_key, CASE WHEN a.good THEN 'ai' WHEN a.domain IS NOT NULL THEN " \
    "'template (AI unavailable)' ELSE 'template' END AS source, " + ", ".join(
        f"CASE WHEN a.good THEN {e} ELSE b.{c} END AS {c}" for c, e in _ans.items()) + \
    " FROM plain_brief b LEFT JOIN answers a ON b.domain = a.domain"

# ---- sinks
O["write_snapshot_json"] = f"SELECT lead_key, score, tier, {BEST_IND} AS industry, industry AS raw_industry, notes FROM worked"
O["store_fetches"] = """SELECT url, status, length(html) + CASE WHEN page_id % 2 = 1 THEN 6 + length(CAST(page_id AS STRING)) ELSE 0 END AS chars
FROM fetch_raw WHERE status <> 0"""
O["store_fetches_merged"] = O["store_fetches"]
O["urls_to_refetch_stored"] = O["urls_to_refetch"]
O["urls_to_refetch_stream"] = f"""SELECT url FROM (SELECT url FROM site_raw UNION SELECT url FROM pages) EXCEPT
SELECT url FROM fetch_raw WHERE fetched_at + INTERVAL 1 HOUR * (page_id % 2) >= TIMESTAMP '{dv.AS_OF}' - INTERVAL 72 HOUR
  AND status NOT IN (0, 429, 500, 502, 503, 504)"""
O["apply_edits_stream"] = O["apply_edits"]
O["store_scores"] = "SELECT lead_key, score, tier, confidence, 7 AS components, len(flags) AS n_flags FROM scored"
upsert_ctes("again", "upserted", "merged_after", 3)
O["upsert_store"] = O["upsert_leads"]
O["upsert_store_repeated"] = "SELECT batch_id, count(*) AS leads, count(domain) AS with_domain FROM again_upserted GROUP BY batch_id"
O["import_batches"] = "SELECT batch_id, count(*) AS leads, count(domain) AS with_domain FROM again_upserted GROUP BY batch_id"
O["incremental_import_stream"] = """SELECT domain IS NOT NULL AS has_domain, count(*) AS leads, count(DISTINCT domain) AS domains
FROM merged_all GROUP BY 1"""

O["incremental_import_store"] = """SELECT 'stream-' || CAST(CAST(substr(batch_id, 2) AS INT) - 1 AS STRING) AS batch_id,
count(*) AS leads, count(domain) AS with_domain FROM again_upserted GROUP BY 1"""


def all_oracles() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
