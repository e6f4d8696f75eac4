"""A spread of registered queries against their SQL twins; `python -m checks.compare` runs all."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"
NAMES = ["dedupe_merge", "match_existing", "upsert_leads", "lead_detail", "evidence_rows", "crm_columns", "site_rollup",
         "rescore_all", "parse_brief_responses", "robots_filter", "scan_leads_csv", "resolve_url", "html_to_text"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    ok, note = compare(name, spark, oracle_connection(FOLDER), FOLDER, entry.oracle_sql()[name])
    assert ok, note


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
