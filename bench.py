"""Time the headline work at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from checks import queries as q
from checks.derived import Inputs
from checks.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
# stages of the flow write tables that the later ones read
STAGES = {
    "import_merge_score": q.imported, "page_findings": q.crawl_findings, "site_signals": q.signals_table,
    "enrich_and_score": q.enriched, "apply_edits": q.worked,
}
READS = ["dedupe_merge", "upsert_leads", "rescore_all", "score_combined", "top_n_leads", "sort_leads", "combined_filters",
         "stats", "crm_columns", "component_rows", "html_to_text"]


def main() -> None:
    spark = local_session(CPUS)
    inputs = Inputs(spark, FOLDER)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, sizes = {}, {}
    for name, build in STAGES.items():
        start = time.time()
        table = build(inputs)
        seconds[name] = round(time.time() - start, 3)
        sizes[name] = table.count()
    for name in READS:
        start = time.time()
        q.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    raw_rows = inputs.given("orders").count()
    rates = {
        "lead_rows_per_sec": round(raw_rows / seconds["import_merge_score"]),
        "pages_per_sec": round(sizes["page_findings"] / seconds["page_findings"]),
        "rescored_leads_per_sec": round(sizes["enrich_and_score"] * 5 / seconds["rescore_all"]),
    }
    sf = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({
        "metric": "lead flow and queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else FOLDER, "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
