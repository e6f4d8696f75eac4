"""Page corpora as tables of fetch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.html import is_blocked, site_host, url_path
from leadfit.operators.skew import balanced_left_join
from leadfit.schemas import PAGE_FETCHES


def scan_page_corpus(source: DataFrame) -> DataFrame:
    """Any table with `url` and `html` as fetch results: status 200 and an open time where absent."""
    have = set(source.columns)

    def column(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    status = column("status", column("status_code", F.lit(200)))
    defaults = {
        "url": F.col("url"), "status": status, "final_url": column("final_url", F.col("url")),
        "html": F.coalesce(F.col("html"), F.lit("")),
        "blocked": column("blocked", is_blocked(status, F.col("html"))),
        "error": column("error", F.lit(None)), "fetched_at": column("fetched_at", F.lit(None)),
    }
    return source.select(*[defaults[c].cast(t).alias(c) for c, t in PAGE_FETCHES.items()])


def read_page_corpus(spark: SparkSession, path: str) -> DataFrame:
    return scan_page_corpus(spark.read.parquet(path))


def recorded_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines {domain: {path: html, "__status__": code}} -> (pages, sites).

    pages(host, path, html); sites(host, status) with status 200 unless recorded. A site may be
    spread over many lines, so no line and no task has to hold a whole site.
    """
    entries = (
        lines.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("host", "site"))
        .select("host", F.explode("site").alias("path", "html"))
    )
    is_status = F.col("path") == "__status__"
    sites = entries.groupBy("host").agg(
        F.coalesce(F.max(F.when(is_status, F.col("html").try_cast("int"))), F.lit(200)).alias("status")
    )
    return entries.where(~is_status), sites


def scan_recorded_sites(spark: SparkSession, path: str, whole_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Recorded sites from JSON lines, or from files of one JSON document each."""
    return recorded_pages(spark.read.text(path, wholetext=whole_file))


def recorded_fetches(urls: DataFrame, pages: DataFrame, sites: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """Fetch results of urls(url) answered from recorded sites.

    Unknown host: status 0 and an error. Unknown path: 404. Hosts are looked up in the narrow table of sites first, with
    hot ones split; HTML moves in the last join only, by page, where a page under many urls is split too. Urls are distinct.
    """
    bare = F.regexp_replace(url_path(F.col("url")), "/+$", "")
    asked = urls.withColumns({"host": site_host(F.col("url")), "path": F.when(bare == "", "/").otherwise(bare)})
    known_hosts = balanced_left_join(asked, sites, ["host"], ["url"], hot_rows)
    found = balanced_left_join(known_hosts, pages.select("host", "path", "html"), ["host", "path"], ["url"], hot_rows, hot_source=asked)
    known, present = F.col("status").isNotNull(), F.col("html").isNotNull()
    status = F.when(~known, 0).when(~present, 404).otherwise(F.col("status"))
    final = F.when(known & present, F.concat(
        F.lit("https://"), F.col("host"), F.when(F.col("path") == "/", "").otherwise(F.col("path"))
    )).when(known, F.col("url")).otherwise("")
    html = F.coalesce("html", F.lit(""))
    return found.select(
        "url", status.alias("status"), final.alias("final_url"), html.alias("html"),
        is_blocked(status, html).alias("blocked"),
        F.when(~known, fv.UNRESOLVED_HOST_ERROR).alias("error"), F.lit(None).cast("timestamp").alias("fetched_at"),
    )
