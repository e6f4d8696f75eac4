"""One bad cell or page neither ends nor stalls a job."""

import time

import pytest
from pyspark.sql import functions as F

from leadfit.functions import contacts as ct
from leadfit.functions import html as ht
from leadfit.functions.text import domain_from_email, normalize_domain
from leadfit.operators import pages

SIZE = 1_500_000


def page(unit):
    return unit * (SIZE // len(unit))


def readings(c):
    return {
        "text": F.length(ht.html_to_text(c)), "title": F.length(ht.html_title(c)), "description": F.length(ht.meta_description(c)),
        "anchors": F.size(ht.anchors(c)), "blocked": ht.is_blocked(F.lit(200), c),
    }


@pytest.mark.parametrize("name", ["text", "title", "description", "anchors", "blocked"])
def test_huge_pages_are_read_in_linear_time(spark, name):
    units = ["<a", "<a ", "<meta ", "<title>", "<title", "<script", "</script", "<script></script", "<a href=\"x>", "<a '", "<meta name=\"", "<!--"]
    pages = spark.createDataFrame([(u,) for u in units], "unit string").repartition(4).select(
        F.repeat("unit", F.floor(F.lit(SIZE) / F.length("unit")).cast("int")).alias("html"))
    out = pages.select(readings(F.col("html"))[name].alias("v"))
    spark.range(1).select(readings(F.lit("<p>x"))[name]).collect()
    start = time.time()
    assert len(out.collect()) == len(units)
    assert time.time() - start < 5 * len(units)


def test_long_hosts_and_addresses_are_invalid(spark):
    long_host = "a." * 100_000 + "com"
    rows = spark.createDataFrame([(long_host,), ("me@" + long_host,), ("x" * 100_000 + "@a.com",)], "v string")
    got = rows.select(
        normalize_domain("v").alias("d"), domain_from_email("v").alias("e"), ct.classify_email("v", F.lit(True)).alias("c")).collect()
    assert [r["d"] for r in got[:2]] == [None, None] and [r["e"] for r in got[:2]] == [None, None]
    assert [r["c"] for r in got] == ["invalid"] * 3


def test_unclosed_tags_end_with_the_page(one):
    text, title, description = one(
        [ht.html_to_text("h"), ht.html_title("h"), ht.meta_description("h")],
        h="<title>A &amp; B</title><p>seen</p><meta name=description content='it is'><p>also <a href='x")
    assert (text, title, description) == ("A & B seen also", "A & B", "it is")
    assert one([ht.html_title("h")], h="<title>never closed") == [None]


def test_robots_files_of_many_lines(spark):
    """A file of 100,000 lines takes seconds; the last rule of the right group still counts."""
    agent = "LeadBot/1.0"
    lines = ["User-agent: *", "Disallow: /all"] + [f"Disallow: /p{k}" for k in range(50_000)] + ["", "User-agent: other"] + [f"# {k}" for k in range(100)]
    lines += [f"Allow: /q{k}" for k in range(50_000)] + ["User-agent: leadbot", "User-agent: twin", "Crawl-delay: 1", *(f"Disallow: /r{k}" for k in range(3)), "", "Disallow: /stray"]
    robots = spark.createDataFrame([("https://a.test", 200, "\r\n".join(lines)), ("https://b.test", 200, "\n".join(lines[:50_003]))], "origin string, status int, body string")
    start = time.time()
    rules = {r["origin"]: [x["path"] for x in r["rules"]] for r in pages.robots_rules(robots, agent).collect()}
    assert time.time() - start < 30
    assert rules["https://a.test"] == ["/r0", "/r1", "/r2"]
    assert rules["https://b.test"] == ["/all", *(f"/p{k}" for k in range(50_000))]
