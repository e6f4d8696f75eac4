import json
import re
from datetime import date

from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions import html as ht
from leadfit.functions import signals as sg
from leadfit.operators.pages import page_findings

DAY = date(2026, 9, 16)


def test_html_to_text(each):
    cases = {
        '<!DOCTYPE html><title>A &amp; B</title><p>x<b>y</b></p>': "A & B x y",
        '<script>var t="</p>";</script>one<style>p{}</style>two': "one two",
        '<a title="a > b">link</a> 3 < 4': "link 3 < 4",
        "<!-- <p>no</p> -->yes<noscript>n</noscript><svg><text>s</text></svg>": "yes",
        "&lt;b&gt; &amp;lt; &#8217;&#x41;&copy;&nbsp;&nbsp;z &unknown; &#146;": "<b> &lt; ’A© z &unknown; ’",
        "before<script>never closed": "before",
        "a&#38;lt;b": "a&lt;b",
        "": "",
    }
    assert each(ht.html_to_text, list(cases)) == list(cases.values())


def test_huge_tag_does_not_exhaust_the_stack(each):
    page = "<p " + "x" * 200_000 + ">ok</p><i " + "'q' " * 50_000 + ">fine"
    assert each(ht.html_to_text, [page]) == ["ok fine"]


def test_title_and_description(each):
    html = '<title> T &amp; U </title><meta content="c &quot;d&quot;" name="description"><meta name=viewport content=x>'
    assert each(ht.html_title, [html, "<p>"]) == ["T & U", None]
    assert each(ht.meta_description, [html, '<meta property="og:description" content="og">',
                                      '<meta name="description" content=""><meta property="og:description" content="og">']
                ) == ['c "d"', "og", None]
    assert each(ht.has_viewport, [html, "<meta name='viewportx'>"]) == [True, False]


def test_resolve_url(each):
    base = F.lit("https://oak.test/a/b?q=1#f")
    cases = {
        "/x": "https://oak.test/x", "c#d": "https://oak.test/a/c", "?p=2": "https://oak.test/a/b?p=2",
        "//elm.test/y": "https://elm.test/y", "http://z.test/": "http://z.test/", "mailto:a@b.c": "mailto:a@b.c",
        "#top": "https://oak.test/a/b?q=1", "../k/./m": "https://oak.test/k/m", "": "https://oak.test/a/b?q=1",
        "/a/../b/": "https://oak.test/b/",
    }
    assert each(lambda c: ht.resolve_url(c, base), list(cases)) == list(cases.values())


def test_first_link_per_kind(each):
    html = ("<a href='/'>About home</a><a href=/team/meet#x>People</a><a href='https://www.oak.test/services'>S</a>"
            "<a href='https://else.test/contact'>Contact</a><a name='a'>Contact</a><a href='/find-us'><b>Get in</b> contact</a>")
    got = each(lambda c: ht.page_kind_links(c, F.lit("https://oak.test/"), F.lit("oak.test")), [html])[0]
    assert got.asDict() == {"about": "https://oak.test/team/meet", "services": "https://www.oak.test/services",
                            "contact": "https://oak.test/find-us", "careers": None}


def test_is_blocked_and_ok(spark):
    rows = [(200, "<title>Just a Moment...</title>", True), (403, "solve the CAPTCHA", True), (403, "forbidden", False),
            (200, "captcha", False), (200, "", False)]
    df = spark.createDataFrame(rows, "s int, h string, want boolean")
    got = df.select("want", ht.is_blocked(F.col("s"), F.col("h")).alias("b"), "s", "h").withColumn(
        "ok", ht.fetch_ok(F.col("s"), F.col("b"), F.col("h"))).collect()
    assert all(r["b"] == r["want"] for r in got)
    assert [r["ok"] for r in got] == [False, False, False, True, False]


def test_stems_cover_their_patterns():
    """Every alternative of a pattern holds one of the stems that guard it."""
    samples = {
        "succession": ["retire", "retiring", "retirement", "succession", "next chapter", "business for sale",
                       "business is for sale", "looking for a buyer", "looking for the right successor",
                       "pass the torch", "passing the torch"],
        "family_owned": ["family-owned", "family owned", "family business", "family-run", "family run", "second generation",
                         "third-generation", "father and son", "mother and daughter"],
        "hiring": ["were hiring", "we're hiring", "now hiring", "join our team", "open positions", "career opportunities"],
        "franchise": fv.FRANCHISE_PHRASES.split("|"),
        "pe_backed": ["portfolio company", "backed by x capital", "backed by partners", "backed by equity", "acquired by",
                      "a subsidiary of", "part of the x family of companies"],
        "testimonials": ["testimonial", "testimonials", "what our customers say", "review", "reviews", "5-star", "5 star"],
        "recurring": ["maintenance plans", "maintenance membership", "service contract", "service plans", "membership",
                      "subscription", "monthly plan", "annual inspections", "recurring", "retainer", "managed services"],
        "weak_franchise": fv.FRANCHISE_WEAK_PHRASES.split("|"),
    }
    patterns = {**fv.KEYWORD_PATTERNS, "recurring": fv.RECURRING_PATTERN, "weak_franchise": fv.FRANCHISE_WEAK_PHRASES}
    for key, pattern in patterns.items():
        for text in samples[key]:
            assert re.search(pattern, text), (key, text)
            assert any(s in text for s in fv.PATTERN_STEMS[key]), (key, text)
        depth = 0
        alternatives = 1
        for c in pattern:
            depth += (c == "(") - (c == ")")
            alternatives += c == "|" and depth == 0
        assert len(samples[key]) >= alternatives


def test_tech_patterns_are_plain_words():
    for p in [*fv.TECH_PATTERNS.values(), *fv.INDUSTRY_PATTERNS.values()]:
        assert sg.plain_words(p)


def test_year_candidates(each):
    text = "Since 1990, founded in 1985; since 2031. Est. 1849 for over 40 years, for 2 years, nearly 150+ years"
    got = each(lambda c: sg.year_candidates(c, DAY), [text])[0]
    assert [(r["year"], r["family"], r["pos"]) for r in got] == [(1990, 0, 0), (1985, 0, 1), (1986, 1, 0), (1876, 1, 2)]


def test_owner_hit(each):
    got = each(sg.owner_hit, [
        "Our Team, owner. Mary Ann, the owner", "President: Carl O'Neil and Ann Lee, CEO", "owner and Bob Stone", "no one here",
        "Jo B. Fields is our founder",
    ])
    assert [g and g["name"] for g in got] == ["Mary Ann", "Ann Lee", "Bob Stone", None, "Jo B. Fields"]


def test_findings_quotes_and_weak_franchise(spark):
    filler = "word " * 40
    pages = [
        ("a", f"<title>Oak</title><p>{filler}Family-owned since 1985 by Ann Lee, owner. {filler}</p>"),
        ("b", "<p>Locally owned and operated.</p>"),
        ("c", "<p>Locally owned and operated, with Molly Maid.</p>"),
        ("d", "<p>We beat Terminix every day.</p>"),
        ("e", "<title>TruGreen of Town</title><p>independently owned and operated franchise</p>"),
    ]
    df = spark.createDataFrame(pages, "id string, html string").withColumn("is_home", F.lit(True))
    got = {r["id"]: r for r in page_findings(df, DAY).collect()}
    assert got["a"]["founded"]["year"] == 1985 and got["a"]["owner"]["name"] == "Ann Lee"
    text = "Oak " + f"{filler}Family-owned since 1985 by Ann Lee, owner. {filler}".strip()
    at = text.index("since 1985")
    assert got["a"]["founded"]["quote"].startswith("…") and text[at:at + 10] in got["a"]["founded"]["quote"]
    assert got["b"]["weak_franchise_quote"] is None and got["b"]["franchise_quote"] is None
    assert "owned and operated" in got["c"]["weak_franchise_quote"]
    assert got["d"]["weak_franchise_quote"] is None and got["d"]["title_brand"] is None
    assert got["e"]["title_brand"] == "trugreen" and got["e"]["franchise_quote"]


def test_industry_ties_and_minimum(each):
    got = each(lambda c: sg.industry_from_hits(sg.industry_hits(c)),
               ["plumb heating plumb heating", "plumb", "dental dentist hvac", ""])
    assert got == ["HVAC", None, "Dental", None]


def test_recorded_sites_with_a_hot_host(spark):
    """Split hosts and pages answer as unsplit ones do, urls without a host too."""
    from leadfit.sources.page_tables import recorded_fetches, recorded_pages

    pages, sites = recorded_pages(spark.createDataFrame([('{"hot.test": {"/": "home", "/a": "page a"}, "b.test": {"__status__": "403", "/": "no"}}',)], "value string"))
    asked = [f"https://hot.test/{'a' if k % 3 else ''}?k={k}" for k in range(40)] + ["https://b.test/", "https://c.test/", "https://hot.test/z", "no url"]
    urls = spark.createDataFrame([(u,) for u in asked], "url string")
    split, whole = (sorted((tuple(r) for r in recorded_fetches(urls, pages, sites, n).collect()), key=repr) for n in (4, 1_000_000))
    assert split == whole and sorted(r[0] for r in split) == sorted(asked)
    assert {r[3] for r in split if "hot.test/a" in r[0]} == {"page a"} and [r[1] for r in split if r[0] == "https://hot.test/z"] == [404]


def test_recorded_sites(spark):
    from leadfit.sources.page_tables import recorded_fetches, recorded_pages
    lines = [json.dumps({"oak.test": {"/": "home", "/about": "a"}}), json.dumps({"wall.test": {"/": "captcha"}}),
             json.dumps({"wall.test": {"__status__": "403"}})]
    pages, sites = recorded_pages(spark.createDataFrame([(x,) for x in lines], "value string"))
    urls = spark.createDataFrame([("https://www.oak.test/about/",), ("http://oak.test/zzz",), ("https://wall.test/",),
                                  ("https://gone.test/",)], "url string")
    got = {r["url"]: r for r in recorded_fetches(urls, pages, sites).collect()}
    assert got["https://www.oak.test/about/"]["status"] == 200
    assert got["https://www.oak.test/about/"]["final_url"] == "https://oak.test/about"
    assert got["http://oak.test/zzz"]["status"] == 404
    assert got["https://wall.test/"]["blocked"] and got["https://wall.test/"]["status"] == 403
    assert got["https://gone.test/"]["error"] == fv.UNRESOLVED_HOST_ERROR


def test_patterns_led_by_their_first_letters():
    """The test of the first letter refuses only places where the pattern can't begin; patterns it can't read stay."""
    assert sg.led("hvac|air condition") == "(?=[ah])(?:hvac|air condition)"
    assert sg.led(r"\b(?:for|more (?:or|than))\s+(\d+)") == r"(?=[fm])(?:\b(?:for|more (?:or|than))\s+(\d+))"
    for kept in ("5[- ]star|review", "b?ook", "(?:a|b)c", r"\d+ years", "x*|y"):
        assert sg.led(kept) == kept
    text = "For 12 years. More than 40 YEARS; we’re Now Hiring, HVAC and air  condition, Founded in 1999, est. 1950 membership"
    for pattern in [*fv.KEYWORD_PATTERNS.values(), *fv.INDUSTRY_PATTERNS.values(), fv.RECURRING_PATTERN, fv.FOUNDED_PATTERN, fv.YEARS_PATTERN,
                    fv.HEADCOUNT_PATTERN]:
        found = [(m.span(), m.groups()) for m in re.finditer("(?i)" + pattern, text)]
        assert [(m.span(), m.groups()) for m in re.finditer("(?i)" + sg.led(pattern), text)] == found
