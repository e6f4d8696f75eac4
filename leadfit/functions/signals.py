"""Business signals in one page, as Catalyst expressions over its text and raw HTML."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.text import blank_to_null, let, snippet, str_array

ANY_CASE = "(?i)"


def led(pattern: str) -> str:
    """The pattern behind a test of its first letter, which refuses most places of a text at once.

    For patterns whose alternatives, at the top or right behind a leading \\b(?: , all begin with a letter; others stay.
    """
    bound = pattern.startswith(r"\b(?:")
    firsts, depth, fresh = "", 0, True
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern[5:] if bound else pattern):
        token = m[0]
        if fresh:
            firsts, fresh = firsts + token, False
            if not re.fullmatch("[a-z]", token) or m.string[m.end():m.end() + 1] in ("?", "*", "{"):
                return pattern
        elif depth == 0 and token == ")":
            break
        elif depth == 0 and token == "|":
            fresh = True
        depth += (token == "(") - (token == ")")
    letters = "".join(sorted(set(firsts)))
    return f"(?=[{letters}])(?:{pattern})"


def first_brand(text: Column, brands: list[str] = fv.FRANCHISE_BRANDS) -> Column:
    """First franchise brand, in list order, that the text contains; NULL when none."""
    return let(F.lower(text), lambda hay: F.get(
        F.filter(str_array(brands), lambda b: F.contains(hay, b)), F.lit(0)))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Plain substring tests: far cheaper than a pattern, and most pages fail all of them."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(lowered, F.lit(w))
    return out


def plain_words(pattern: str) -> list[str]:
    """Alternatives of a pattern that has no operators but | and escapes."""
    words = [w.replace("\\", "") for w in pattern.split("|")]
    if "|".join(w.replace(".", r"\.").replace("(", r"\(") for w in words) != pattern:
        raise ValueError(f"not a list of plain words: {pattern}")
    return words


def keyword_match(text: Column, lowered: Column, key: str, pattern: str) -> Column:
    """First match of a keyword pattern, tried only where one of its stems occurs."""
    return F.when(contains_any(lowered, fv.PATTERN_STEMS[key]), literal_match(text, pattern))


def literal_match(text: Column, pattern: str) -> Column:
    """First match of a pattern without boundary assertions; NULL when there is none."""
    return F.regexp_substr(text, F.lit(ANY_CASE + led(pattern)))


def spot(start: Column, length: Column) -> Column:
    """struct<b, e>: a half-open range of characters."""
    return let(start, lambda b: F.struct(b.alias("b"), (b + length).alias("e")))


def literal_spot(text: Column, found: Column) -> Column:
    """Place of a match of `literal_match`.

    Without boundary assertions the first match is also the first place where its own words
    occur, so a plain search gives its position.
    """
    return F.when(found.isNotNull(), spot(F.instr(text, found) - 1, F.length(found)))


def match_spot(text: Column, pattern: str, index: Column) -> Column:
    """Place of the index-th match: after the pieces and the matches before it."""
    def total(parts: Column, count: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), count), F.lit(0), lambda acc, p: acc + F.length(p))

    def place(matches: Column) -> Column:
        before = total(F.split(text, pattern), index + 1) + total(matches, index)
        return spot(before, F.length(F.get(matches, index)))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), place)


def quotes(text: Column, spots: list[Column]) -> Column:
    """array<string>: the quote around each spot, NULL for NULL spots."""
    return F.transform(F.array(*spots), lambda p: F.when(p.isNotNull(), snippet(text, p["b"], p["e"])))


# ---- founding year -------------------------------------------------------------

def _year_hits(text: Column, pattern: str, family: int, to_year, low, high) -> Column:
    """array<struct<year, family, pos>> of plausible hits, `pos` counting all hits."""
    raw = F.regexp_extract_all(text, F.lit(ANY_CASE + led(pattern)), 1)
    hits = F.transform(
        raw, lambda y, i: F.struct(y.cast("int").alias("n"), i.alias("pos"))
    )
    kept = F.filter(hits, lambda h: h["n"].between(low, high))
    return F.transform(
        kept,
        lambda h: F.struct(to_year(h["n"]).alias("year"), F.lit(family).alias("family"), h["pos"].alias("pos")),
    )


def year_candidates(text: Column, today: date) -> Column:
    """All founding-year candidates of a page: 'since YYYY' first, then 'for N years'."""
    return F.concat(
        _year_hits(text, fv.FOUNDED_PATTERN, 0, lambda y: y, fv.FOUNDED_MIN_YEAR, today.year),
        _year_hits(text, fv.YEARS_PATTERN, 1, lambda n: F.lit(today.year) - n, *fv.YEARS_RANGE),
    )


def founding_spot(text: Column, best: Column) -> Column:
    return (
        F.when(best["family"] == 0, match_spot(text, ANY_CASE + led(fv.FOUNDED_PATTERN), best["pos"]))
        .when(best["family"] == 1, match_spot(text, ANY_CASE + led(fv.YEARS_PATTERN), best["pos"]))
    )


def copyright_year(html: Column, today: date) -> Column:
    years = F.transform(
        F.regexp_extract_all(html, F.lit(ANY_CASE + "(?=[©&c])" + fv.COPYRIGHT_PATTERN), 1), lambda y: y.cast("int")
    )
    return F.array_max(F.filter(years, lambda y: y.between(fv.COPYRIGHT_MIN_YEAR, today.year)))


# ---- people ----------------------------------------------------------------------

def _owner_hit(text: Column, pattern: str, family: int) -> Column:
    """First name that does not start with a common word: struct<name, family, pos>, or NULL."""
    names = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), 1),
        lambda n, i: F.struct(n.alias("name"), F.lit(family).alias("family"), i.alias("pos")),
    )
    real = F.filter(names, lambda n: ~F.substring_index(n["name"], " ", 1).isin(fv.NOT_A_FIRST_NAME))
    return F.get(real, F.lit(0))


def owner_hit(text: Column) -> Column:
    """'Name, owner' wins over 'owner Name' on the same page."""
    mentions_role = text.rlike("(?=[ofcpOFCP])" + fv.OWNER_ROLES)
    return F.when(
        mentions_role,
        F.coalesce(_owner_hit(text, fv.OWNER_NAME_FIRST, 0), _owner_hit(text, fv.OWNER_ROLE_FIRST, 1)),
    )


def owner_spot(text: Column, hit: Column) -> Column:
    return (
        F.when(hit["family"] == 0, match_spot(text, fv.OWNER_NAME_FIRST, hit["pos"]))
        .when(hit["family"] == 1, match_spot(text, fv.OWNER_ROLE_FIRST, hit["pos"]))
    )


# ---- wording -----------------------------------------------------------------------

def weak_franchise_match(text: Column) -> Column:
    """'Locally owned and operated', only where the same page also speaks of franchising."""
    backed = text.rlike(ANY_CASE + led(fv.FRANCHISE_WORDS)) | first_brand(text).isNotNull()
    return let(literal_match(text, fv.FRANCHISE_WEAK_PHRASES), lambda weak: F.when(weak.isNotNull() & backed, weak))


def recurring_terms(text: Column, keep: int | None = fv.TERMS_KEPT) -> Column:
    """Distinct lower-case offers in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(ANY_CASE + led(fv.RECURRING_PATTERN)), 0)
    out = F.array_distinct(F.transform(found, lambda t: F.lower(t)))
    return F.slice(out, 1, keep) if keep else out


def headcount(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, ANY_CASE + led(fv.HEADCOUNT_PATTERN), 1)).cast("int")


def industry_hits(text: Column, lowered: Column | None = None) -> Column:
    """Number of hits per industry, in the order of the industry list; `lowered` is the text in lower case, if at hand."""
    def counts(lowered: Column) -> Column:
        return F.array(*[
            F.when(contains_any(lowered, plain_words(p)), F.regexp_count(lowered, F.lit(led(p)))).otherwise(F.lit(0))
            for p in fv.INDUSTRY_PATTERNS.values()
        ])

    return let(F.lower(text) if lowered is None else lowered, counts)


def industry_from_hits(hits: Column) -> Column:
    """Industry with most hits, the first listed on ties; NULL below two hits."""
    def best(h: Column) -> Column:
        at = F.array_position(h, F.array_max(h)).cast("int")
        return F.when(F.array_max(h) >= fv.INDUSTRY_MIN_HITS, F.get(str_array(fv.INDUSTRY_PATTERNS), at - 1))

    return let(hits, best)


# ---- technology ----------------------------------------------------------------------

def cms_rank(lowered_html: Column) -> Column:
    """Position of the first marker found, in list order; NULL when none."""
    out = F
    for i, marker in enumerate(fv.CMS_MARKERS.values()):
        out = out.when(F.contains(lowered_html, F.lit(marker)), i)
    return out.otherwise(F.lit(None).cast("int"))


def cms_name(rank: Column) -> Column:
    return F.get(str_array(fv.CMS_MARKERS), rank)


def digital_maturity(flags: dict[str, Column]) -> Column:
    """Points of the digital features present."""
    total = F.lit(0)
    for name, points in fv.DIGITAL_POINTS.items():
        total = total + F.when(flags[name], points).otherwise(0)
    return total


def is_fresh(copyright_year_col: Column, today: date) -> Column:
    return F.coalesce(copyright_year_col >= today.year - 1, F.lit(False))
