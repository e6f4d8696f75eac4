"""String cleaning and normalising as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadfit import fixed_values as fv


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once per row, however often the body uses it.

    Nested column expressions are copied at each use; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def str_array(values) -> Column:
    """Literal string array; typed also when empty."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def falsy(c: Column, dtype: str) -> Column:
    """True where the value counts as missing: NULL, '' or 0."""
    empty = F.lit("") if dtype == "string" else F.lit(0)
    return c.isNull() | (c == empty)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Collapse every kind of white space (no-break space included), trim, '' -> NULL."""
    return blank_to_null(F.trim(F.regexp_replace(as_col(c), r"(?U)\s+", " ")))


def normalize_name(c: Column | str) -> Column:
    """Company name as a matching key: no legal words, no punctuation, single spaces."""
    key = F.replace(F.lower(as_col(c)), F.lit("&"), F.lit(" and "))
    key = F.regexp_replace(key, fv.LEGAL_WORDS, " ")
    return F.trim(F.regexp_replace(key, "[^a-z0-9]+", " "))


def url_host(url: Column) -> Column:
    """Host of an absolute url, without user info and port ('' when there is none)."""
    return F.regexp_extract(url, r"^[a-z]+://(?:[^/?#]*@)?([^/?#:@]*)", 1)


def normalize_domain(c: Column | str) -> Column:
    """Bare registrable host of a website, url or address; NULL when it is not one."""
    def after_at(v: Column) -> Column:
        return F.when(v.contains("@") & ~v.contains("/"), F.regexp_replace(v, "^[^@]*@", "")).otherwise(v)

    def host(v: Column) -> Column:
        found = url_host(F.when(v.rlike("^[a-z]+://"), v).otherwise(F.concat(F.lit("http://"), v)))
        return F.regexp_replace(F.regexp_replace(found, r"^www\.", ""), r"^\.+|\.+$", "")

    return let(F.lower(F.trim(as_col(c))), lambda t: let(after_at(t), lambda v: let(
        host(v), lambda h: F.when(F.length(h) <= fv.HOST_MAX_CHARS, F.when(h.rlike(fv.HOST_PATTERN), h)))))


def parse_employees(c: Column | str) -> Column:
    """'25' -> 25, '1,200' -> 1200, '11-50' -> 30 (floor mean of the first two), else NULL."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"\d[\d,]*"), 0)
    nums = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"))

    def value(n: Column) -> Column:
        first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        return F.when(F.size(n) >= 2, F.floor(F.try_add(first, second) / 2)).otherwise(first)

    return let(nums, value).try_cast("int")


def is_free_mail_host(host: Column) -> Column:
    return host.isin(fv.FREE_MAIL_HOSTS)


def domain_from_email(email: Column | str) -> Column:
    """Company domain implied by an address: its host unless that is a free mail provider."""
    return let(normalize_domain(email), lambda h: F.when(~is_free_mail_host(h), h))


def dedupe_key(domain: Column, name_key: Column, city: Column) -> Column:
    return F.coalesce(domain, F.concat(name_key, F.lit("|"), F.lower(F.coalesce(city, F.lit("")))))


def normalize_phone(c: Column | str) -> Column:
    """Ten-digit numbers as (ddd) ddd-dddd; anything else trimmed as it is."""
    raw = as_col(c)

    def pretty(d: Column) -> Column:
        tail = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
        return let(tail, lambda t: F.when(F.length(t) == 10, F.concat(
            F.lit("("), F.substring(t, 1, 3), F.lit(") "), F.substring(t, 4, 3), F.lit("-"), F.substring(t, 7, 4),
        )))

    return F.when(raw != "", F.coalesce(let(F.regexp_replace(raw, r"\D", ""), pretty), F.trim(raw)))


def first_name(owner: Column, default: str = "there") -> Column:
    return F.coalesce(blank_to_null(F.get(F.split(F.trim(owner), r"\s+"), F.lit(0))), F.lit(default))


def split_owner(owner: Column) -> tuple[Column, Column]:
    """(first, rest) at the first space; '' where there is nothing."""
    parts = F.split(F.coalesce(owner, F.lit("")), " ", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def industry_matches(industry: Column, targets: Column) -> Column:
    """Either text contains the other, ignoring case."""
    return let(F.lower(industry), lambda ind: F.exists(
        targets, lambda t: F.contains(ind, F.lower(t)) | F.contains(F.lower(t), ind)))


def display_place(city: Column, state: Column) -> Column:
    return F.concat_ws(", ", blank_to_null(city), blank_to_null(state))


def snippet(text: Column, start: Column, end: Column, pad: int = fv.SNIPPET_PAD) -> Column:
    """Quote around [start, end) with `pad` characters each side, cut at whole words.

    Offsets are 0-based code points. An ellipsis marks each side that was cut.
    """
    def struct(**parts: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    bounds = struct(
        b=start, e=end, n=F.length(text), lo=F.greatest(F.lit(0), start - pad), hi=F.least(F.length(text), end + pad)
    )

    # first blank inside [lo, b): the quote starts right after it;
    # last blank inside (e, hi): the quote stops before it
    def cuts(w: Column) -> Column:
        lead = F.locate(" ", F.substring(text, w["lo"] + 1, w["b"] - w["lo"]))
        back = F.locate(" ", F.reverse(F.substring(text, w["e"] + 1, w["hi"] - w["e"])))
        return struct(e=w["e"], n=w["n"], lo=w["lo"], hi=w["hi"], lead=lead, back=back)

    def snapped(w: Column) -> Column:
        left = F.when((w["lo"] > 0) & (w["lead"] > 0), w["lo"] + w["lead"]).otherwise(w["lo"])
        inner = (w["back"] > 0) & (w["hi"] - w["back"] > w["e"])
        right = F.when((w["hi"] < w["n"]) & inner, w["hi"] - w["back"]).otherwise(w["hi"])
        return struct(left=left, right=right, n=w["n"])

    def quote(w: Column) -> Column:
        return F.concat(
            F.when(w["left"] > 0, "…").otherwise(""),
            F.trim(F.substring(text, w["left"] + 1, w["right"] - w["left"])),
            F.when(w["right"] < w["n"], "…").otherwise(""),
        )

    return let(let(let(bounds, cuts), snapped), quote)


def half_even_1dp(value: Column) -> Column:
    """Round a double to one decimal from its exact binary value, ties to even.

    bround() rounds the printed decimal, so 0.35 (stored as 0.34999..) would go up.
    x*10 is formed as x*8 + x*2 with its rounding error kept, which settles such near ties.
    """
    def terms(x: Column) -> Column:
        return F.struct((x * 8).alias("a"), (x * 2).alias("b"), (x * 8 + x * 2).alias("total"))

    def rounded(t: Column) -> Column:
        part = t["total"] - t["a"]
        err = (t["a"] - (t["total"] - part)) + (t["b"] - part)
        low = F.floor(t["total"]).cast("double")
        near_tie = (t["total"] - low) == 0.5
        return F.when(near_tie & (err < 0), low).when(near_tie & (err > 0), low + 1).otherwise(F.rint(t["total"])) / 10

    # far from a tie plain rounding is right, and stays in generated code
    tenfold = value * 10
    return F.when((tenfold - F.floor(tenfold)) == 0.5, let(let(value, terms), rounded)).otherwise(F.rint(tenfold) / 10)
