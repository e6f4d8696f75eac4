"""Raw HTML to text, titles, metas and links as Catalyst expressions."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadfit import fixed_values as fv
from leadfit.functions.text import as_col, blank_to_null, let

# Attribute text up to the closing bracket, quotes respected. The possessive loop runs
# iteratively, so a huge tag cannot exhaust the stack. A tag that never closes runs to the end of
# the page (END), so it is scanned once and not again from each bracket inside it.
ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
END = r"(?:>|\z)"
HIDDEN_TAGS = ["script", "style", "noscript", "svg", "template", "rt", "rp"]
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(
    rf"{tag}\b{ATTRS}{END}.*?(?:</{tag}\b[^>]*{END}|\z)" for tag in HIDDEN_TAGS
) + ")"
TAG = rf"(?s)<[a-zA-Z/!?]{ATTRS}>|<[a-zA-Z/!?][^>]*{END}"
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
META_TAG = rf"(?is)<meta\b{ATTRS}{END}"
ANCHOR = rf"(?is)<a(\s{ATTRS}){END}(.*?)(?:</a\s*>|\z)"
TITLE = rf"(?is)<title[^>]*{END}(.*?)(</title>|\z)"

# Named entities come from the standard library; codes 128-159 are read as Windows-1252.
_NAMED = {name: chr(code) for name, code in name2codepoint.items() if name != "amp"} | {"apos": "'"}
_LEGACY = {str(i): bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
_LEGACY = {k: v for k, v in _LEGACY.items() if v}


def _text_map(values: dict[str, str]) -> Column:
    """Constant map, folded to one literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _entity_char(entity: Column) -> Column:
    """Character of one reference such as &copy; or &#169; (itself when unknown)."""
    body = F.regexp_replace(entity, "[&;]", "")
    hexed = F.conv(F.regexp_extract(entity, "^&#[xX](.*);$", 1), 16, 10)
    code = F.coalesce(blank_to_null(F.regexp_extract(entity, "^&#([0-9]+);$", 1)), hexed).try_cast("int")

    def char(n: Column) -> Column:
        in_range = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.coalesce(
            F.try_element_at(_text_map(_LEGACY), n.cast("string")),
            F.when(in_range, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")),
        )

    return F.coalesce(
        F.when(entity.startswith("&#"), let(code, char)).otherwise(F.try_element_at(_text_map(_NAMED), body)), entity
    )


def decode_entities(text: Column) -> Column:
    """Replace character references; &amp; goes last so nothing is decoded twice."""
    def decoded(t: Column) -> Column:
        seen = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), 0)), lambda e: e != "&amp;")
        out = F.aggregate(seen, t, lambda acc, e: F.replace(acc, e, _entity_char(e)))
        return F.replace(out, F.lit("&amp;"), F.lit("&"))

    def when_any(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("&")), let(
            F.regexp_replace(t, r"&(?:#0*38|#[xX]0*26);", "&amp;"), decoded)).otherwise(t)

    return let(text, when_any)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_to_text(html: Column | str) -> Column:
    """Visible text: hidden elements and comments dropped, one blank between text nodes."""
    bare = F.regexp_replace(F.regexp_replace(as_col(html), HIDDEN, " "), TAG, " ")
    return collapse_space(decode_entities(bare))


def title_source(html: Column) -> Column:
    """Content of the first title element; '' where none is closed."""
    closed = F.regexp_extract(html, TITLE, 2) != ""
    return F.when(closed, F.regexp_extract(html, TITLE, 1)).otherwise(F.when(html.isNotNull(), ""))


def html_title(html: Column | str) -> Column:
    """Text of the first title element; NULL when there is none or it is empty."""
    raw = title_source(as_col(html))
    return blank_to_null(F.regexp_replace(decode_entities(raw), r"(?U)^\s+|\s+$", ""))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside a tag's text; '' when it is absent or empty."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']$""", "")


def meta_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(META_TAG), 0)


def _tag_with(tags: Column, attr: str, value: str) -> Column:
    """First tag whose attribute equals the value; NULL when none does."""
    return F.get(F.filter(tags, lambda t: attribute(t, attr) == value), F.lit(0))


def has_viewport(html: Column) -> Column:
    return _tag_with(meta_tags(html), "name", "viewport").isNotNull()


def meta_description(html: Column) -> Column:
    """Content of the description meta, else of og:description; NULL when empty."""
    def content(tags: Column) -> Column:
        tag = F.coalesce(_tag_with(tags, "name", "description"), _tag_with(tags, "property", "og:description"))
        return blank_to_null(decode_entities(attribute(tag, "content")))

    return let(meta_tags(html), content)


def page_description(meta: Column, text_head: Column) -> Column:
    """Meta description or the head of the page text, trimmed and capped."""
    source = F.coalesce(meta, text_head)
    return F.substring(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), 1, fv.DESCRIPTION_MAX_CHARS)


def anchors(html: Column | str) -> Column:
    """array<struct<href, inner>> of all links with a target, in document order."""
    whole = F.regexp_extract_all(as_col(html), F.lit(ANCHOR), 0)
    parts = F.transform(whole, lambda w: F.struct(
        F.regexp_extract(w, ANCHOR, 1).alias("attrs"), F.regexp_extract(w, ANCHOR, 2).alias("inner")))
    targeted = F.filter(parts, lambda x: F.regexp_like(x["attrs"], F.lit(r"(?i)[\s\"']href\s*=")))
    return F.transform(targeted, lambda x: F.struct(
        F.trim(decode_entities(attribute(x["attrs"], "href"))).alias("href"), x["inner"].alias("inner")))


def social_links(hrefs: Column) -> Column:
    """First link per network, by document order."""
    def first(seen: Column, net: str) -> Column:
        return F.get(F.filter(seen, lambda h: F.contains(h, F.lit(f"{net}.com"))), F.lit(0)).alias(net)

    return let(hrefs, lambda seen: F.struct(*[first(seen, net) for net in fv.SOCIAL_NETWORKS]))


# ---- urls --------------------------------------------------------------------

ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN + r"([^?#]*)", 2)


def _squeeze_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    def walked(parts: Column) -> Column:
        stack = F.aggregate(
            F.slice(parts, F.lit(2), F.size(parts)),
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(stack, tail), "/"))

    return let(path, lambda p: F.when(
        p.startswith("/") & p.contains("/."), let(F.split(p, "/"), walked)).otherwise(p))


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link found on `base`, fragment dropped."""
    origin = F.regexp_extract(base, ORIGIN, 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    base_path = url_path(base)

    def joined(bare: Column) -> Column:
        path = F.regexp_extract(bare, r"^([^?]*)", 1)
        query = F.regexp_extract(bare, r"^[^?]*(\?.*)$", 1)
        folder = F.coalesce(blank_to_null(F.regexp_replace(base_path, "[^/]*$", "")), F.lit("/"))
        full_path = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
        return (
            F.when(bare == "", F.substring_index(base, "#", 1))
            .when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), bare)
            .when(bare.startswith("//"), F.concat(scheme, bare))
            .when(bare.startswith("?"), F.concat(origin, base_path, bare))
            .otherwise(F.concat(origin, _squeeze_dots(full_path), query))
        )

    return let(F.substring_index(href, "#", 1), joined)


def site_host(url: Column) -> Column:
    """Lower-case host of an http(s) url without one leading 'www.'; NULL for other schemes."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return blank_to_null(F.regexp_replace(host, r"^www\.", ""))


def url_key(url: Column) -> Column:
    """Join key of a page: host without www, path without closing slash, query."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = let(F.regexp_replace(url_path(url), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    return F.concat(site_host(url), path, query)


def page_links(html: Column, base: Column, domain: Column) -> Column:
    """array<struct<url, path, haystack>> of links that stay on the site and leave its home page."""
    resolved = F.transform(
        anchors(html),
        lambda a: F.struct(resolve_url(a["href"], base).alias("url"), a["inner"].alias("inner")),
    )
    placed = F.transform(resolved, lambda a: F.struct(
        a["url"].alias("url"), url_path(a["url"]).alias("path"), a["inner"].alias("inner")))
    inside = F.filter(placed, lambda a: (site_host(a["url"]) == domain) & ~a["path"].isin("", "/"))
    return F.transform(inside, lambda a: F.struct(
        a["url"].alias("url"), F.concat(a["path"], F.lit(" "), html_to_text(a["inner"])).alias("haystack")))


def is_page_kind(haystack: Column, kind: str) -> Column:
    return haystack.rlike("(?i)" + fv.LINK_PATTERNS[kind])


def first_link_per_kind(links: Column) -> Column:
    """struct<about, services, contact, careers> of the first fitting link each."""
    def first(kind: str) -> Column:
        return F.get(F.filter(links, lambda x: is_page_kind(x["haystack"], kind)), F.lit(0))["url"].alias(kind)

    return F.struct(*[first(kind) for kind in fv.LINK_PATTERNS])


def page_kind_links(html: Column, base: Column, domain: Column) -> Column:
    return let(page_links(html, base, domain), first_link_per_kind)


# ---- fetch results -------------------------------------------------------------

def is_blocked(status: Column, html: Column) -> Column:
    """Bot wall: refused status with a challenge in the body, or a telling title."""
    refused = status.isin(fv.BLOCK_STATUSES) & html.rlike("(?i)" + fv.BLOCK_BODY)
    title = title_source(html)
    return F.coalesce(refused | title.rlike("(?i)" + fv.BLOCK_TITLES), F.lit(False))


def fetch_ok(status: Column, blocked: Column, html: Column) -> Column:
    return F.coalesce(status.between(200, 299) & ~blocked & (F.length(html) > 0), F.lit(False))


def html_only(html: Column, content_type: Column) -> Column:
    """The whole body when the type says html or nothing at all; else ''."""
    wanted = F.coalesce(content_type, F.lit("")) == ""
    return F.when(wanted | content_type.contains("html"), html).otherwise("")
