"""Parts of URLs and of HTML, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that say where a visitor came from, not what the page is. Fixed values.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
#: Scripts, styles and comments.
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
#: A character reference: decimal, hexadecimal or by name.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
#: References by name that most pages have, but for the one to "&" itself.
COMMON = ("lt", "gt", "quot", "nbsp", "copy", "middot")
#: A link's address, with its quotes if it has any.
HREF = r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, www. and m. off the host, no fragment, no tracking parameters, no slash at the end."""
    out = F.regexp_replace(url, r"#.*$", "")
    out = F.concat(F.lit("https://"), F.regexp_replace(host(out), r"^(www|m)\.", ""), F.regexp_extract(out, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1))
    out = F.regexp_replace(out, rf"([?&]){TRACKING}=[^&]*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"&&+", "&"), r"\?&", "?")
    return F.regexp_replace(F.regexp_replace(out, r"[?&]+$", ""), r"/+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _character(reference: Column) -> Column:
    """The character of a reference; a replacement character for numbers that are none, null for unknown names."""
    named = F.element_at(F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (f"&{name};", chr(code)))), reference)
    digits = F.regexp_extract(reference, "([0-9a-fA-F]+);", 1)
    code = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    return F.when(reference.startswith("&#"), number).otherwise(named)


def decoded(text: Column) -> Column:
    """text with its character references replaced, each once; unknown ones stay. A space that must not break is a space.

    The common ones are replaced first, as none of their characters can be part of another reference; texts that have others
    than these and "&amp;" are taken apart for them.
    """
    for name in COMMON:
        text = F.replace(text, F.lit(f"&{name};"), F.lit(chr(name2codepoint[name])))

    def rest(t: Column) -> Column:
        between, found = F.split(t, REFERENCE), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        pieces = F.zip_with(between, found, lambda t, r: F.concat(t, F.coalesce(_character(r), r, F.lit(""))))
        others = F.regexp_like(t, F.lit(REFERENCE.replace("&", "&(?!amp;)", 1)))
        return F.when(others, F.array_join(pieces, "")).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))

    return F.replace(_let(text, rest), F.lit("\u00a0"), F.lit(" "))


def plain_text(html: Column) -> Column:
    """All text of a page: no scripts, styles, comments and tags, white space as one space."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(out, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def title(html: Column) -> Column:
    return decoded(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    """Addresses of the links of a page, quoted in either way or not at all; those in scripts, styles and comments are none."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), F.lit(HREF), F.lit(1))
    return F.transform(found, lambda h: decoded(F.regexp_replace(h, r"""^["']|["']$""", "")))


def resolved(base: Column, href: Column) -> Column:
    """A link as a URL: absolute ones as they are, those from the root at the base's host, others beside the base."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_extract(path(base), r"^(.*/)", 1))
    return (
        F.when(F.regexp_like(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )
