"""Scalar operators as Column -> Column. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Sorted distinct matches; empty for null."""
    return F.coalesce(F.array_sort(F.array_distinct(_all(text, pattern, group))), F.array().cast("array<string>"))


def clean_url(u: Column) -> Column:
    """Cut at the first "<", then drop trailing punctuation and quotes."""
    return F.regexp_replace(F.substring_index(u, "<", 1), r"""[.,;:)\]}>"']+\z""", "")


def strip_trailing(u: Column) -> Column:
    """Drop trailing punctuation as after Markdown links."""
    return F.regexp_replace(u, r"""[.,;:!?)\]}'"]+\z""", "")


EDGE = ".,;:!?) ]"


def strip_edges(u: Column) -> Column:
    return F.btrim(u, F.lit(EDGE))


def strip_right(u: Column) -> Column:
    return F.rtrim(u, F.lit(EDGE))


def sanitize(text: Column) -> Column:
    """Characters other than printable ASCII, tab and line ends become spaces."""
    return F.regexp_replace(text, r"[^\x20-\x7E\t\n\r]", " ")


def netloc(u: Column) -> Column:
    """Authority with user info and port, case kept; empty without "//"."""
    return F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def coverage_scheme(u: Column) -> Column:
    """Scheme, with "none" for the empty one."""
    return F.when(scheme(u) == "", F.lit("none")).otherwise(scheme(u))


def id_from_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"^([a-z][a-z\-]+)(\d{7})$", "$1/$2")


def safe_name(doc_id: Column) -> Column:
    return F.replace(doc_id, F.lit("/"), F.lit("_"))


def from_safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^([^_]*)_", "$1/")


def _two_digits(doc_id: Column) -> Column:
    return F.when(doc_id.contains("/"), F.regexp_extract(doc_id, r"/(\d\d)", 1)).otherwise(F.regexp_extract(doc_id, r"^(\d\d)", 1)).try_cast("int")


def year_by_pivot(doc_id: Column, pivot: int, above: bool = False) -> Column:
    """Year of an id's two digits: 19yy from the pivot on (``above``: beyond it), else 20yy; null without digits."""
    yy = _two_digits(doc_id)
    return F.when(yy > pivot if above else yy >= pivot, 1900 + yy).otherwise(2000 + yy)


def year_or_unknown(doc_id: Column) -> Column:
    """Pivot 90 as text, "Unknown" for ids that have neither "/" nor "." or no digits."""
    ok = doc_id.contains("/") | doc_id.contains(".")
    return F.when(ok, F.coalesce(year_by_pivot(doc_id, 90).cast("string"), F.lit("Unknown"))).otherwise(F.lit("Unknown"))


def year_of_tei_id(doc_id: Column) -> Column:
    return year_by_pivot(doc_id, 50, above=True)


def year_of_html_id(doc_id: Column) -> Column:
    """New ids are always 20yy; old ones need seven digits and turn at 91; others "unknown_year"."""
    new = F.regexp_extract(doc_id, r"^(\d\d)\d\d\.", 1)
    old = F.regexp_extract(doc_id, r"(?:^|\D)(\d\d)\d{5}$", 1)
    yy = old.try_cast("int")
    old_year = F.when(yy >= 91, 1900 + yy).otherwise(2000 + yy).cast("string")
    return F.when(new != "", F.concat(F.lit("20"), new)).when(old != "", old_year).otherwise(F.lit("unknown_year"))


def split_multi(x: Column) -> Column:
    """Parts between semicolons, trimmed."""
    return F.transform(F.split(x, ";"), lambda x: F.trim(x))


def split_quoted(x: Column) -> Column:
    """Comma-separated parts, where double quotes protect commas; empty for null."""
    parts = F.transform(_all(x, r'"[^"]+"|[^,]+'), lambda p: F.trim(F.btrim(p, F.lit('"'))))
    return F.coalesce(parts, F.array().cast("array<string>"))


def split_plain(x: Column) -> Column:
    return F.transform(F.split(x, ","), lambda x: F.trim(x))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = 1.0, price_out: float = 5.0) -> Column:
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dd %dh %dm", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60))


def rate_per_minute(n: Column, seconds: Column) -> Column:
    return F.coalesce(F.try_divide(n * 60.0, seconds), F.lit(0.0))


def missing_styles(log: Column) -> Column:
    return find_all(log, P.MISSING_STYLE, 1)


def is_noise(u: Column) -> Column:
    return F.lower(u).rlike(P.NOISE)


def is_self_reference_html(u: Column, doc_id: Column) -> Column:
    own = F.lit(False)
    for kind in ("abs", "pdf", "html"):
        own = own | (F.instr(u, F.concat(F.lit(f"arxiv.org/{kind}/"), doc_id)) > 0)
    return own | u.contains("#")


def is_self_reference_text(u: Column, doc_id: Column) -> Column:
    base = F.regexp_replace(doc_id, r"v\d+$", "")
    quoted = F.concat(F.lit("\\Q"), base, F.lit("\\E"))
    pattern = F.when(base.contains("/"), F.concat(F.lit(r"arxiv\.org/.+/"), quoted)).otherwise(F.concat(F.lit(r"arxiv\.org/(?:abs|pdf|html|ps)/"), quoted))
    return F.rlike(u, pattern)


def keeps_tei_target(u: Column, corpus: bool = False) -> Column:
    """Targets that are links: not empty, without "tei", no fragment; for the corpus not the converter's own page."""
    ok = (u != "") & ~F.lower(u).contains("tei") & ~u.startswith("#")
    return ok & (F.lower(F.trim(u)) != P.CONVERTER_URL) if corpus else ok


def keeps_link_uri(u: Column) -> Column:
    return u.startswith("http") | u.startswith("git")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as Python's ``round`` does it: by its exact binary value, halves to even.

    The product with the power of ten is taken with its rounding error, from halves of the factor's digits, so that a half in
    the product is told from what only looks like one."""
    power = float(10**digits)
    big = x * 134217729.0
    high = big - (big - x)
    product = x * power
    error = (high * power - product) + (x - high) * power
    below = F.floor(product)
    half = product - below == 0.5
    up = F.when(half & (error == 0), below % 2 == 1).when(half, error > 0).otherwise(product - below > 0.5)
    return (below + up.cast("int")) / power


def is_missing(x: Column) -> Column:
    """Null, or a text that spells "nan" in any case."""
    return x.isNull() | (F.lower(x.cast("string")) == "nan")
