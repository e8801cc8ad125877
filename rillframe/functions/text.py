"""Scalar text functions: codes, versions, hosts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def station_code(office: Column, kind: Column, station: Column) -> Column:
    """Thirteen digits: 5 + 3 + 5, zero-filled; longer parts are kept whole."""
    fill = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat(fill(office, 5), fill(kind, 3), fill(station, 5))


def present(c: Column) -> Column:
    """Trimmed text; blank counts as absent."""
    return F.nullif(F.trim(c), F.lit(""))


def content_version(*columns: str) -> Column:
    """First twelve hexadecimal digits of the SHA-256 of the values, joined by a bar; nulls are spelt out."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256), 1, 12)


def host(url: Column) -> Column:
    """Host of a URL without www."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")


def image_stem(name: Column) -> Column:
    """File name without (repeated) image endings."""
    return F.regexp_replace(name, r"(?i)(\.(png|jpg|jpeg|webp))+$", "")


def grouped(value: Column) -> Column:
    """Thousands grouped, no trailing zeros."""
    return F.call_function("format_number", value, F.lit("#,##0.##########"))


def area_label(km2: Column) -> Column:
    return F.when(km2 < 10, F.format_string("%.1f", km2)).otherwise(F.call_function("format_number", km2, F.lit("#,##0")))


def distance_label(metres: Column) -> Column:
    """here under 50 m, kilometres from 1,000 m."""
    return F.when(metres < 50, "here").when(metres >= 1000, F.concat(F.format_string("%.1f", metres / 1000.0), F.lit(" km"))).otherwise(F.concat(metres.cast("string"), F.lit(" m")))


def html_escape(c: Column) -> Column:
    """The five markup characters; the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def url_quote(c: Column) -> Column:
    """Percent encoding of all but letters, digits and ``-_.~``."""
    c = F.url_encode(c)
    for form, safe in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(form), F.lit(safe))
    return c


def slug_id(area: Column, slug: Column, fallback: Column) -> Column:
    """area-slug; a blank area is ``unknown``, a blank slug gives way to the fallback."""
    return F.concat_ws("-", F.coalesce(present(area), F.lit("unknown")), F.coalesce(present(slug), fallback.cast("string")))


def _decimal(c: Column) -> Column:
    return c.cast("decimal(24, 6)")


def plain_number(c: Column) -> Column:
    """Thousands grouped, at most six decimals, no trailing zeros; half up on the decimal digits."""
    return grouped(_decimal(c))


def flow_label(m3s: Column) -> Column:
    return F.concat(plain_number(m3s), F.lit(" m3/s"))


def level_label(metres: Column) -> Column:
    return F.concat(F.lit("EL "), plain_number(metres), F.lit(" m"))


def storage_label(thousand_m3: Column) -> Column:
    """Cubic metres, from ten thousand on in units of ten thousand; the input counts thousands."""
    d = _decimal(thousand_m3)
    return F.when(F.abs(d) >= 10, F.concat(grouped(d / 10), F.lit(" x 10,000 m3"))).otherwise(F.concat(grouped(d * 1000), F.lit(" m3")))


#: Form of an observation time as it is delivered.
OBSERVED = "yyyy/MM/dd HH:mm"


def date_label(text: Column) -> Column:
    """The time without leading zeros in month and day; what is no time stays as it is, blank is null."""
    t = F.try_to_timestamp(text, F.lit(OBSERVED))
    return F.coalesce(F.date_format(t, "yyyy/M/d HH:mm"), F.nullif(text, F.lit("")))


def date_iso(text: Column, offset: str = "+09:00") -> Column:
    """ISO 8601 with the given offset; null where it is no time."""
    return F.concat(F.date_format(F.try_to_timestamp(text, F.lit(OBSERVED)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def percent_error(a: Column, b: Column, digits: int = 1) -> Column:
    """(a / b - 1) * 100; null without both, or where one is zero."""
    return F.when((a != 0) & (b != 0), F.round((a / b - 1) * 100, digits))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def number(c: Column) -> Column:
    """A number in a text; blank or unreadable text is null."""
    return F.trim(c).try_cast("double")


#: Short and long wording of a status; the empty key stands for anything else.
STATUS_WORDS = {
    "not_provided": ("not provided", "not provided by the present source"),
    "missing": ("missing", "no reading for this time"),
    "closed": ("closed", "the station is marked closed"),
    "no_source": ("no source", "no source is set"),
    "fetch_failed": ("failed", "the source could not be read"),
    "": ("no value", "there is no value"),
}


def status_words(status: Column, long: bool = False) -> Column:
    words = F.create_map(*[F.lit(x) for k, v in STATUS_WORDS.items() if k for x in (k, v[long])])
    return F.coalesce(F.try_element_at(words, F.coalesce(status, F.lit(""))), F.lit(STATUS_WORDS[""][long]))


def asset_version(body: Column, blank: str) -> Column:
    """Ten digits of the SHA-256 of a text with line feeds alone and without what ``blank`` matches (its own versions)."""
    return F.substring(F.sha2(F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), blank, ""), 256), 1, 10)


def packed(c: Column) -> Column:
    """Base64 of bytes or of a text in UTF-8, in one line."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")
