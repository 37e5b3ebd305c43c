"""URL expressions: admissibility, normalisation, hosts, composition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed marks of handbook links and of links that are never followed.
HANDBOOK_MARKS = ("mhb", "modulhandb", "modulhandbuch", "modulbeschreibung")
SKIPPED_SCHEMES = ("javascript:", "mailto:", "tel:", "data:")
# Fixed public suffixes of two labels; every other suffix is taken as the last label.
TWO_LABEL_SUFFIXES = ("ac.at", "ac.uk", "co.at", "co.uk", "edu.au", "com.au", "edu.tr", "ac.jp", "co.jp", "edu.pl")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_keyword(url: Column, keywords: Sequence[str] = HANDBOOK_MARKS) -> Column:
    """Case-sensitive: any keyword occurs in the URL."""
    return any_of([F.contains(url, F.lit(k)) for k in keywords])


def is_handbook_file(url: Column, keywords: Sequence[str] = ("mhb", "modulhandb"), suffix: str = "pdf") -> Column:
    """Any keyword in the lower-cased URL and the file kind in the URL as written."""
    return has_keyword(F.lower(url), keywords) & F.contains(url, F.lit(suffix))


def is_admissible(url: Column, prefix: str, suffix: str = ".pdf", blocked: str = "redirect", longest: int = 500) -> Column:
    return (
        url.startswith(prefix) & url.endswith(suffix) & ~F.contains(url, F.lit(blocked)) & (F.length(url) <= longest)
    )


def bare_host(url: Column) -> Column:
    """URL without scheme, ``www.`` and everything from the first slash on."""
    short = F.when(url.startswith("https://www."), F.substr(url, F.lit(len("https://www.") + 1))).otherwise(url)
    short = F.when(short.startswith("http://"), F.substr(short, F.lit(len("http://") + 1))).otherwise(short)
    return F.substring_index(short, "/", 1)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path."""
    segments = F.split(path, "/")
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.least(F.size(done), F.lit(1))))
        )
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    plain = ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(plain, path).otherwise(F.concat(F.array_join(resolved, "/"), tail))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_query = F.regexp_extract(href, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, _without_dots(href_path), href_query))
        .when(href == "", F.concat(origin, path, query))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, href_path)), href_query))
    )


def normalize_href(base: Column, href: Column, host: Column) -> Column:
    """Absolute http(s) link without fragment whose text contains ``host``, else NULL."""
    link = F.trim(href)
    usable = (link != "") & ~link.startswith("#") & ~any_of(
        [F.lower(link).startswith(scheme) for scheme in SKIPPED_SCHEMES]
    )
    full = resolve(base, F.substring_index(link, "#", 1))
    return F.when(usable & full.rlike(r"(?i)^https?:") & F.contains(full, host), full)


def registered_domain(url: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Domain and public suffix of a URL's host; the URL itself when the host has no suffix."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    numeric = host.rlike(r"^[0-9.]+$")
    wide = F.substring_index(host, ".", -2).isin(*suffixes)
    domain = F.when(wide, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(F.contains(host, F.lit(".")) & ~numeric & (~wide | (F.size(F.split(host, r"\.")) > 2)), domain).otherwise(url)


def query_url(base: str, parts: Sequence[Column], closing: str) -> Column:
    """Search URL with blanks of every part written as ``+``."""
    return F.concat(F.lit(base), F.concat_ws("+", *[F.replace(p, F.lit(" "), F.lit("+")) for p in parts], F.lit(closing)))


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def percent_decode(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def download_name(url: Column, header_name: Column) -> Column:
    """File name from the URL's last folder and the name sent by the server, quotes dropped."""
    folder = F.translate(F.try_element_at(F.split(url, "/"), F.lit(-2)), "+ ", "__")
    return F.concat(folder, F.lit("__"), F.replace(header_name, F.lit('"'), F.lit("")))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)
