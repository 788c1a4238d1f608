"""URL functions as native columns, so that filters on them reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: RFC 3986, appendix B: scheme, authority, path, query.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, SPLIT, n)


def query_escape(text: Column) -> Column:
    """Form encoding that keeps ``-_.~`` and turns a space into ``+``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _unparsable(url: Column) -> Column:
    """Control characters, a bad escape outside the query, or a space in the authority."""
    outside = F.concat(F.substring_index(url, "?", 1), F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, r"(?s)(#.*)$", 1)).otherwise(F.lit("")))
    return url.rlike(r"[\x00-\x1F\x7F]") | outside.rlike(r"%(?![0-9A-Fa-f]{2})") | _part(url, 2).contains(" ") | url.startswith(":")


#: Urls that are normal as they are: no query, fragment, escape, blank or trailing slash, and a plain authority.
NORMAL = r"^https?://[^/?#%@\x00-\x20\x7F]+(?:/[^?#%\x00-\x20\x7F]*[^/?#%\x00-\x20\x7F])?$"


def normalize_url(url: Column) -> Column:
    """Drops the fragment and ``utm_`` parameters, sorts the others by key, strips trailing slashes; unparsable: empty. Most links are normal, which one pattern tells."""
    return F.when(url.rlike(NORMAL), url).otherwise(_normalized(url))


def _normalized(url: Column) -> Column:
    query = _part(url, 4)
    split = F.transform(
        F.split(query, "&", -1),
        lambda x, i: F.struct(
            F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(F.lit(""))).alias("v"),
            x.alias("raw"),
        ),
    )
    kept = F.filter(split, lambda x: (x["raw"] != "") & ~F.contains(x["raw"], F.lit(";")) & x["k"].isNotNull() & x["v"].isNotNull() & ~F.startswith(x["k"], F.lit("utm_")))
    pairs = F.transform(F.array_sort(kept), lambda x: F.concat(query_escape(x["k"]), F.lit("="), query_escape(x["v"])))
    rebuilt = F.array_join(pairs, "&")
    bare = F.regexp_replace(url, "(?s)#.*$", "").rlike(r"(?s)^[^?]*\?$")
    scheme = _part(url, 1)
    authority = F.when(url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), F.concat(F.lit("//"), _part(url, 2))).otherwise(F.lit(""))
    out = F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
        authority,
        F.replace(_part(url, 3), F.lit(" "), F.lit("%20")),
        F.when((rebuilt != "") | bare, F.concat(F.lit("?"), rebuilt)).otherwise(F.lit("")),
    )
    return F.when(_unparsable(url), F.lit("")).otherwise(F.regexp_replace(out, "/+$", ""))


def url_host(url: Column) -> Column:
    """Host name without user and port, case as it is."""
    return F.regexp_extract(F.regexp_replace(_part(url, 2), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)


def url_path(url: Column) -> Column:
    """Decoded path; only ``%`` escapes are decoded."""
    return F.try_url_decode(F.replace(_part(url, 3), F.lit("+"), F.lit("%2B")))


def is_bare_domain(url: Column) -> Column:
    return _part(url, 3).isin("", "/")


def llms_url(url: Column) -> Column:
    """Where a site's llms.txt would be."""
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), F.regexp_replace(_part(url, 2), "^.*@", ""), F.lit("/llms.txt"))


def unwrap_redirect(href: Column) -> Column:
    """The decoded ``uddg`` target of a result link, or the link as it is."""
    target = F.try_url_decode(F.regexp_extract(href, r"[?&]uddg=([^&#]*)", 1))
    return F.coalesce(F.when(target != "", target), href)


def resolvable(href: Column) -> Column:
    """Links that can lead to a page: no script, mail, phone or fragment links."""
    bad = href == ""
    for p in ("javascript:", "mailto:", "tel:", "#"):
        bad = bad | F.startswith(href, F.lit(p))
    return ~bad


def code_permalink(base: Column, repo: Column, path: Column, line: Column) -> Column:
    return F.concat(base, F.lit("/"), repo, F.lit("/-/blob/"), path, F.lit("#L"), line.cast("string"))


def build_query(backend: str, query: Column, lang: Column) -> Column:
    """The query as a code search backend wants it."""
    lang = F.coalesce(lang, F.lit(""))
    if backend == "github":
        return F.when((lang != "") & ~F.contains(query, F.lit("language:")), F.concat(query, F.lit(" language:"), lang)).otherwise(query)
    out = F.when(lang != "", F.concat(query, F.lit(" lang:"), lang)).otherwise(query)
    for word in ("archived", "fork"):
        out = F.when(F.contains(query, F.lit(f"{word}:")), out).otherwise(F.concat(out, F.lit(f" {word}:no")))
    return out


__all__ = [
    "build_query", "code_permalink", "is_bare_domain", "llms_url", "normalize_url", "query_escape", "resolvable", "unwrap_redirect", "url_host", "url_path",
]
