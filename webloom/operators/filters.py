"""URL filters of a crawl, as one native predicate."""

from __future__ import annotations

import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import url_host, url_path


def same_host(url: Column, host: str) -> Column:
    """Exact host name, case and all; port and scheme don't matter, subdomains are other hosts."""
    return url_host(url) == F.lit(host)


def validate_deny(patterns: Sequence[str]) -> None:
    """Raises for a pattern that Java, which matches it, can't compile, or that needs what linear-time engines lack."""
    jvm = SparkContext._active_spark_context._jvm
    for p in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(p)
        except (Py4JJavaError, PySparkException) as e:
            raise ValueError(f"invalid deny pattern {p!r}: {str(e).splitlines()[0]}") from e
        if re.search(r"\(\?[=!<](?!P)|\\[1-9]", p):
            raise ValueError(f"invalid deny pattern {p!r}: no look-around and no back-references")


def denied(url: Column, patterns: Sequence[str]) -> Column:
    """Any pattern found anywhere in the url."""
    out = F.lit(False)
    for p in patterns:
        out = out | url.rlike(p)
    return out


def allowed(url: Column, parts: Sequence[str]) -> Column:
    """Any part stands in the decoded path; without parts everything is allowed."""
    if not parts:
        return F.lit(True)
    path, out = url_path(url), F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p))
    return F.coalesce(out, F.lit(False))


def passes_filters(url: Column, seed_host: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    validate_deny(deny)
    return same_host(url, seed_host) & ~denied(url, deny) & allowed(url, allow)
