"""The functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, markdown
from webloom.functions.htmltree import parse, title_of
from webloom.session import ship_package

#: name -> (parameters, body): expressions that Catalyst inlines.
_TEXT = {
    "word_count": ("s STRING", "regexp_count(s, '[^\\\\t-\\\\r \\\\x85\\\\xA0\\\\x{1680}\\\\x{2000}-\\\\x{200A}\\\\x{2028}\\\\x{2029}\\\\x{202F}\\\\x{205F}\\\\x{3000}]+')"),
    "content_hash": ("s STRING", "substring(sha2(s, 256), 1, 16)"),
    "cache_key": ("s STRING", "substring(sha2(s, 256), 1, 16)"),
    "truncate_content": ("s STRING, n INT", "CASE WHEN n > 0 AND length(s) > n THEN concat(substring(s, 1, n), '\\n\\n[truncated]') ELSE s END"),
}


class _Links:
    """One row for each link of a page."""

    def eval(self, page: str, base: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(html.links_of(page or "", base or ""))


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL: native bodies as SQL functions, parsers as Arrow UDFs, links as a table function."""
    ship_package(spark)
    for name, (params, body) in _TEXT.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")

    spark.udf.register("html_title", F.pandas_udf(_titles, "string"))
    spark.udf.register("html_to_markdown", F.pandas_udf(_markdowns, "string"))
    spark.udf.register("html_signals", F.pandas_udf(_signals, html.SIGNALS))
    spark.udtf.register("extract_links", F.udtf(_Links, returnType="pos int, link string"))


def _titles(s: pd.Series) -> pd.Series:
    return pd.Series([title_of(parse(x or "")) for x in s])


def _markdowns(s: pd.Series) -> pd.Series:
    return pd.Series([markdown.to_markdown(parse(x or "")) for x in s])


def _signals(s: pd.Series) -> pd.DataFrame:
    return html.signal_rows(s)
