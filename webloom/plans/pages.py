"""Whole plans over a page snapshot, made of the functions and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions import urls as U


def host_report(pages: DataFrame) -> DataFrame:
    """``(host, pages, title_words, visible_words)``: one parse a page, one shuffle of four columns a host."""
    page = pages.select(U.normalize_url(F.col("url")).alias("url"), H.html_signals(F.col("html")).alias("s"))
    rows = page.select(U.url_host(F.col("url")).alias("host"), "url", T.word_count(F.col("s.title")).alias("tw"), F.col("s.visible_words").alias("vw"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("tw").alias("title_words"), F.sum("vw").alias("visible_words"))


def readable_pages(pages: DataFrame, trim: bool = True, max_chars: int = 0) -> DataFrame:
    """``(url, title, markdown, content_hash, words)`` of pages that aren't shells: one parse detects and extracts, then post-process and hash."""
    seen = pages.withColumn("p", H.read_page(F.col("url"), F.col("html"), "signals", "main"))
    kept = seen.where(H.detect_js_shell(F.col("p"), F.col("html")) != "likely_shell")
    text = T.post_process(F.col("p.markdown"), trim, max_chars)
    return kept.select("url", "p.title", text.alias("markdown"), T.content_hash(text).alias("content_hash"), T.word_count(text).alias("words"))
