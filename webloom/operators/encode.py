"""Output encoders: pages and results as text, TSV and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import first_line, format_bytes, word_count


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def page_text(url: Column, title: Column, body: Column, extra: Sequence[tuple[str, Column]] = ()) -> Column:
    """Front matter and body; ``extra`` fields follow the word count (a crawl's status and source)."""
    return _lines("---", _field("url", url), _field("title", title), _field("words", word_count(body)), *[_field(k, v) for k, v in extra], "---", body)


def crawl_text(url: Column, title: Column, body: Column, status: Column, source: Column) -> Column:
    return page_text(url, title, body, (("status", status), ("source", source)))


def escaped_json(json: Column) -> Column:
    """JSON that is safe inside HTML: ``<``, ``>``, ``&`` and the two line separators as escapes."""
    out = json
    for ch, code in (("<", "003c"), (">", "003e"), ("&", "0026"), (" ", "2028"), (" ", "2029")):
        out = F.replace(out, F.lit(ch), F.lit(f"\\u{code}"))
    return out


def crawl_json(url: Column, title: Column, body: Column, status: Column, source: Column) -> Column:
    """One object a page."""
    row = F.struct(url.alias("url"), title.alias("title"), word_count(body).alias("words"), status.alias("status"), source.alias("source"), body.alias("body"))
    return escaped_json(F.to_json(row))


def json_array(pages: DataFrame, idx: str, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """``(json)``: all rows without error as one array in input order; failures are left out. ``by`` gives an array for each of its values, in a column of its name.

    An array is one cell, so for the results of a question or of a batch; see :func:`json_array_lines` for a whole table.
    """
    rows = F.array_sort(F.collect_list(F.struct(idx, F.struct(*columns).alias("o"))))
    return pages.where("error is null").groupBy(*([by] if by else [])).agg(escaped_json(F.to_json(F.transform(rows, lambda x: x["o"]))).alias("json"))


def json_array_lines(pages: DataFrame, idx: str, columns: Sequence[str]) -> DataFrame:
    """``(line)`` in order: the array of :func:`json_array` with one object a line, brackets on lines of their own, so that no task holds it all.

    The rows are sorted in ranges; written as text, the files in order are the array. The driver sees the least ``idx`` alone.
    """
    good = pages.where("error is null")
    least = good.agg(F.min(idx)).first()[0]
    comma = F.when(F.col(idx) == F.lit(least), F.lit("")).otherwise(F.lit(","))
    rows = good.select(F.lit(1).alias("part"), F.col(idx).alias("at"), F.concat(comma, escaped_json(F.to_json(F.struct(*columns)))).alias("line"))
    ends = pages.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, line string").select("part", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "line")
    return rows.unionByName(ends).orderBy("part", "at", "line").select("line")


def tsv(*fields: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields])


def search_line(url: Column, title: Column, text: Column) -> Column:
    return tsv(url, title, text)


def code_line(url: Column, repo: Column, snippet: Column) -> Column:
    return tsv(url, repo, first_line(snippet))


docs_line = code_line


def header(fields: Sequence[tuple[str, Column]]) -> Column:
    """Front matter of a result list; null fields are left out."""
    return _lines("---", *[F.when(v.isNotNull(), _field(k, v)) for k, v in fields], "---")


def search_entry(title: Column, url: Column, description: Column) -> Column:
    return F.concat(title, F.lit("\n  "), url, F.when(description != "", F.concat(F.lit("\n  "), description)).otherwise(F.lit("")), F.lit("\n"))


def code_entry(repo: Column, path: Column, line: Column, stars: Column, snippet: Column, url: Column) -> Column:
    place = F.when(line > 0, F.concat(F.lit("  (line "), line.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    star = F.when(stars > 0, F.concat(F.lit("  ★ "), stars.cast("string"))).otherwise(F.lit(""))
    body = F.when(snippet != "", F.concat(F.lit("\n  "), snippet)).otherwise(F.lit(""))
    return F.concat(repo, F.lit("  "), path, place, star, body, F.lit("\n  "), url, F.lit("\n"))


def docs_entry(title: Column, breadcrumb: Column, snippet: Column, url: Column) -> Column:
    label = F.coalesce(F.nullif(breadcrumb, F.lit("")), title)
    return F.concat(F.lit("["), label, F.lit("]\n  "), snippet, F.lit("\n  source: "), url, F.lit("\n"))


def summary_text(seed: Column, row: Sequence[str] = ("pages", "new", "changed", "unchanged", "errors"), seconds: Column | None = None) -> Column:
    """A crawl's closing summary over a counters row."""
    took = F.format_string("%.1fs", F.lit(0.0) if seconds is None else seconds)
    return _lines("---", _field("seed", seed), *[_field(k, F.col(k)) for k in row], _field("duration", took), "---")


def status_line(job: Column, status: Column, seed: Column, pages: Column, updated: Column) -> Column:
    """A job's line in the table of crawls."""
    return F.format_string("%s  %-9s  %-40s  pages=%-5d  %s", job, status, seed, pages, updated)


def status_text(fields: Sequence[str], error: Column) -> Column:
    return _lines("---", *[_field(k, F.col(k)) for k in fields], F.when(error != "", _field("error", error)), "---")


def cache_text(path: str, entries: Column, size: Column, ttl: str) -> Column:
    return _lines("---", f"path: {path}", _field("entries", entries), _field("size", format_bytes(size)), f"ttl: {ttl}", "---")
