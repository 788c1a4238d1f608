"""HTML functions: one Arrow UDF parses a page, native columns decide on what it gives."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from webloom.functions import markdown
from webloom.functions.htmltree import Node, parse, squeeze, title_of
from webloom.functions.selectors import select
from webloom.functions.urls import resolvable
from webloom.session import ship_package

VISIBLE = set("p article main section h1 h2 h3 h4 h5 h6 li td th dd dt blockquote".split())
MEANINGFUL = set("p li h1 h2 h3 h4 h5 h6 td blockquote dd".split())
#: What single-page frameworks leave in a page's source, in lower case.
SPA_MARKERS = (
    'id="__next"', "id='__next'", 'id="__nuxt"', "id='__nuxt'", "data-reactroot", "ng-version=", "<app-root", 'id="___gatsby"', "id='___gatsby'", "__next_data__", "__nuxt__",
)
#: How a page says that it needs JavaScript.
NEEDS_JS = ("enable javascript", "requires javascript", "ensure javascript", "javascript is required", "javascript is disabled")

SIGNALS = "visible_bytes int, visible_words int, meaningful int, noscript_js boolean, needs_js boolean, loading boolean, script_bytes int, title string"


def _tree(page: str | Node) -> Node:
    return page if isinstance(page, Node) else parse(page)


def signals_of(page: str | Node) -> dict:
    """Everything that detection asks of a page's tree; nested elements count again, as each match does."""
    root = _tree(page)
    visible, meaningful, scripts, noscript = [], 0, 0, False
    body: Node | None = None
    for n in root.walk():
        if n.tag in VISIBLE:
            text = squeeze(n.text())
            if text:
                visible.append(text)
                meaningful += n.tag in MEANINGFUL and len(text.encode()) > 20
        elif n.tag == "script":
            scripts += len(n.text().encode())
        elif n.tag == "noscript":
            noscript = noscript or "javascript" in n.text().lower()
        elif n.tag == "body":
            body = n
    text = " ".join(visible)
    outside = (body if body is not None else root).text().lower()
    needs = lambda low: any(phrase in low for phrase in NEEDS_JS)
    return {
        "visible": text, "visible_bytes": len(text.encode()), "visible_words": text.count(" ") + 1 if text else 0, "meaningful": meaningful, "noscript_js": noscript, "needs_js": needs(outside),
        "loading": "loading" in text.lower() and needs(text.lower()), "script_bytes": scripts, "title": title_of(root),
    }


def signal_rows(pages: Iterable[str | None]) -> pd.DataFrame:
    """The columns of SIGNALS: sizes and yes or no, no texts."""
    return pd.DataFrame([signals_of(p or "") for p in pages], columns=[f.split()[0] for f in SIGNALS.split(", ")])


#: Bytes of an Arrow batch of pages: what a worker holds is by this and by its longest page, not by the rows of its partition.
BATCH_BYTES = 1 << 20


def _udf(fn, kind: str):
    spark = SparkSession.active()
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return F.pandas_udf(fn, kind)


def html_signals(html: Column) -> Column:
    """Struct of raw signals; null in, null out."""

    def run(pages: pd.Series) -> pd.DataFrame:
        return signal_rows(pages)

    return F.when(html.isNotNull(), _udf(run, SIGNALS)(html))


def requires_javascript(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in NEEDS_JS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def is_loading_page(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("loading")) & requires_javascript(text)


def has_spa_marker(html: Column) -> Column:
    low = F.lower(html)
    return F.exists(F.array(*[F.lit(m) for m in SPA_MARKERS]), lambda m: F.contains(low, m))


def has_app_shell_marker(html: Column) -> Column:
    return F.contains(F.lower(html), F.lit('id="app"')) | F.contains(F.lower(html), F.lit("id='app'"))


def high_script_ratio(signals: Column) -> Column:
    return signals["script_bytes"] > F.greatest(signals["visible_bytes"], F.lit(1)) * 3


def detect_js_shell(signals: Column, html: Column) -> Column:
    """``static``, ``likely_shell`` or ``ambiguous``; the order of the decisions is the rule."""
    corroborated = signals["noscript_js"] | signals["needs_js"] | has_spa_marker(html) | has_app_shell_marker(html) | high_script_ratio(signals)
    return (
        F.when(signals["visible_bytes"] >= 200, F.when(signals["loading"], "likely_shell").otherwise("static"))
        .when(signals["meaningful"] > 2, "ambiguous")
        .when(corroborated, "likely_shell")
        .otherwise("ambiguous")
    )


def html_title(html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([title_of(parse(p or "")) for p in pages])

    return _udf(run, "string")(html)


def resolve(base: str, href: str) -> str:
    """RFC 3986 resolution to http or https; anything else is empty."""
    try:
        out = urljoin(base, href.strip())
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else ""
    except ValueError:
        return ""


def resolve_url(base: Column, href: Column) -> Column:
    """By the standard library, in Arrow batches; what can't be resolved is empty without a call."""

    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([resolve(b or "", h or "") for b, h in zip(bases, hrefs, strict=True)])

    return F.when(resolvable(href), _udf(run, "string")(base, href)).otherwise(F.lit(""))


_SKIP = ("javascript:", "mailto:", "tel:", "#")


def links_of(page: str | Node, base: str) -> list[str]:
    """Resolved targets of all ``a[href]`` in order, repeats and other hosts too."""
    out = []
    for n in _tree(page).walk():
        href = n.attrs.get("href") if n.tag == "a" else None
        if href and not href.startswith(_SKIP) and (full := resolve(base, href)):
            out.append(full)
    return out


def extract_links(html: Column, base: Column) -> Column:
    """array<string>; ``posexplode`` it for one row a link."""

    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([links_of(p or "", b or "") for p, b in zip(pages, bases, strict=True)])

    return _udf(run, "array<string>")(html, base)


#: What can be asked of a page, with the fields that it gives.
READ = {"signals": SIGNALS, "links": "links array<string>", "main": "title string, markdown string"}


def page_of(page: str | None, base: str, want: Sequence[str]) -> dict:
    """The fields of what is wanted of a page, from one tree; nothing of a page that isn't there."""
    if page is None:
        return {}
    root, out = parse(page), {}
    if "signals" in want:
        out |= signals_of(root)
    if "links" in want:
        out["links"] = links_of(root, base)
    if "main" in want:
        out["title"], out["markdown"] = markdown.extract_main(root)
    return out


def read_page(url: Column, html: Column, *want: str) -> Column:
    """Struct of the fields of READ that a plan wants of a page (any of ``signals``, ``links``, ``main``): each page is parsed once. A null page gives null."""
    kind = ", ".join(dict.fromkeys(f for w in READ if w in want for f in READ[w].split(", ")))
    names = [f.split()[0] for f in kind.split(", ")]

    def run(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = [page_of(p, u or "", want) for u, p in zip(urls, pages, strict=True)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return F.when(html.isNotNull(), _udf(run, kind)(url, html))


def html_to_markdown(html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([markdown.to_markdown(parse(p or "")) for p in pages])

    return _udf(run, "string")(html)


def extract_main(url: Column, html: Column) -> Column:
    """Struct of title, markdown and error; a url that doesn't parse is an error."""

    def run(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        rows = []
        for u, p in zip(urls, pages, strict=True):
            bad = u is None or re.search(r"[\x00-\x1f\x7f]", u)
            title, text = ("", "") if bad else markdown.extract_main(p or "")
            rows.append((title, text, f"invalid url: {u}" if bad else None))
        return pd.DataFrame(rows, columns=["title", "markdown", "error"])

    return _udf(run, "title string, markdown string, error string")(url, html)


def extract_selector(html: Column, css: str) -> Column:
    """Markdown of all elements that match ``css``; none: empty. A selector that isn't known raises at once."""
    markdown.extract_selector("", css)

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([markdown.extract_selector(p or "", css) for p in pages])

    return _udf(run, "string")(html)


def search_hits_of(html: str) -> list[dict]:
    """Result blocks of an HTML result page: title, link and snippet; blocks without title or link are left out."""
    out = []
    for block in select(parse(html), ".result"):
        holder = Node("#document", {}, None)
        holder.children = [block]
        link = next(iter(select(holder, ".result__title .result__a")), None)
        snippet = next(iter(select(holder, ".result__snippet")), None)
        title, href = (link.text().strip(), link.attrs.get("href", "")) if link else ("", "")
        if title and href:
            out.append({"title": title, "href": href, "description": snippet.text().strip() if snippet else ""})
    return out


def search_hits(html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([search_hits_of(p or "") for p in pages])

    return _udf(run, "array<struct<title:string, href:string, description:string>>")(html)
