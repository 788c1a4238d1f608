"""Fixed cases beside the whole tables of the registered queries: each case has its wanted answer."""

import duckdb
import pytest
from pyspark.sql import functions as F

from test_catalog import rows
from webloom.catalog import MAP_VALUES, SITE, fixture, values
from webloom.functions import html as H
from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import crawl, encode, fetch
from webloom.sources import code, docs, inputs, web

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn

    return add


EDGE = [
    ("http://docs.test/guide#install", "http://docs.test/guide"),
    ("http://docs.test/guide/?utm_campaign=x#top", "http://docs.test/guide"),
    ("http://docs.test?utm_term=a&utm_content=b", "http://docs.test"),
    ("http://docs.test/s?z=1&utm_id=7&a=2&m=", "http://docs.test/s?a=2&m=&z=1"),
    ("http://docs.test/q?utmost=1", "http://docs.test/q?utmost=1"),
    ("", ""),
    ("HTTPS://Shop.test:8080/a//?b=2&a=1&b=1", "https://Shop.test:8080/a//?a=1&b=2&b=1"),
    ("https://shop.test/a?x=a%20b~*&y", "https://shop.test/a?x=a+b~%2A&y="),
    ("https://shop.test/%zz", ""),
    ("https://shop.test/a?", "https://shop.test/a?"),
    ("https://shop.test/a?b;c=1&d=%zz&e=1", "https://shop.test/a?e=1"),
]
EDGE_VALUES = values(EDGE, "input, want")


@query("url_normalize_edge", f"SELECT input, want AS normalized FROM {EDGE_VALUES}")
def url_normalize_edge(spark, sf):
    return fixture(spark, EDGE_VALUES).select("input", U.normalize_url(F.col("input")).alias("normalized"))


BARE = [
    ("https://example.com", True, "https://example.com/llms.txt"), ("https://example.com/", True, "https://example.com/llms.txt"), ("http://a.b:8080/?q=1", True, "http://a.b:8080/llms.txt"),
    ("https://example.com/docs", False, "https://example.com/llms.txt"), ("https://example.com//", False, "https://example.com/llms.txt"),
]
BARE_VALUES = values(BARE, "url, bare, llms")


@query("url_bare_domain_llms", f"SELECT url, bare, llms FROM {BARE_VALUES}")
def url_bare_domain_llms(spark, sf):
    u = F.col("url")
    return fixture(spark, BARE_VALUES).select("url", U.is_bare_domain(u).alias("bare"), U.llms_url(u).alias("llms"))


DDG = [
    ("//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fa%3Fb%3Dc&rut=x", "https://example.com/a?b=c"), ("https://example.com/direct", "https://example.com/direct"),
    ("//duckduckgo.com/l/?uddg=&x=1", "//duckduckgo.com/l/?uddg=&x=1"), ("//duckduckgo.com/l/?x=1&uddg=http%3A%2F%2Fa.b%2F", "http://a.b/"),
]
DDG_VALUES = values(DDG, "href, want")


@query("ddg_unwrap", f"SELECT href, want AS url FROM {DDG_VALUES}")
def ddg_unwrap(spark, sf):
    return fixture(spark, DDG_VALUES).select("href", U.unwrap_redirect(F.col("href")).alias("url"))


_P = "<p>" + "Plain words of a page that says enough to be read without any script at all. " * 3 + "</p>"
SHELLS = [
    ("content", f"<html><body><article>{_P}</article></body></html>", "static", False, False, False),
    ("noscript", '<html><body><noscript>You need to enable JavaScript to run this app.</noscript><div id="app"></div></body></html>', "likely_shell", False, True, True),
    ("spa", '<html><body><div id="__next"></div><script>window.__NEXT_DATA__={}</script></body></html>', "likely_shell", True, False, False),
    ("short", "<html><body><p>Hello.</p></body></html>", "ambiguous", False, False, False),
    ("loading", f"<html><body><p>Loading the editor now. Please ensure JavaScript is on.</p>{_P}</body></html>", "likely_shell", False, False, True),
    ("rendered", f'<html><body><div id="__next"><main>{_P}</main></div></body></html>', "static", True, False, False),
    ("blocks", "<html><body><ul><li>one item of some length</li><li>two item of some length</li><li>three items of that length</li></ul><div id='app'></div></body></html>", "ambiguous", False, True, False),
    ("scripts", "<html><body><p>Hi there</p><script>" + "x=1;" * 40 + "</script></body></html>", "likely_shell", False, False, False),
]
SHELL_VALUES = values(SHELLS, "name, html, label, spa, app, js")


@query("js_detect_signals", f"SELECT name, spa, app, js FROM {SHELL_VALUES}")
def js_detect_signals(spark, sf):
    h = F.col("html")
    return fixture(spark, SHELL_VALUES).select("name", H.has_spa_marker(h).alias("spa"), H.has_app_shell_marker(h).alias("app"), H.requires_javascript(h).alias("js"))


@query("js_detect_label", f"SELECT name, label FROM {SHELL_VALUES}")
def js_detect_label(spark, sf):
    s = fixture(spark, SHELL_VALUES).withColumn("s", H.html_signals(F.col("html")))
    return s.select("name", H.detect_js_shell(F.col("s"), F.col("html")).alias("label"))


STRIP = [
    ("**bold**", "bold"), ("a **b** c **d**", "a b c d"), ("*it* and _al_", "it and al"), ("`x`", "x"), ("[t](http://u)", "t"), ("![alt](src) z", " z"), ("# H", "H"), ("### H **b**", "H b"),
    ("* item * more", "* item * more"), ("- *x* y", "- x y"), ("```\n**keep** _me_\n```\n**b**", "```\n**keep** _me_\n```\nb"), ("**_n_**", "n"), ("snake_case_name", "snakecasename"), ("`a` ```x\n*y*``` `b` ```z``` *c", "a ```x\n*y*``` b ```z``` *c"), ("__u__ ![i](j)[k](l)", "u k"),
]
STRIP_VALUES = values(STRIP, "s, want")


@query("strip_markdown_cases", f"SELECT s, want AS stripped FROM {STRIP_VALUES}")
def strip_markdown_cases(spark, sf):
    return fixture(spark, STRIP_VALUES).select("s", T.strip_markdown(F.col("s")).alias("stripped"))


VERSIONS = [
    ("v1.2.3", "1.2.4", -1), ("1.10.0", "v1.9.9", 1), ("v1.0.0", "1.0.0", 0), ("dev", "1.0.0", 0), ("1.2.3-rc1", "1.2.3", 0), ("1.2", "1.2.3", 0), ("2.0.0+x", "1.9.9", 1), ("a.b.c", "1.2.3", 0), (" v0.9.1 ", "0.10.0", -1),
]
VERSION_VALUES = values(VERSIONS, "a, b, want")


@query("version_compare", f"SELECT a, b, want AS cmp FROM {VERSION_VALUES}")
def version_compare(spark, sf):
    return fixture(spark, VERSION_VALUES).select("a", "b", T.compare_versions(F.col("a"), F.col("b")).alias("cmp"))


@query("sitemap_urls", f"SELECT unnest(['{SITE}/p/3', '{SITE}/p/4/', 'http://other.test/x']) AS url")
def sitemap_urls(spark, sf):
    return crawl.expand_sitemap(fixture(spark, MAP_VALUES), f"{SITE}/sitemap.xml")


@query("render_fallback", f"SELECT name, CASE WHEN label = 'likely_shell' AND name <> 'scripts' THEN '<p>rendered ' || name || '</p>' ELSE html END AS html, label AS js_detection FROM {SHELL_VALUES}")
def render_fallback(spark, sf):
    p = fixture(spark, SHELL_VALUES).select("name", F.col("name").alias("url"), F.col("html").alias("body"))
    rendered = p.where("name <> 'scripts'").select("url", F.concat(F.lit("<p>rendered "), "name", F.lit("</p>")).alias("html"))
    return fetch.render_fallback(p, rendered).select("name", "html", "js_detection")


LLMS = [
    ("https://a.test", 200, "text/html", "<p>page a</p>"), ("https://a.test/llms.txt", 200, "text/plain; charset=utf-8", "# a for machines"),
    ("https://b.test/", 200, "text/html", "<p>page b</p>"), ("https://b.test/llms.txt", 200, "text/html", "<p>not plain</p>"), ("https://c.test/x", 200, "text/html", "<h1>c</h1>"), ("https://d.test/", 500, "text/html", ""),
]
LLMS_VALUES = values(LLMS, "url, status, content_type, body")
LLMS_WANT = values([("https://a.test", "llms.txt", "# a for machines", None), ("https://b.test/", "", "page b", None), ("https://c.test/x", "", "# c", None), ("https://d.test/", None, None, "HTTP 500 for https://d.test/")], "url, title, markdown, error")


@query("scrape_llms", f"SELECT * FROM {LLMS_WANT}")
def scrape_llms(spark, sf):
    snapshot = fixture(spark, LLMS_VALUES)
    asked = snapshot.where("url not like '%llms.txt'").select("url")
    return fetch.scrape(asked, snapshot).select("url", "title", "markdown", "error")


@query("scrape_selector", "SELECT * FROM " + values([("https://a.test", "page a", None), ("https://c.test/x", "", "no match for selector in https://c.test/x")], "url, markdown, error"))
def scrape_selector(spark, sf):
    snapshot = fixture(spark, LLMS_VALUES)
    return fetch.scrape(snapshot.where("url in ('https://a.test', 'https://c.test/x')").select("url"), snapshot, selector="p").select("url", "markdown", "error")


DDG_PAGE = (
    "<html><body><div class='result web'><h2 class='result__title'><a class='result__a' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fone.test%2F'>One &amp; only</a></h2><a class='result__snippet'>First snippet</a></div>"
    "<div class='result'><h2 class='result__title'><a class='result__a' href=''>No link</a></h2></div>"
    "<div class='result'><h2 class='result__title'><a class='result__a' href='https://two.test/x'>Two</a></h2></div>"
    "<div class='result'><h2 class='result__title'><a class='result__a' href='https://three.test/'>Three</a></h2><div class='result__snippet'>Third</div></div></body></html>"
)
DDG_PAYLOAD = values([(1, DDG_PAGE), (2, "<p>nothing</p>")], "query_id, body")
DDG_WANT = values([(1, 0, "One & only", "https://one.test/", "First snippet"), (1, 1, "Two", "https://two.test/x", "")], "query_id, pos, title, url, description")


@query("search_html_results", f"SELECT * FROM {DDG_WANT}")
def search_html_results(spark, sf):
    return web.web_results(fixture(spark, DDG_PAYLOAD), "ddg", 2)


TRIES = [
    (1, 1, 202, "wait"), (1, 2, 202, "wait"), (1, 3, 200, "ok1"), (2, 1, 200, "ok2"), (3, 1, 500, "bad"), (3, 2, 200, "late"), (4, 1, 202, "w"), (4, 2, 202, "w"), (4, 3, 202, "w"), (4, 4, 200, "too late"),
]
TRY_VALUES = values(TRIES, "request_id, attempt, status, body")
TRY_WANT = values([(1, 3, 200, "ok1", None), (2, 1, 200, "ok2", None), (3, 1, 500, None, "search returned status 500"), (4, 3, 202, None, "search returned status 202")], "request_id, attempt, status, body, error")


@query("search_retry", f"SELECT * FROM {TRY_WANT}")
def search_retry(spark, sf):
    return web.settle_attempts(fixture(spark, TRY_VALUES))


def _match(repo: str, kind: str = "content", lines: str = '[{"line":"x := 1","lineNumber":7},{"line":"y","lineNumber":9}]') -> str:
    return f'{{"type":"{kind}","repository":"{repo}","path":"a/b.go","language":"Go","repoStars":5,"lineMatches":{lines}}}'


SSE = f"event: progress\ndata: [{_match('skip')}]\n\nevent: matches\ndata: [{_match('r1')},{_match('r2', 'path')},{_match('r3', lines='[]')}]\ndata: not json\n\ndata: [{_match('r4')}]\nevent: done\ndata: [{_match('r5')}]\nevent:matches\ndata:[{_match('r6')},{_match('r7')}]"
SSE_VALUES = values([(1, SSE), (2, "event: matches"), (3, SSE.replace("r1", "q1"))], "response_id, body")
SSE_WANT = values(
    [(i, k, r, "a/b.go", 7, "x := 1", "Go", 5, f"https://sourcegraph.com/{r}/-/blob/a/b.go#L7", "sourcegraph") for i, rs in ((1, ("r1", "r4", "r6")), (3, ("q1", "r4", "r6"))) for k, r in enumerate(rs)],
    "response_id, pos, repo, path, line, snippet, language, stars, url, source",
)


@query("code_sse_parse", f"SELECT * FROM {SSE_WANT}")
def code_sse_parse(spark, sf):
    return code.code_results(fixture(spark, SSE_VALUES), "sourcegraph", 3)


def _item(repo: str, node: str, fragment: str | None, at: int | None) -> str:
    m = "" if fragment is None else f',"text_matches":[{{"fragment":"{fragment}","matches":[{f"{{~indices~:[{at}]}}".replace("~", chr(34)) if at is not None else ""}]}}]'
    return f'{{"path":"p.go","html_url":"http://h/{repo}","repository":{{"full_name":"{repo}","node_id":"{node}"}}{m}}}'


GITHUB = '{"items":[' + ",".join([_item("a/one", "N1", "first|  second hit |third".replace("|", "\\n"), 9), _item("b/two", "N2", " | only ".replace("|", "\\n"), None), _item("c/three", "N1", None, None), _item("d/four", "N4", "x", 0)]) + "]}"
GITHUB_ROWS = [("a/one", "second hit", 11), ("b/two", "only", 0), ("c/three", "", 11)]
STARS_VALUES = values([("N1", 11), ("N9", 3)], "node_id, stars")
GITHUB_WANT = values([(1, k, r, "p.go", 0, s, "", n, f"http://h/{r}", "github") for k, (r, s, n) in enumerate(GITHUB_ROWS)], "response_id, pos, repo, path, line, snippet, language, stars, url, source")


@query("code_github_stars", f"SELECT * FROM {GITHUB_WANT}")
def code_github_stars(spark, sf):
    bodies = spark.createDataFrame([(1, GITHUB)], "response_id int, body string")
    return code.code_results(bodies, "github", 3, fixture(spark, STARS_VALUES))


@query("code_star_ids", "SELECT 1 AS response_id, 'N1,N2,N1,N4' AS ids")
def code_star_ids(spark, sf):
    return code.star_ids(spark.createDataFrame([(1, GITHUB)], "response_id int, body string")).select("response_id", F.array_join("ids", ",").alias("ids"))


REWRITES = [
    ("foo", "go", "foo lang:go archived:no fork:no", "foo language:go"), ("foo archived:yes", "", "foo archived:yes fork:no", "foo archived:yes"), ("x language:c fork:only", "rust", "x language:c fork:only lang:rust archived:no", "x language:c fork:only"),
    ("y", None, "y archived:no fork:no", "y"),
]
REWRITE_VALUES = values(REWRITES, "q, lang, sg, gh")


@query("code_query_rewrite", f"SELECT q, sg, gh FROM {REWRITE_VALUES}")
def code_query_rewrite(spark, sf):
    q, lang = F.col("q"), F.col("lang")
    return fixture(spark, REWRITE_VALUES).select("q", U.build_query("sourcegraph", q, lang).alias("sg"), U.build_query("github", q, lang).alias("gh"))


LIBS = '{"results":[{"id":"/l/one","title":"One","description":"d","totalSnippets":3,"trustScore":9.5,"versions":["v1"]},{"id":"/l/two","title":"Two"}]}'
DOCS = '{"codeSnippets":[{"codeTitle":"T1","codeId":"c1","codeList":[{"language":"go","code":"x"},{"code":"y"}]},{"codeTitle":"T2","codeId":"c2"}],"infoSnippets":[{"breadcrumb":"A > B","pageId":"i1","content":"info"}]}'
DOCS_VALUES = values([(1, "/l/one", DOCS), (2, "/l/two", '{"infoSnippets":[]}')], "response_id, library, body")
DOCS_WANT = [(0, 0, "T1", "", "x", "c1"), (0, 1, "T2", "", "", "c2"), (1, 0, "A > B", "A > B", "info", "i1")]


@query("docs_union", "SELECT * FROM " + values([(1, p, k, "/l/one", t, b, s, u, "context7") for p, k, t, b, s, u in DOCS_WANT], "response_id, part, k, library, title, breadcrumb, snippet, url, source"))
def docs_union(spark, sf):
    return docs.docs_results(fixture(spark, DOCS_VALUES))


@query("docs_top_library", "SELECT * FROM " + values([(7, p, t, s) for p, _, t, _, s, _ in DOCS_WANT], "response_id, part, title, snippet"))
def docs_top_library(spark, sf):
    resolved = fixture(spark, values([(7, LIBS), (8, '{"results":[]}')], "response_id, body"))
    return docs.search(resolved, fixture(spark, DOCS_VALUES).select("library", "body")).select("response_id", "part", "title", "snippet")


ARRAY_VALUES = values([(2, "b", None), (1, "<a>", None), (3, "c", "failed")], "idx, url, error")


@query("out_json_array", "SELECT '[{\"url\":\"\\u003ca\\u003e\"},{\"url\":\"b\"}]' AS json")
def out_json_array(spark, sf):
    return encode.json_array(fixture(spark, ARRAY_VALUES), "idx", ["url"])


@query(
    "out_entries",
    "SELECT * FROM " + values([("code", "r  p  (line 3)  ★ 9\n  s\n  u\n"), ("code0", "r  p\n  u\n"), ("docs", "[B]\n  s\n  source: u\n"), ("search", "t\n  u\n  d\n"), ("summary", "---\nseed: s\npages: 2\nduration: 1.5s\n---")], "kind, entry"),
)
def out_entries(spark, sf):
    x = lambda s: F.lit(s)
    rows = {
        "code": encode.code_entry(x("r"), x("p"), x(3), x(9), x("s"), x("u")), "code0": encode.code_entry(x("r"), x("p"), x(0), x(0), x(""), x("u")), "docs": encode.docs_entry(x("T"), x("B"), x("s"), x("u")),
        "search": encode.search_entry(x("t"), x("u"), x("d")), "summary": encode.summary_text(x("s"), ("pages",), x(1.5)),
    }
    one = spark.range(1).select(F.lit(2).alias("pages"))
    return one.select(F.explode(F.array(*[F.struct(x(k).alias("kind"), v.alias("entry")) for k, v in rows.items()])).alias("r")).select("r.*")


@query("crawl_status_table", "SELECT 'c_1  running    http://s                                  pages=3      now' AS line")
def crawl_status_table(spark, sf):
    x = F.lit
    return spark.range(1).select(encode.status_line(x("c_1"), x("running"), x("http://s"), x(3), x("now")).alias("line"))


@query("line_list_scan", "SELECT url FROM " + values([("https://a.test",), ("https://a.test",), ("b",)], "url"))
def line_list_scan(spark, sf):
    return inputs.line_list(fixture(spark, values([("  https://a.test\t",), ("# no",), ("",), ("   ",), ("https://a.test",), ("b",)], "value")))


@query("config_merge", "SELECT 'ddg' AS backend, '72h' AS cache_ttl, 9 AS lim")
def config_merge(spark, sf):
    user = fixture(spark, values([("ddg", None, 9)], "backend, cache_ttl, lim"))
    default = fixture(spark, values([("brave", "72h", 5)], "backend, cache_ttl, lim"))
    return inputs.merge_config(user, default, ("backend", "cache_ttl", "lim"))


PLACES = [
    ("/opt/homebrew/bin/webloom", None, "homebrew"), ("/usr/local/Cellar/w/1/bin/x", None, "homebrew"), ("/home/u/go/bin/webloom", None, "go"), ("C:/u/go/bin/webloom.exe", None, "go"), ("/usr/bin/webloom", None, "manual"),
    ("/usr/bin/other", None, "unknown"), ("", None, "unknown"), (None, None, "unknown"), ("/usr/bin/webloom", " Homebrew", "homebrew"), ("/usr/bin/webloom", "snap", "manual"), ("/home/u/go/bin/other", None, "unknown"),
]
PLACE_VALUES = values(PLACES, "path, forced, want")


@query("install_type", f"SELECT path, forced, want AS kind FROM {PLACE_VALUES}")
def install_type(spark, sf):
    return fixture(spark, PLACE_VALUES).select("path", "forced", T.install_type(F.col("path"), forced=F.col("forced")).alias("kind"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_case(spark, name):
    got, want = QUERIES[name](spark, ""), duckdb.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
