"""Crawls, caches, filters, inputs, encoders, jobs and SQL names."""

import json
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import html, sqlfuncs, text, urls
from webloom.operators import cache, crawl, encode, fetch, filters
from webloom.operators.cache import PageCache
from webloom.sources import code, docs, inputs, live, web


def pages(spark, graph):
    rows = [(f"http://s.test{p}", 200, "".join(f'<a href="{x}">x</a>' for x in links)) for p, links in graph.items()]
    return spark.createDataFrame(rows, "url string, status int, body string")


def test_two_rings_visit_each_page_once(spark):
    out = crawl.crawl(spark, ["http://s.test/l4#x"], pages(spark, _two_rings()), depth=20).collect()
    assert sorted(r.url for r in out) == sorted(f"http://s.test{p}" for p in _two_rings())
    assert {r.status for r in out} == {"new"} and {r.source for r in out if r.depth == 0} == {"seed"}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 7), st.lists(st.integers(0, 9), max_size=4), min_size=1, max_size=8), st.integers(0, 4))
def test_crawl_is_reachability(graph, depth):
    from webloom.session import get_spark

    spark = get_spark()
    level, want, front = {}, {0: 0}, [0]
    for d in range(depth):
        front = [x for i in front for x in graph.get(i, []) if x not in want and not want.update({x: d + 1})]
    known = spark.createDataFrame([(f"http://s.test/{i}", [f"http://s.test/{x}" for x in ls]) for i, ls in graph.items()], "url string, links array<string>")
    got = crawl.crawl(spark, ["http://s.test/0"], known, depth=depth).collect()
    assert {int(r.url.rsplit("/", 1)[1]): r.depth for r in got} == want and len(got) == len(want)
    assert {int(r.url.rsplit("/", 1)[1]) for r in got if r.error} == {i for i in want if i not in graph}


def test_seed_that_fails_its_filters(spark):
    web_ = pages(spark, {"/": ["/a"]})
    assert crawl.crawl(spark, ["http://s.test/"], web_, allow=("/shop/",)).count() == 0
    with pytest.raises(ValueError, match="invalid deny"):
        crawl.crawl(spark, ["http://s.test/"], web_, deny=("(open",))
    for p in ("(?=x)", "(?<!x)", r"(a)\1"):
        with pytest.raises(ValueError, match="look-around"):
            filters.validate_deny([p])


def test_stop_and_levels(spark):
    stop, seen = threading.Event(), []

    def level(n, rows):
        seen.append((n, rows.count()))
        stop.set()

    out = crawl.crawl(spark, ["http://s.test/"], pages(spark, {"/": ["/a"], "/a": ["/b"]}), stop=stop, on_level=level)
    assert out.count() == 1 and seen == [(0, 1)]


def test_hosts_of_shells_are_rendered_throughout(spark):
    shell = '<div id="app"></div>'
    graph = {f"/{i}": (["/last"] if i == 1 else []) for i in range(1, 12)}
    rows = [("http://s.test", 200, "".join(f'<a href="/{i}">x</a>' for i in range(1, 12)) + shell)]
    rows += [(f"http://s.test{p}", 200, "".join(f'<a href="{x}">x</a>' for x in ls) + shell) for p, ls in graph.items()]
    rows += [("http://s.test/last", 200, "<p>plain</p>")]
    snapshot = spark.createDataFrame(rows, "url string, status int, body string")
    rendered = spark.createDataFrame([("http://s.test/last", '<a href="/deep">x</a>')], "url string, html string")
    got = {r.url: r for r in crawl.crawl(spark, ["http://s.test"], snapshot, rendered=rendered).collect()}
    assert got["http://s.test/1"].js_detection == "likely_shell"
    assert got["http://s.test/last"].js_detection is None and "http://s.test/deep" in got


def test_cache(spark, tmp_path):
    c = PageCache(spark, str(tmp_path / "cache"), ttl_seconds=100)
    page = lambda md, h: spark.createDataFrame([("http://a", "t", md, "", "", h)], "url string, title string, markdown string, etag string, last_modified string, content_hash string")
    ask = spark.createDataFrame([("http://a",), ("http://b",)], "url string")
    assert c.stats().first().entries == 0
    c.upsert(page("one", "h1"), F.lit(1000))
    c.upsert(page("two", "h2"), F.lit(1050))
    for now, want in ((1150, "two"), (1151, None)):
        got = {r.url: r.hit and r.hit.markdown for r in c.lookup(ask, F.lit(now)).collect()}
        assert got == {"http://a": want, "http://b": None}
    assert c.stats().first().entries == 1
    c.clear()
    assert c.stats().first().entries == 0


def test_jobs(spark, tmp_path):
    jobs = crawl.CrawlJobs(spark, str(tmp_path))
    job = jobs.start("http://s.test/", pages(spark, {"/": ["/a", "/gone"], "/a": []}), depth=2)
    got = jobs.wait(job, 120)
    assert got["status"] == "completed" and (got["pages"], got["new"], got["errors"]) == (3, 2, 1)
    (tmp_path / "c_zz.json").write_text("not json")
    assert [s["id"] for s in jobs.list()] == [job]
    with pytest.raises(ValueError, match="not running"):
        jobs.stop(job)


def test_inputs(spark, tmp_path):
    urls_of = lambda *a: [r.url for r in inputs.resolve_inputs(spark, *a).orderBy("idx").collect()]
    listed = tmp_path / "l.txt"
    listed.write_text("# c\n a \n\nb\na\n")
    assert urls_of(["x", "y"]) == ["x", "y"] and urls_of(['["p","q"]']) == ["p", "q"] and urls_of([str(listed)]) == ["a", "b", "a"] and urls_of(["http://z"]) == ["http://z"]
    assert urls_of([], [" m ", "#"]) == ["m"]
    for bad in ("[]", "[1", "[1]"):
        with pytest.raises(ValueError, match="JSON"):
            urls_of([bad])


def test_config(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    assert inputs.load_config(path)["backend"] == "brave"
    inputs.save_config(path, inputs.set_config(inputs.load_config(path), "limit", "9"))
    assert inputs.load_config(path)["limit"] == 9
    (tmp_path / "bad.json").write_text('{"limit": 3')
    assert inputs.load_config(str(tmp_path / "bad.json")) == inputs.DEFAULTS
    for k, v in (("nope", "1"), ("backend", "x"), ("cache_ttl", "soon")):
        with pytest.raises(ValueError, match="unknown|invalid"):
            inputs.set_config(inputs.DEFAULTS, k, v)
    assert inputs.duration_seconds("1h30m") == 5400 and inputs.duration_seconds("x") == 3600
    assert inputs.resolve_token({"github_token": "t"}, {}) == ("t", "config") and inputs.resolve_token({}, {"GH_TOKEN": "g"}) == ("g", "env") and inputs.resolve_token({}, {}) == ("", "none")
    assert "github_token" not in inputs.discover(inputs.DEFAULTS, {})


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab c*_`[]()#!\n~é", max_size=30), min_size=1, max_size=8), st.integers(1, 12))
def test_text_properties(texts, n):
    from webloom.session import get_spark

    spark = get_spark()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.truncate_content(F.col("t"), n).alias("c"), text.word_count(F.col("t")).alias("w"), text.first_line(F.col("t")).alias("f")).collect():
        assert r.c == (r.t if len(r.t) <= n else r.t[:n] + "\n\n[truncated]")
        assert r.w == len(r.t.split()) and r.f == next((x.strip() for x in r.t.split("\n") if x.strip()), "")


def test_normalize_is_idempotent(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.normalize_url(F.col("url")).alias("u"))
    assert df.where(urls.normalize_url(F.col("u")) != F.col("u")).count() == 0


def test_body_cap(spark, monkeypatch):
    monkeypatch.setattr(fetch, "BODY_CAP", 5)
    assert spark.range(1).select(fetch.capped(F.lit("éabcdef")).alias("b")).first().b == "éabc"


def test_backends(spark):
    empty = spark.createDataFrame([(1, "not json")], "query_id int, body string")
    assert web.web_results(empty, "brave", 5).count() == 0 and web.web_results(empty, "ddg", 5).count() == 0
    for call in (lambda: web.web_results(empty, "x", 1), lambda: code.code_results(empty, "x", 1), lambda: live.search_request("x", "q", 1, {})):
        with pytest.raises(ValueError, match="unknown"):
            call()
    with pytest.raises(NotImplementedError):
        docs.local_search()
    one = spark.createDataFrame([(1, '{"web":{"results":[{"title":"t","url":"u"}]}}')], "query_id int, body string")
    assert web.web_results(one, "brave", 0).count() == 0 and web.web_results(one, "brave", 1).first().description == ""
    assert live.search_request("github", "a b", 500, {})[0].endswith("q=a+b&per_page=30")
    errors = spark.createDataFrame([(s,) for s in (200, 401, 429, 500)], "s int").select(web.payload_error("brave", F.col("s")).alias("e")).collect()
    assert [r.e for r in errors] == [None, "brave: invalid API key", "brave: rate limited", "brave returned status 500"]


def test_json_is_safe_in_html(spark):
    got = spark.range(1).select(encode.crawl_json(F.lit("u"), F.lit("<t>"), F.lit("a & b"), F.lit("new"), F.lit("link")).alias("j")).first().j
    assert "<" not in got and "&" not in got
    assert json.loads(got) == {"url": "u", "title": "<t>", "words": 3, "status": "new", "source": "link", "body": "a & b"}


def test_sql_names(spark):
    sqlfuncs.register(spark)
    assert spark.sql("SELECT word_count('a b  c') w, truncate_content('abcdef', 3) t, content_hash('x') h, html_title('<title>q</title>') q").first().asDict() == {"w": 3, "t": "abc\n\n[truncated]", "h": "2d711642b726b044", "q": "q"}
    rows = spark.sql("SELECT * FROM extract_links('<a href=\"/a\">x</a><a href=\"b\">y</a>', 'http://h/p/')").collect()
    assert [(r.pos, r.link) for r in rows] == [(0, "http://h/a"), (1, "http://h/p/b")]


def test_resolve_url(spark):
    df = spark.createDataFrame([("http://h/a/b", "../c"), ("http://h/a", "mailto:x"), ("http://h", "ftp://x/y"), ("http://h/a", "//o/z")], "b string, h string")
    assert [r.u for r in df.select(html.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()] == ["http://h/c", "", "", "http://o/z"]


def test_misc_text(spark):
    one = spark.range(1)
    x = F.lit
    got = one.select(
        text.mark_default(F.array(x("a"), x("b")), x("b")).alias("d"), text.install_type(x("/opt/homebrew/bin/w")).alias("i"), text.install_type(x("")).alias("u"),
        text.rate_limit_message(x(1060), x(1000)).alias("r"), text.matched_line(x("\n a \nb"), x(-1)).alias("m"),
    ).first()
    assert (got.d, got.i, got.u, got.m) == ("a, b (default)", "homebrew", "unknown", "a") and got.r.startswith("rate limited; resets in 60s")


def test_written_tables_are_cleared(spark):
    from webloom import session

    df = session.materialize(spark.range(3).toDF("x"), "test")
    path = session._written[spark.sparkContext.applicationId][-1]
    assert df.count() == 3
    assert session.clear_written(spark) > 0
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789abcdef", min_size=1, max_size=16), max_size=60), st.lists(st.text(alphabet="0123456789abcdef", min_size=1, max_size=16), min_size=1, max_size=20))
def test_bloom(keys, asked):
    found = cache.may_hold(cache.bloom(keys), cache._hashes(asked))
    assert all(f for f, k in zip(found, asked, strict=True) if k in keys)


def test_cache_opens_only_files_that_can_hold_a_key(spark, tmp_path):
    """Eight batches of a thousand pages in files of fifty: ten keys open about ten files a batch that has them, not 160."""
    c = PageCache(spark, str(tmp_path / "cache"), ttl_seconds=100, file_rows=50)
    page = lambda lo, hi, md: spark.range(lo, hi).select(F.format_string("http://h/%d", "id").alias("url"), F.lit("t").alias("title"), F.lit(md).alias("markdown"), F.lit("").alias("etag"), F.lit("").alias("last_modified"), F.lit(md).alias("content_hash"))
    for i in range(8):
        c.upsert(page(1000 * i, 1000 * i + 1000, f"m{i}"), F.lit(1000 + i))
    c.upsert(page(10, 15, "again"), F.lit(1050))
    assert c.index().count() >= 160
    asked = [*range(10, 18), 3500, 9999]
    ask = spark.createDataFrame([(f"http://h/{i}",) for i in asked], "url string")
    keys = [r[0] for r in ask.select(text.cache_key(F.col("url"))).collect()]
    opened = c.candidates(keys)
    holds = {r.file for r in spark.read.schema(cache.SCHEMA).parquet(*[r.file for r in c.index().select("file").collect()]).where(F.col("key").isin(keys)).select(F.col("_metadata.file_path").alias("file")).distinct().collect()}
    assert holds <= set(opened) and len(opened) <= len(holds) + 4 and len(holds) <= 10
    assert {f.replace("file:///", "file:/") for f in c.point(keys).inputFiles()} == {f.replace("file:///", "file:/") for f in opened}
    got = {int(r.url.rsplit("/", 1)[1]): r.hit and r.hit.markdown for r in c.lookup(ask, F.lit(1060)).collect()}
    want = {i: "again" if i < 15 else "m0" for i in range(10, 18)} | {3500: "m3", 9999: None}
    assert got == want
    assert c.candidates(["zz"]) == [] and c.point([]).count() == 0
    before = sorted(map(str, c.entries().collect()))
    assert c.compact(4) >= 1 and len(c._batches()) < 4
    assert sorted(map(str, c.entries().collect())) == before and len(before) == 8000
    assert {int(r.url.rsplit("/", 1)[1]): r.hit and r.hit.markdown for r in c.lookup(ask, F.lit(1060)).collect()} == want
    c.compact(1)
    assert len(c._batches()) == 1 and c.entries().count() == 8000
    c.clear()
    assert c.entries().count() == 0


def test_cache_ignores_a_batch_without_index(spark, tmp_path):
    """A writer that is lost before its index is written leaves a batch that doesn't count."""
    c = PageCache(spark, str(tmp_path / "cache"))
    blank = [F.lit("").alias(x) for x in ("title", "markdown", "etag", "last_modified", "content_hash")]
    c.upsert(spark.createDataFrame([("http://a",)], "url string").select("url", *blank))
    spark.createDataFrame([("k", 1, None)], cache.SCHEMA).write.parquet(f"{c.path}/e-0/batch-lost/data")
    assert [r.p.url for r in c.entries().collect()] == ["http://a"]


def _two_rings(n=6):
    """Two rings of pages with a bridge from the first to the second."""
    ring = lambda side, i: f"/{side}{i % n}"
    graph = {ring(s, i): [ring(s, i + 1)] for s in "lr" for i in range(n)}
    graph["/l2"].append("/r0?utm_source=bridge")
    return graph


@pytest.mark.parametrize("few", [0, 1000])
def test_levels_move_only_their_own_urls(spark, monkeypatch, few):
    """A level's plan exchanges new links and neither the store nor the visited urls, and reads no content."""
    plans = []
    real = crawl.Bucketed.append

    def append(self, rows, /, **metrics):
        if metrics:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return real(self, rows, **metrics)

    monkeypatch.setattr(crawl.Bucketed, "append", append)
    monkeypatch.setattr(crawl, "FEW", few)
    store = crawl.PageStore.build(pages(spark, _two_rings()))
    got = {r.url.removeprefix("http://s.test/"): r.depth for r in crawl.crawl(spark, ["http://s.test/l0"], store, depth=5).collect()}
    assert got == {"l0": 0, "l1": 1, "l2": 2, "l3": 3, "r0": 3, "l4": 4, "r1": 4, "l5": 5, "r2": 5}
    scans = [line for p in plans for line in p.splitlines() if store.table.name in line and "FileScan" in line]
    assert len(scans) == 6 and not any("markdown" in x.split("ReadSchema")[1] for x in scans)
    if not few:
        for p in plans[1:]:
            above = p[: p.index(f"{store.table.name}[")].splitlines()
            depth = len(above[-1]) - len(above[-1].lstrip(" :+-"))
            path = [x for x in above if len(x) - len(x.lstrip(" :+-")) < depth]
            chain, least = [], depth
            for x in reversed(path):
                d = len(x) - len(x.lstrip(" :+-"))
                if d < least:
                    chain, least = [*chain, x], d
            assert "SortMergeJoin" in "".join(chain) and not any("Exchange" in x for x in chain)
            assert p.count("Exchange hashpartitioning") <= 2
    else:
        assert all("SelectedBucketsCount: 4" not in x for x in scans[1:])


def test_store_is_opened_again(spark, tmp_path):
    path = str(tmp_path / "store")
    made = crawl.PageStore.build(pages(spark, _two_rings()), path)
    made.table.detach()
    again = crawl.PageStore.open(spark, path, made.table.n)
    assert crawl.crawl(spark, ["http://s.test/r0"], again, depth=9).count() == 6
    assert [r.links for r in again.rows(["http://s.test/l2"]).collect()] == [["http://s.test/l3", "http://s.test/r0"]]


def test_crawl_fills_the_cache(spark, tmp_path):
    """A second crawl finds what the first one kept; what has run out is asked again and told by its hash."""
    c = PageCache(spark, str(tmp_path / "cache"), ttl_seconds=50)
    site = _two_rings(3)
    run = lambda snapshot, now, **kw: {r.url.removeprefix("http://s.test/"): r.status for r in crawl.crawl(spark, ["http://s.test/l0"], snapshot, cache=c, now=F.lit(now), **kw).collect()}
    assert run(pages(spark, site), 1000, depth=2) == {"l0": "new", "l1": "new", "l2": "new"}
    assert c.entries().count() == 3
    assert run(pages(spark, site), 1050, depth=9) == {"l0": "unchanged"}
    assert run(pages(spark, site), 1050, depth=9, expand_cached=True) == {"l0": "unchanged"}
    later = pages(spark, site).withColumn("body", F.when(F.col("url").endswith("l1"), F.concat("body", F.lit("<p>more"))).otherwise(F.col("body")))
    assert run(later, 1051, depth=4) == {"l0": "unchanged", "l1": "changed", "l2": "unchanged", "r0": "new", "r1": "new"}
    assert {r.p.url.rsplit("/", 1)[1]: r.t for r in c.entries().collect()} == dict.fromkeys(("l0", "l1", "l2", "r0", "r1"), 1051)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="htps:/?#%@&=ab.é ;~+\t", max_size=30).map(lambda x: "http://" + x) | st.sampled_from(["http://h/a", "https://h", "http://h/", "HTTP://h/a", "http://h/a b", "http://u@h/a", "http://h:8/ä/b;c"]), min_size=20, max_size=40))
def test_normal_urls_are_left_alone(spark, found):
    """The short way for normal urls gives what the long way gives."""
    df = spark.createDataFrame([(u,) for u in found], "u string")
    assert df.where(~urls.normalize_url(F.col("u")).eqNullSafe(urls._normalized(F.col("u")))).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_stop_inside_a_level_keeps_what_was_committed(spark, tmp_path, monkeypatch, few):
    """Twenty pages on one level in steps of six: stopped after the second step, its pages and the cache hold what was written; a second crawl ends with all."""
    monkeypatch.setattr(crawl, "FEW", few)
    site = pages(spark, {"/": [f"/{i}" for i in range(20)], **{f"/{i}": ["/", "/deep"] for i in range(20)}, "/deep": []})
    c = PageCache(spark, str(tmp_path / "cache"))
    stop, seen = threading.Event(), []

    def step(level, rows):
        seen.append((level, rows.count()))
        if sum(n for _, n in seen) > 10:
            stop.set()

    got = crawl.crawl(spark, ["http://s.test/"], site, depth=2, cache=c, step=6, on_level=step, stop=stop).collect()
    assert len(got) == sum(n for _, n in seen) and 10 < len(got) < 21 and {r.depth for r in got} == {0, 1}
    assert sorted(r.p.url for r in c.entries().collect()) == sorted(r.url for r in got)
    again = crawl.crawl(spark, ["http://s.test/"], site, depth=2, cache=c, step=6, expand_cached=True).collect()
    assert len(again) == len({r.url for r in again}) == 22 or {r.status for r in again} == {"unchanged"}
    whole = crawl.crawl(spark, ["http://s.test/"], site, depth=2, step=6).collect()
    assert sorted((r.url, r.depth) for r in whole) == sorted((r.url, r.depth) for r in crawl.crawl(spark, ["http://s.test/"], site, depth=2).collect()) and len(whole) == 22


def test_errors_of_backends(spark):
    tries = spark.createDataFrame([(1, 1, 401, "x"), (2, 1, 429, "x"), (3, 1, 500, "x"), (4, 1, 200, "ok"), (5, 1, 403, "x")], "request_id int, attempt int, status int, body string")
    errors = lambda b: [r.error for r in web.settle_attempts(tries, b).orderBy("request_id").collect()]
    assert errors("brave") == ["brave: invalid API key", "brave: rate limited", "brave returned status 500", None, "brave returned status 403"]
    assert errors("github")[4] == "github: rate limited" and errors("ddg")[0] == errors(None)[0] == "search returned status 401"
