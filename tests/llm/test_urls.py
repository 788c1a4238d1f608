from webloom.llm import common, urls


def plain(url):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_and_parts(spark):
    some = [
        "https://A.Example.NET/en/1?x#y", "http://example.net", "http://net/", "http://x.net?y=/en/", "https://planet/de/", "ftp://b.org/fr/a://c", "no scheme", "", None,
        "http://example.com/de/", "http://example.com/de", "http://example.community/de/", "HTTP://É.ORG/fr/\nx", "://", "http://a.example.com/DE/1/2/3/4/5/6/7",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(some)] + [(None, None, None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "page_id long, quality int")
    wide = pages.withColumn("host", pages["html"]).withColumn("shape", pages["html"]).withColumn("n", pages["page_id"]).unionByName(pages.limit(1), True)
    for got in (urls.judge(pages), urls.judge(pages, labels=labels), urls.judge(wide)):
        rows = {r.page_id: r for r in got.collect()}
        assert len(rows) == len(some) + 1
        for i, u in enumerate(some):
            host, path, rule, verdict = plain(u)
            r = rows[i]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urls.judge(wide).count() == len(some) + 2
    assert urls.judge(pages.where("false")).count() == 0
    assert urls.judge(pages, rules=()).where("verdict = 'block'").count() == 0


def test_templates(spark):
    """Numbers and crowds of children become wildcards; a bad branch stays apart and is blocked."""
    rows, labels = [], []
    for i in range(400):
        branch = "bad" if i % 4 == 0 else "good"
        rows.append((i, f"http://x.test/{branch}/item-{i}-{'abcdefgh'[i % 8]}"))
        labels.append((i, 0 if branch == "bad" else 1))
    pages = spark.createDataFrame(rows + [(1000, "http://x.test/bad/new"), (1001, "http://x.test/good/new"), (1002, "http://y.test/7/8")], "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(pages, labels=spark.createDataFrame(labels, "page_id long, quality int")).collect()}
    assert out[1000].template == "/bad/*" and out[1000].verdict == "block"
    assert out[1001].template == "/good/*" and out[1001].verdict == "allow"
    assert out[1002].template == "/*/*" and out[1002].verdict == "allow"


def test_rules_teach_the_templates(spark):
    """Pages that a rule fits are the labels; branches that go on alike share them, so a page that no rule fits is blocked by its neighbours."""
    rows = [(i, f"http://a.example.com/{'de' if i % 2 else 'en'}/{i}") for i in range(60)] + [(100, "http://a.example.com/*/about"), (101, "http://b.test/x"), (102, "http://b.test/1/2/3/4/5/6/abc/7")]
    rows += [(200 + i, f"http://c.example.com/{'/'.join(['d'] * 6)}/{i}.html") for i in range(5)] + [(300, "http://d.test/" + "very/" * 3000 + "long")]
    rows += [(400 + i, f"http://e.example.com/{x}/{i}") for i, x in enumerate(("de", "en"))] + [(500 + i, f"http://f.org/{x}/{i}") for i, x in enumerate(("fr", "fr", "en"))]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[1].template, out[1].verdict, out[0].template, out[0].rule, out[0].verdict) == ("/*/*", "block", "/*/*", None, "block")
    assert out[1].purity < 0.01 and (out[100].template, out[100].verdict) == ("/%2A/about", "block")
    assert {out[200 + i].template for i in range(5)} == {"/d/d/d/d/d/d/*"} and out[102].template == "/*/*/*/*/*/*/abc/*"
    assert out[400].verdict == "block" and [out[k].verdict for k in (101, 102, 200, 300, 401, 502)] == ["allow"] * 6
    assert out[502].purity > 0.5 and out[401].purity > urls.PURITY and out[101].purity == 0.5


def test_a_good_branch_is_kept_on_a_bad_host(spark):
    """Labels that differ keep branches apart, and a branch's own good labels outweigh its host."""
    rows = [(i, f"http://s.example.net/{'en' if i % 5 == 0 else 'xx'}/{i}") for i in range(200)] + [(900, "http://s.example.net/en/more"), (901, "http://s.example.com/xx/1")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[0].template, out[1].template) == ("/en/*", "/xx/*") and out[0].purity > 0.8 and out[1].purity < 0.1
    assert [out[k].verdict for k in (0, 1, 900, 901)] == ["allow", "block", "allow", "allow"]


def test_a_third_of_all_paths_under_one_node(spark):
    """Slugs that no form shows as variables: one node with most children, judged as one branch."""
    rows = [(i, f"http://big.example.com/article/slug-{chr(97 + i % 26)}{i}x") for i in range(500)] + [(600 + i, f"http://big.example.com/de/{i}") for i in range(9)]
    rows += [(1000 + i, f"http://h{i}.test/a/b{i}") for i in range(900)]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(out) == 1409 and len({out[i].template for i in range(500)}) == 1 and {out[i].verdict for i in range(500)} == {"block"}
    assert {out[1000 + i].verdict for i in range(900)} == {"allow"}


def test_no_hot_key_is_shuffled(spark, monkeypatch):
    """Shapes with many pages and shapes with few give the same rows, whichever join they go by."""
    rows = [(i, f"http://a.example.com/de/{i}") for i in range(300)] + [(1000 + i, f"http://h{i}.example.net/s{i}/t") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(map(tuple, urls.judge(pages).collect()))
    monkeypatch.setattr(common, "HOT", 20)
    assert sorted(map(tuple, urls.judge(pages).collect())) == want
