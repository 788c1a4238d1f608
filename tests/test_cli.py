"""The command line against a server on this machine."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from webloom import cli

PROSE = "<p>" + "Plain words that say enough to be read by anyone who comes to this page. " * 4 + "</p>"
SITE = {
    "/": ("text/html", f'<title>Home</title><article><h1>Home</h1>{PROSE}<a href="/a">a</a> <a href="/b#x">b</a></article>'),
    "/a": ("text/html", f'<title>A</title><article><h1>A</h1>{PROSE}<a href="/gone">gone</a></article>'),
    "/b": ("text/html", f'<title>B</title><article><h1>B</h1>{PROSE}<a href="/">home</a></article>'),
    "/map.xml": ("application/xml", "<urlset><url><loc>{base}/a</loc></url></urlset>"),
    "/search": ("application/json", '{{"results":[{{"title":"Hit","url":"{base}/a","content":"found <it>"}},{{"title":"Dead","url":"{base}/gone","content":"x"}}]}}'),
}


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path.split("?")[0]
            asked.append(path)
            kind, body = SITE.get(path, ("text/plain", None))
            base = f"http://127.0.0.1:{self.server.server_address[1]}"
            data = b"" if body is None else (body.format(base=base) if "{base}" in body else body).encode()
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


@pytest.fixture
def run(spark, server, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "CACHE", str(tmp_path / "cache"))
    monkeypatch.setattr(cli, "CONFIG", str(tmp_path / "config.json"))
    monkeypatch.setattr("sys.stdin.isatty", lambda: True, raising=False)

    def go(*args):
        capsys.readouterr()
        cli.main([str(a) for a in args])
        return capsys.readouterr()

    return go


def test_scrape_keeps_pages(run, server):
    base, asked = server
    out = run("scrape", f"{base}/a", f"{base}/gone")
    assert "title: A" in out.out and "# A" in out.out and "warn: HTTP 404" in out.err
    n = asked.count("/a")
    again = run("scrape", f"{base}/a", "--trim", "--max-chars", 20)
    assert asked.count("/a") == n and "[truncated]" in again.out and "# A" not in again.out
    assert "# A" in run("scrape", f"{base}/a", "--no-cache", "--no-llms-txt").out and asked.count("/a") == n + 1
    assert run("scrape", f"{base}/a", "--raw").out.startswith("<title>A</title>")
    assert run("scrape", f"{base}/b", "--select", "h1").out.rstrip().endswith("# B")


def test_search_with_content(run, server):
    base, _ = server
    plain = run("search", "words", "--backend", "searxng", "--searxng-url", base)
    assert "Hit" in plain.out and "Dead" in plain.out
    assert plain.out.startswith("---\nquery: words\nbackend: searxng\nresult_count: 2\n---\n")
    rows = [json.loads(x) for x in run("search", "words", "--backend", "searxng", "--searxng-url", base, "--scrape", "--json", "--trim").out.splitlines()]
    assert [r["title"] for r in rows] == ["Hit", "Dead"] and rows[0]["content"].startswith("A\n") and "content" not in rows[1]
    text = run("search", "words", "--backend", "searxng", "--searxng-url", base, "--scrape").out
    assert "title: A" in text and "Dead" not in text


def test_crawl(run, server):
    base, asked = server
    asked.clear()
    out = run("crawl", f"{base}/", "--depth", 2, "--no-cache")
    rows = {r["url"].removeprefix(base): r for r in map(json.loads, out.out.splitlines())}
    assert {k: (r["depth"], r["status"]) for k, r in rows.items()} == {"": (0, "new"), "/a": (1, "new"), "/b": (1, "new"), "/gone": (2, None)}
    assert "pages: 3" in out.err and sorted(asked) == ["/", "/a", "/b", "/gone"]
    asked.clear()
    kept = [{r["url"].removeprefix(base): r["status"] for r in map(json.loads, run("crawl", f"{base}/", "--depth", 1).out.splitlines())} for _ in range(2)]
    assert kept == [{"": "new", "/a": "new", "/b": "new"}, {"": "unchanged"}] and sorted(asked) == ["/", "/a", "/b"]
    mapped = run("crawl", f"{base}/map.xml", "--sitemap", "--depth", 0)
    assert [json.loads(x)["source"] for x in mapped.out.splitlines()] == ["sitemap"]


def test_background_crawl(run, server, tmp_path, monkeypatch):
    base, _ = server
    started = []
    monkeypatch.setattr(cli.subprocess, "Popen", lambda args, env, **_: started.append((args, env[cli.WORKER])))
    job = run("crawl", f"{base}/", "--background", "--depth", 1, "--no-cache").out.strip()
    (args, given), = started
    assert given == job and "--background" not in args and json.loads(run("crawl", "status", job).out)["status"] == "starting"
    monkeypatch.setenv(cli.WORKER, job)
    monkeypatch.setattr(cli.signal, "signal", lambda *_: None)
    run(*args[3:])
    monkeypatch.delenv(cli.WORKER)
    for _ in range(50):
        status = json.loads(run("crawl", "status").out)
        if status["status"] == "completed":
            break
        time.sleep(0.1)
    assert status["status"] == "completed" and (status["id"], status["pages"]) == (job, 3)
    with pytest.raises(ValueError, match="not running"):
        run("crawl", "stop", job)


def test_local_docs_and_config(run, tmp_path):
    for name, text in (("a.md", "# Harbour guide\nboats and boats"), ("b.txt", "Trains.\nNo boats at all, but trains"), ("c.txt", "nothing")):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    out = run("docs", "boats harbour", "--backend", "local", "--path", tmp_path / "docs").out
    assert out.index("a.md") < out.index("b.txt") and "# Harbour guide" in out and "c.txt" not in out
    with pytest.raises(SystemExit, match="--path"):
        run("docs", "x", "--backend", "local")
    assert run("config", "path").out.strip() == str(tmp_path / "config.json")
    assert "created" in run("config", "init").err
    with pytest.raises(SystemExit, match="exists"):
        run("config", "init")
    assert json.loads(run("config", "limit", "7").out)["limit"] == 7
