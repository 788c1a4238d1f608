"""Keyed state gives what the batch forms give, across restarts too."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.sources import code
from webloom.streaming import state


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a streaming form over parts of rows, the query started anew for each part; gives its results and its checkpoint."""

    def go(parts, schema, form):
        src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
        for part in parts:
            spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(src)
            state.run(form(spark.readStream.schema(schema).parquet(src)), out, cp)
        return spark.read.parquet(out), cp

    return go


def test_host_states(spark, stream):
    rows = [(f"http://{h}/{i}", d) for i in range(12) for h, d in (("s", "likely_shell"), ("p", "static"), ("m", "likely_shell" if i < 9 else "static"))]
    rows += [("http://few/1", "likely_shell"), (None, "static")]
    schema = "url string, js_detection string"
    got, cp = stream([rows[:15], rows[15:31], rows[31:]], schema, state.host_states)
    told = sorted((r.host, r.total, r.shells, r.force_render) for r in got.collect())
    assert [t for t in told if t[0] == "s"] == [("s", 10, 10, True)] or [t[:1] + t[3:] for t in told if t[0] == "s"] == [("s", True)]
    assert [t[3] for t in sorted(told, key=lambda t: t[1]) if t[0] == "m"] in ([], [True, False]) and not [t for t in told if t[0] in ("p", "few", "")]
    kept = state.held(spark, cp, "counts").select("key.host", "value.total", "value.shells")
    want = crawl.host_stats(spark.createDataFrame([(u or "", d) for u, d in rows], schema)).select("host", "total", "shells")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


def cached(requests, ttl, until):
    """The same by a walk over each key's times."""
    out = []
    for k in {k for k, _ in requests}:
        stored = None
        for at in sorted(t for x, t in requests if x == k and t < until):
            if stored is not None and at - stored > ttl:
                out.append((k, stored + ttl, "evict"))
                stored = None
            out.append((k, at, "miss" if stored is None else "hit"))
            stored = at if stored is None else stored
        if stored is not None and stored + ttl < until:
            out.append((k, stored + ttl, "evict"))
    return sorted(out)


def test_cache_traffic(spark, stream):
    hour = 3600
    times = [("a", 0), ("b", 5), ("a", 90), ("a", 100), ("a", 101), ("a", 102), ("b", 3 * hour), ("c", 3 * hour + 1), ("c", 3 * hour + 1), ("a", 3 * hour + 50), ("b", 2 * hour + 59 * 60), ("z", 9 * hour), ("b", 9 * hour + 1)]
    times = [(k, s + 24 * hour) for k, s in times]
    parts = [times[:4], times[4:7], times[7:]]
    form = lambda df: state.cache_traffic(df.withColumn("ts", F.timestamp_seconds("s")), 100, delay="1 hour")
    got, cp = stream(parts, "key string, s long", form)
    until = (32 * hour + 1) * 10**6
    want = cached([(k, s * 10**6) for k, s in times], 100 * 10**6, until)
    assert sorted(map(tuple, got.collect())) == want
    assert {(r.key.key, r.list_element.at) for r in state.held(spark, cp, "waiting").collect()} == {(k, s * 10**6) for k, s in times if s * 10**6 >= until}
    assert state.held(spark, cp, "entry").where("value is not null").count() == 0


def body(i, n):
    found = [{"type": "content" if k % 4 else "path", "repository": f"r{i}", "path": "ä/é.py", "language": "Go", "repoStars": k, "lineMatches": [{"line": f"línea {k}", "lineNumber": k}]} for k in range(n)]
    lines = ["data: [1]", "event: progress", 'data: {"done": false}', "event: matches", f"data: {json.dumps(found[: n // 2], ensure_ascii=False)}\r", "data: not json", "", f"data:{json.dumps(found[n // 2 :])}", "event: done", "data: []"]
    return "\n".join(lines)


@pytest.mark.parametrize("limit", [3, 100])
def test_code_events_of_any_pieces(spark, stream, limit):
    bodies = {i: body(i, n) for i, n in enumerate((0, 1, 7, 23))}
    pieces = []
    for i, b in bodies.items():
        raw, size = b.encode(), (1 + 6 * i) if i else 10**6
        cut = [raw[at : at + size] for at in range(0, len(raw), size)]
        pieces += [(i, k, p, k == len(cut) - 1) for k, p in enumerate(cut)]
    pieces = pieces[::-1][::2] + pieces[::-1][1::2] if limit == 3 else pieces  # in any order
    half = len(pieces) // 2
    got, _ = stream([pieces[:half], pieces[half:]], "response_id long, seq long, piece binary, last boolean", lambda df: state.code_events(df, limit, "https://sourcegraph.com"))
    want = code.sourcegraph_results(spark.createDataFrame(list(bodies.items()), "response_id long, body string"), limit)
    order = lambda df: sorted(map(tuple, df.select(*code.COLUMNS).collect()))
    assert order(got) == order(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=8), st.integers(1, 12))
def test_borders_and_limit(cuts, limit):
    """Any cuts give the same results; what comes after the last of them stays unread."""
    raw = body(1, 9).encode()
    whole = state.Events.feed(raw, True, "", limit)[2]
    rest, event, out, read = b"", "", [], 0
    edges = sorted({0, len(raw), *(c for c in cuts if c < len(raw))})
    for a, b in zip(edges, edges[1:], strict=False):
        if len(out) >= limit:
            break
        read = b
        rest, event, some = state.Events.feed(rest + raw[a:b], b == len(raw), event, limit - len(out))
        out += some
    assert out == whole and len(out) <= limit
    if len(out) == limit and read < len(raw):
        assert len(state.Events.feed(raw[:read], False, "", limit)[2]) == limit


def test_finished_responses_send_one_message():
    """A state's calls are messages to Spark: two for a new response that ends in its first piece, one for the pieces after it."""
    from types import SimpleNamespace as Piece

    calls, kept = [], {}

    class Open:
        def get(self):
            calls.append("get")
            return kept.get("open")

        def update(self, value):
            calls.append("update")
            kept["open"] = value

    class Early:
        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    events = state.Events(1)
    events.open, events.early = Open(), Early()
    piece = b'event: matches\ndata: [{"type": "content", "lineMatches": [{"line": "x", "lineNumber": 1}]}]\n'
    assert [r.snippet for r in events.handleInputRows((7,), iter([Piece(seq=0, piece=piece, last=False)]), None)] == ["x"]
    assert list(events.handleInputRows((7,), iter([Piece(seq=1, piece=piece, last=True)]), None)) == []
    assert calls == ["get", "update", "get"]
