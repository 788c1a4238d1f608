"""Keyed state of the acquisition operators: hosts that are shells, a cache that runs out, event streams in pieces.

All three run on ``transformWithState``; the state lives in Spark's RocksDB store, is kept across restarts of a query and is
read back by :func:`held`. A state is a key's own, so what one key needs from its rows is made small before the exchange where it can be.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webloom.functions.urls import code_permalink, url_host
from webloom.operators.crawl import HOST_PAGES, HOST_SHARE
from webloom.session import ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(df: DataFrame, by: str, processor: StatefulProcessor, out: str, time: str = "None") -> DataFrame:
    """``transformWithState`` in append mode, on the store that it needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship_package(df.sparkSession)
    return df.groupBy(by).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=time)


def run(df: DataFrame, path: str, checkpoint: str) -> None:
    """Takes all that is there, writes the results to ``path`` (each once, restarts included) and ends."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def held(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a state variable holds at the end of the last batch: ``key`` and ``value``, as Spark's state source reads them."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


# --- hosts ------------------------------------------------------------------

HOSTS = "host string, total bigint, shells bigint, force_render boolean"


def forced(total: int, shells: int) -> bool:
    return total >= HOST_PAGES and shells / total > HOST_SHARE


class Hosts(StatefulProcessor):
    """Counts a host's pages and shells; says once that it is rendered from now on, and once if it no longer is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total bigint, shells bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, shells = self.counts.get() or (0, 0)
        before = forced(total, shells) if total else False
        for r in rows:
            total, shells = total + r.total, shells + r.shells
        self.counts.update((total, shells))
        if forced(total, shells) != before:
            yield Row(host=key[0], total=total, shells=shells, force_render=not before)

    def close(self) -> None:
        pass


def host_states(pages: DataFrame) -> DataFrame:
    """A row of ``(host, total, shells, force_render)`` whenever a host begins or ceases to be rendered throughout; ``pages(url, js_detection)``.

    Pages are counted by host within each Arrow batch first, so that a host with a third of all pages sends a row a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table({"host": b.column(0), "shell": b.column(1)}).group_by("host").aggregate([("shell", "count"), ("shell", "sum")])
            yield pa.RecordBatch.from_arrays([t["host"].combine_chunks(), t["shell_count"].combine_chunks(), t["shell_sum"].combine_chunks().cast(pa.int64())], ["host", "total", "shells"])

    shell = F.when(F.col("js_detection") == "likely_shell", 1).otherwise(0).cast("long")
    some = pages.select(url_host(F.coalesce("url", F.lit(""))).alias("host"), shell.alias("shell")).mapInArrow(count, "host string, total bigint, shells bigint")
    return keyed(some, "host", Hosts(), HOSTS)


# --- a cache that runs out ----------------------------------------------------

EXPIRY = "key string, at bigint, kind string"


ANSWERS = "keys array<string>, ats array<bigint>, kinds array<string>"
#: Requests in an element of the list of those that wait, and answers in a row.
HELD = 1000


class Expiry(StatefulProcessor):
    """Requests of a group of keys, each key's in the order of their times, however they come in: each is a hit or a miss that stores the page; what runs out is evicted.

    A request waits until the watermark has passed it. Times are microseconds, timers and watermarks milliseconds.
    Each call of a state is a message to Spark, and each element of a list is packed by itself. So a group has one timer, at the earliest moment it
    has an answer, its states are read and written at most once when that comes, and requests that wait stand by the thousand in an element.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, keys array<string>, ats array<bigint>")
        self.entry = handle.getValueState("entry", "keys array<string>, stored array<bigint>")

    @staticmethod
    def element(some: list[tuple[str, int]]) -> tuple[int, list[str], list[int]]:
        """Requests that wait, behind the earliest of their times."""
        keys, ats = map(list, zip(*some, strict=True))
        return min(ats), keys, ats

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        least = None
        while some := [(r.key, r.at) for r in islice(rows, HELD)]:
            new = self.element(some)
            self.waiting.appendValue(new)
            least = new[0] if least is None else min(least, new[0])
        if least is not None:
            known = list(self.handle.listTimers())
            if not known or least // 1000 < min(known):
                for t in known:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(least // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = {}, []
        for _, keys, ats in self.waiting.get():
            for k, at in zip(keys, ats, strict=True):
                if at < until:
                    due.setdefault(k, []).append(at)
                else:
                    later.append((k, at))
        before = dict(zip(*(self.entry.get() or ((), ())), strict=True))
        after, out = {}, []
        for k in before | due:
            stored = before.get(k)
            for at in sorted(due.get(k, ())):
                if stored is not None and at - stored > self.ttl:
                    out.append((k, stored + self.ttl, "evict"))
                    stored = None
                out.append((k, at, "miss" if stored is None else "hit"))
                stored = at if stored is None else stored
            if stored is not None and stored + self.ttl < until:
                out.append((k, stored + self.ttl, "evict"))
            elif stored is not None:
                after[k] = stored
        if after and after != before:
            self.entry.update((list(after), list(after.values())))
        elif before and not after:
            self.entry.clear()
        if due and later:
            self.waiting.put([self.element(later[i : i + HELD]) for i in range(0, len(later), HELD)])
        elif due:
            self.waiting.clear()
        if after or later:
            following = [at for _, at in later] + [stored + self.ttl for stored in after.values()]
            self.handle.registerTimer(min(following) // 1000)
        for i in range(0, len(out), HELD):
            keys, ats, kinds = map(list, zip(*out[i : i + HELD], strict=True))
            yield Row(keys=keys, ats=ats, kinds=kinds)

    def close(self) -> None:
        pass


def cache_traffic(requests: DataFrame, ttl_seconds: int, time: str = "ts", delay: str = "1 day", groups: int | None = None) -> DataFrame:
    """``(key, at, kind)``: hit, miss or evict for ``requests(key, <time>)``, as a cache with this time to live has them.

    A page is stored at its miss and serves requests up to and with its ttl; it is evicted at that moment, by a timer or by the miss
    that finds it gone. Requests may come late by ``delay``; answers come once the watermark has passed them. Pages that are held are in the
    state ``entry``, requests that wait in ``waiting``. The answers to one key depend on each other, so a key is one task's.

    A state is a key's own, at some milliseconds a key and batch for its messages; with ``groups`` it is that of all keys whose hash falls together, which share
    these, and what a group holds is read whole: take as many as keep that to some ten thousand requests.
    """
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts")).where("key is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    if groups is None:
        out = keyed(rows, "key", Expiry(ttl_seconds * 1_000_000), ANSWERS, "EventTime")
    else:
        out = keyed(rows.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(groups))), "share", Expiry(ttl_seconds * 1_000_000), ANSWERS, "EventTime")
    return out.select(F.inline(F.arrays_zip("keys", "ats", "kinds"))).toDF("key", "at", "kind")


# --- event streams in pieces ----------------------------------------------------

MATCH = "response_id bigint, pos int, repo string, path string, line int, snippet string, language string, stars int"


def _of(value: object, kind: type) -> object:
    return value if isinstance(value, kind) and not isinstance(value, bool) else None


def matches_of(data: bytes) -> list[dict]:
    """Content matches with at least one line in a ``data:`` line; one that isn't JSON has none."""
    try:
        found = json.loads(data)
    except ValueError:
        return []
    out = []
    for m in found if isinstance(found, list) else [found]:
        lines = m.get("lineMatches") if isinstance(m, dict) and m.get("type") == "content" else None
        if isinstance(lines, list) and lines:
            first = lines[0] if isinstance(lines[0], dict) else {}
            text = {k: _of(m.get(k), str) or "" for k in ("repository", "path", "language")}
            out.append(text | {"stars": _of(m.get("repoStars"), int) or 0, "line": _of(first.get("lineNumber"), int) or 0, "snippet": _of(first.get("line"), str) or ""})
    return out


class Events(StatefulProcessor):
    """One response: the pieces in their order, what is open at a border carried over to the next piece, nothing read beyond the limit."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seq bigint, rest binary, event string, found int")
        self.early = handle.getMapState("early", "seq bigint", "piece binary, last boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.open.get()
        seq, rest, event, found = known or (0, b"", "", 0)
        if found >= self.limit:
            for _ in rows:
                pass
            return
        # Each call of a state is a message to Spark: whether pieces wait is asked once, and never of a response that is new.
        waiting = bool(known) and self.early.exists()
        for r in rows:
            if found >= self.limit:
                continue
            if r.seq > seq:
                self.early.updateValue((r.seq,), (bytes(r.piece), r.last))
                waiting = True
                continue
            piece = (bytes(r.piece), r.last) if r.seq == seq else None
            while piece is not None and found < self.limit:
                rest, event, results = self.feed(bytes(rest) + piece[0], piece[1], event, self.limit - found)
                for m in results:
                    yield Row(response_id=key[0], pos=found, repo=m["repository"], path=m["path"], line=m["line"], snippet=m["snippet"], language=m["language"], stars=m["stars"])
                    found += 1
                seq += 1
                piece = self.early.getValue((seq,)) if waiting and self.early.containsKey((seq,)) else None
                if piece is not None:
                    self.early.removeKey((seq,))
        if found >= self.limit:
            rest = b""
            if waiting:
                self.early.clear()
        self.open.update((seq, bytes(rest), event, found))

    @staticmethod
    def feed(data: bytes, last: bool, event: str, limit: int) -> tuple[bytes, str, list[dict]]:
        """What is left open, the type that holds, and the next results, at most ``limit``: lines after the last of these aren't read."""
        at, out = 0, []
        while len(out) < limit:
            end = data.find(b"\n", at)
            if end < 0 and not (last and at < len(data)):
                break
            line = data[at : end if end >= 0 else len(data)]
            at = end + 1 if end >= 0 else len(data)
            line = line[:-1] if end >= 0 and line.endswith(b"\r") else line
            if line.startswith(b"event:"):
                event = line[6:].decode("utf-8", "replace").strip()
            elif line.startswith(b"data:") and event == "matches":
                out += matches_of(line[5:])
        return data[at:], event, out[:limit]

    def close(self) -> None:
        pass


def code_events(pieces: DataFrame, limit: int, base_url: str) -> DataFrame:
    """Results of event streams that come in pieces ``(response_id, seq, piece binary, last boolean)``, cut anywhere, in any order: those of ``code.sourcegraph_results``.

    A piece that comes before its turn waits in the state. Once a response has ``limit`` results its later pieces are passed over unread.
    """
    rows = pieces.select("response_id", "seq", "piece", "last").where("response_id is not null and piece is not null")
    out = keyed(rows, "response_id", Events(limit), MATCH)
    url: Column = code_permalink(F.lit(base_url), F.col("repo"), F.col("path"), F.col("line"))
    return out.withColumn("url", url).withColumn("source", F.lit("sourcegraph"))
