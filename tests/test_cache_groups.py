"""Keys that share a state have the answers that each has by itself, and share its timer and its messages."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from tests.test_state import cached, stream  # noqa: F401
from webloom.streaming import state


def test_groups_of_keys(spark, stream):  # noqa: F811
    """Many keys in few groups, requests at a page's last moment and at the very watermark, and late ones, in three runs."""
    rng = random.Random(7)
    day = 86400
    parts = [[(f"k{rng.randrange(40)}", day * (1 + run) + rng.randrange(day)) for _ in range(300)] for run in range(3)]
    parts[0] += [("edge", day), ("edge", day + 100), ("edge", day + 100), ("edge", day + 201), ("mark", 2 * day - 3600)]
    parts[0].append(("last", 2 * day))
    parts[2].append(("last", 5 * day))
    form = lambda df: state.cache_traffic(df.withColumn("ts", F.timestamp_seconds("s")), 100, delay="1 hour", groups=3)
    got, cp = stream(parts, "key string, s long", form)
    until = (5 * day - 3600) * 10**6
    late = [(k, s) for part, mark in ((parts[1], 2 * day - 3600), (parts[2], max(s for _, s in parts[0] + parts[1]) - 3600)) for k, s in part if s < mark]
    assert not late
    assert sorted(map(tuple, got.collect())) == cached([(k, s * 10**6) for part in parts for k, s in part], 100 * 10**6, until)
    held = state.held(spark, cp, "waiting").select(F.explode("list_element.keys")).collect()
    assert [r[0] for r in held] == ["last"]


class Calls:
    """A handle with its states in memory, which counts the calls."""

    def __init__(self):
        self.n, self.timers, self.lists, self.value = 0, set(), [], None
        count = lambda f: lambda *a: (setattr(self, "n", self.n + 1), f(*a))[1]
        self.listTimers, self.registerTimer, self.deleteTimer = count(lambda: sorted(self.timers)), count(self.timers.add), count(self.timers.discard)
        put = lambda new: setattr(self, "lists", new)
        hold = lambda new: setattr(self, "value", new)
        self.waiting = SimpleNamespace(appendValue=count(lambda x: self.lists.append(x)), get=count(lambda: list(self.lists)), put=count(put), clear=count(lambda: put([])))
        self.entry = SimpleNamespace(get=count(lambda: self.value), update=count(hold), clear=count(lambda: hold(None)))

    def getListState(self, *_):
        return self.waiting

    def getValueState(self, *_):
        return self.entry


def test_a_group_has_one_timer_and_few_messages():
    calls, expiry = Calls(), state.Expiry(100)
    expiry.init(calls)
    rows = [SimpleNamespace(key=f"k{i % 50}", at=1000 * i) for i in range(500)]
    assert list(expiry.handleInputRows(("g",), iter(rows[250:]), None)) == []
    assert list(expiry.handleInputRows(("g",), iter(rows[:250]), None)) == []
    assert calls.timers == {0} and calls.n == 7
    calls.n = 0
    until = 400
    told = list(expiry.handleExpiredTimer(("g",), SimpleNamespace(getCurrentWatermarkInMs=lambda: until), None))
    got = sorted(x for r in told for x in zip(r.keys, r.ats, r.kinds, strict=True))
    assert got == cached([(r.key, r.at) for r in rows], 100, until * 1000)
    assert calls.n <= 5 and calls.timers == {0, until}
