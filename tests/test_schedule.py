"""Clash filters and rate windows against plain folds, on dense and hot keys."""

import random

import pytest

from quern import storage
from quern.operators import intervals, planning


def plain_clashes(proposals, fixed):
    held, out = [(i, s, e) for _, i, s, e in sorted(fixed)], []
    for _, i, s, e in sorted(proposals, key=lambda x: (x[0], x[1])):
        if s is None:
            out.append((i, True, None))
            continue
        mine = any(h[0] == i for h in held)
        hit = next((h[0] for h in held if h[0] != i and h[1] < e and s < h[2]), None)
        out.append((i, mine or hit is None, None if mine else hit))
        if not mine and hit is None:
            held.append((i, s, e))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clash_filter_with_fixed_points(spark, seed):
    rnd = random.Random(seed)
    slot = lambda n: (s := rnd.randrange(n), s + rnd.randrange(1, 90))
    proposals, fixed, want = [], [], []
    for person, n in (("hot", 400), ("calm", 6), ("other", 30)):
        p = [(rnd.randrange(50), i, *slot(n * 20)) for i in range(n)] + [(7, 100_000, None, None)]
        f = [(i, 1000 + i, *slot(n * 20)) for i in range(n // 6)]
        p += [(3, *f[0][1:]), (4, *p[0][1:])] if f else []  # one that is planned already, one proposed twice
        proposals += [(person, *x) for x in p]
        fixed += [(person, *x) for x in f]
        want += [(person, *x) for x in plain_clashes(p, f)]
    schema = "person string, nth long, id long, s long, e long"
    got = intervals.clash_filter(spark.createDataFrame(proposals, schema), ["person"], spark.createDataFrame(fixed, schema))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_islands_end_where_nothing_goes_on(spark):
    slots = spark.createDataFrame([(1, 0, 700), (2, 10, 20), (3, 650, 660), (4, 700, 710), (5, 705, 706), (6, 5000, 5001)], "id long, s long, e long").selectExpr("1 as k", "*")
    assert {r.id: r.island for r in intervals.islands(slots, ["k"], 60).collect()} == {1: 0, 2: 0, 3: 0, 4: 700, 5: 700, 6: 5000}


@pytest.mark.parametrize("seed", range(3))
def test_rate_windows_of_a_busy_key(spark, seed):
    rnd = random.Random(seed)
    hits = [("hot", i, rnd.randrange(60_000)) for i in range(2500)] + [("calm", 9000 + i, rnd.randrange(10**6)) for i in range(40)] + [("tie", 9900 + i, 5) for i in range(7)] + [("edge", 9950 + i, i * 1000) for i in range(9)]
    want, state = set(), {}
    for key, i, s in sorted(hits, key=lambda x: (x[2], x[1])):
        start, n = state.get(key, (None, 0))
        start, n = (s, 0) if start is None or s - start >= 1000 else (start, n)
        state[key] = (start, n + 1)
        want.add((key, i, s, n < 4))
    got = intervals.rate_limited(spark.createDataFrame(hits, "key string, id long, s long"), ["key"], 4, 1000)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nothing_at_all(spark):
    none = spark.createDataFrame([], "key string, nth long, id long, s long, e long")
    assert intervals.rate_limited(none.select("key", "id", "s"), ["key"], 4, 1000).count() == 0 == intervals.clash_filter(none, ["key"], none).count()


def test_fallback_of_many_rows_is_dealt_to_more_tasks(spark, monkeypatch):
    """Tasks grow in number with the rows, beyond the session's setting, and the plan is the same."""
    rnd = random.Random(8)
    records = spark.createDataFrame([(i, *((i % 3, s := rnd.randrange(500), s + 30) if i % 4 else (None, None, None))) for i in range(60)], "id long, day long, s long, e long")
    picks = spark.createDataFrame([(rnd.randrange(20), rnd.randrange(70), i) for i in range(800)], "person long, id long, nth long")
    plans = spark.createDataFrame([(rnd.randrange(20), rnd.randrange(70)) for _ in range(60)], "person long, id long")
    want = sorted(map(str, planning.fallback(picks, plans, records).collect()))
    monkeypatch.setattr(storage, "SHARE", 100)
    out = planning.fallback(picks, plans, records, 860)
    assert sorted(map(str, out.collect())) == want and any("clash=None" not in x for x in want)
    assert out.rdd.getNumPartitions() >= 9 > int(spark.conf.get("spark.sql.shuffle.partitions"))
