import math

import numpy as np
import pytest

from quern.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows):
    whole = [(i, (b + 1) % 10 if i % 7 == 0 else b, tuple(math.floor(256 * x) for x in v)) for i, v, b in rows if i is not None and b is not None and fine(v)]
    out = []
    for a in sorted({r for r in whole if r[0] % 100 == 0}):
        met = [(sum(x * y for x, y in zip(a[2], r[2], strict=True)), r) for r in whole if r[0] != a[0] and len(r[2]) == len(a[2])]
        order = lambda x: (-x[0], x[1][0])
        for score, p in sorted((x for x in met if x[1][1] == a[1]), key=order)[:5]:
            near = sorted((x for x in met if x[1][1] != a[1] and 80 * score <= 100 * x[0] <= 100 * score), key=order)[:5]
            out += [(a[0], p[0], n + 1, r[0], score, s) for n, (s, r) in enumerate(near)]
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'clash' as id", "0L as n", "'x' as v", "1 as window")
    got = sorted(map(tuple, hn.op11(frame).collect()))
    assert got == brute([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], b) for i, v, b in rows])
    return got


def vectors(n, seed, dim=8, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    return [(int(i), [float(x) for x in np.float32(base + spread * rng.normal(size=dim))], int(rng.integers(0, 3))) for i in range(n)]


def test_brute_force(spark):
    assert len(check(spark, vectors(350, 1))) > 20
    assert check(spark, vectors(350, 2, spread=0.05))


@pytest.mark.parametrize(("few", "digit"), [(5, 1), (1, 2), (5, 6)])
def test_every_digit_is_refined(spark, monkeypatch, few, digit):
    """With few rows gathered, scores and then ids are cut down to the last digit."""
    monkeypatch.setattr(hn, "FEW", few)
    monkeypatch.setattr(hn, "DIGIT", digit)
    ties = [(i, [1.0, 0.5, 0.25, 0.0], i % 3) for i in range(-60, 260)]  # one very common vector, ids on both sides of 0
    assert len(check(spark, ties + [(1000 + i, v[:4], b) for i, v, b in vectors(40, 3, spread=0.1)])) > 20


def test_passes_and_repeated_rows(spark, monkeypatch):
    rows = vectors(300, 4, spread=0.2)
    want = check(spark, rows)
    monkeypatch.setattr(hn, "PASS_WINDOWS", 5)
    assert check(spark, rows) == want
    monkeypatch.setattr(hn, "FEW", 2)
    copies = [(7 * i + 1, rows[0][1], 1) for i in range(30)] + [(555, rows[0][1], 2)] * 200
    check(spark, [(0, rows[0][1], 4), (5, rows[0][1], 5), *copies])


def test_odd_rows(spark):
    odd = [
        (0, [1.0, 2.0], 3), (100, [1.0, 2.0], 3), (None, [1.0, 2.0], 4), (1, None, 4), (2, [1.0, 2.0], None), (3, [1.0, None], 4), (4, [float("nan"), 1.0], 4),
        (5, [float("inf"), 1.0], 4), (6, [1.0], 3), (200, [], 1), (8, [], 1), (9, [], 2), (10, [1.0, 2.0], 4), (11, [0.9, 1.9], 4), (14, [1.0, 2.0], 2), (300, [-1.0, -2.0], 3),
        (12, [70000.0, 1.0], 3), (13, [60000.0, 1.0], 4), (700, [1.0, 2.0], 9), (0, [1.0, 2.0], 3),
    ]
    assert check(spark, odd)
    assert hn.op11(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.op11(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (9, 1 << 20, 1 << 28):
        a, b = rng.integers(-most, most, (3, 4)), rng.integers(-most, most, (5, 4))
        assert (hn.products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])).all()
    with pytest.raises(ArithmeticError):
        hn.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
