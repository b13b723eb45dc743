"""Vantage-point trees against all inner products."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lanelytics.llm import vp_tree


def brute_force(rows, k):
    usable = {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    result = []
    for q in sorted(i for i in usable if i % 20 == 0):
        scored = []
        for i, v in usable.items():
            if i != q and len(v) == len(usable[q]):
                score = 0.0
                for a, b in zip(usable[q], v):
                    score += float(np.float32(a)) * float(np.float32(b))
                scored.append((-score, i))
        result += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return result


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(2)
    rows = [(i, random.normal(0, 1 + i % 3, 6).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(70)]  # one vector many times
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [float("nan")] * 6), (2004, [None] * 6), (2005, [float("inf")] + [1.0] * 5)]
    return rows + [(None, [1.0] * 6), (2020, [1.0, 2.0]), (2021, [3.0, 1.0]), (2040, [1.0] * 7)]


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, shard string, vector string")
    return vp_tree.nearest(frame, **options)


@pytest.mark.parametrize("shard", [200, 8192])
def test_factor_one_is_exact(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr(vp_tree, "SHARD", shard)
    monkeypatch.setattr(vp_tree, "BLOCK", 16)
    got = found(spark, vectors).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(vectors, 20))


def test_all_candidates_if_fewer_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [1.0, 0.0])]
    assert sorted(map(tuple, found(spark, rows).collect())) == sorted(brute_force(rows, 20))
    assert found(spark, []).count() == 0


def exactly(a, b):
    """The plain sum, or where that leaves the range of doubles the rounded sum of fractions."""
    plain = 0.0
    for x, y in zip(a, b):
        plain += x * y
    if np.isfinite(plain):
        return plain
    whole = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
    try:
        return float(whole)
    except OverflowError:
        return math.inf if whole > 0 else -math.inf


@pytest.mark.parametrize("shard", [150, 8192])
def test_very_large_and_small_components(spark, monkeypatch, shard):
    monkeypatch.setattr(vp_tree, "SHARD", shard)
    monkeypatch.setattr(vp_tree, "LEAF", 32)
    random = np.random.default_rng(6)
    scale = {3: 1e160, 40: 1e160, 60: 1e-160, 61: 1e-310, 80: 1e300, 99: 1e300, 120: 1e200, 7: 1.7e308}
    rows = [(i, (np.clip(random.normal(0, 1, 5), -1, 1) * scale.get(i, 1.0)).tolist()) for i in range(600)]
    rows += [(700, [1e200, 1e200, 0.0, 0.0, 0.0]), (701, [1e200, -1e200, 0.0, 0.0, 0.0])]
    wanted = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-exactly(v, w), i) for i, w in rows if i != q)[:20]
            wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vp_tree.nearest(frame).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(wanted)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(wanted)], rtol=1e-14, atol=0)


def test_repeated_rows_count_one_by_one(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(5, [2.0, 1.0])] * 30 + [(6, [2.0, 5.0])] * 2 + [(6, [1.0, 5.0])] * 40
    got = sorted(map(tuple, found(spark, rows).collect()))
    assert got == [(0, n, 5, 2.0) for n in range(1, 21)]
    few = sorted(map(tuple, found(spark, rows[:5] + rows[-5:]).collect()))
    assert few == [(0, 1, 5, 2.0), (0, 2, 5, 2.0)] + [(0, n, 6, 1.0) for n in range(3, 8)]


def test_a_smaller_factor_visits_less_and_keeps_recall():
    random = np.random.default_rng(8)
    vectors = random.normal(size=(6000, 8))
    tree = vp_tree.Tree.build(np.arange(6000), vectors, leaf=256)
    queries, ids = random.normal(size=(60, 8)), np.arange(10_000, 10_060)
    best = [set(np.argsort(-vectors @ q, kind="stable")[:20].tolist()) for q in queries]

    def search(factor):
        run, seen = vp_tree.Search(tree, ids, queries, 20, factor), 0
        look = run.look

        def counted(rows, begin, end):
            nonlocal seen
            seen += len(rows) * (end - begin)
            look(rows, begin, end)

        run.look = counted
        run.run()
        place = {int(i): n for n, i in enumerate(tree.ids)}
        hits = sum(len(b & set(f.tolist())) for b, f in zip(best, run.found))
        assert place
        return hits / (20 * len(queries)), seen

    exact, all_seen = search(1.0)
    relaxed, seen = search(0.8)
    assert exact == 1.0 and relaxed >= 0.9 and seen < all_seen
