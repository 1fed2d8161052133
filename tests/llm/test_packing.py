import itertools

import numpy as np
import pytest
from logloom.llm import packing


def covered(plan, histogram, full):
    """Checks that a plan has a place for each item, and returns how full its containers are."""
    got, fill = {}, np.zeros(plan.containers, int)
    for b, start, n, c in zip(plan.bin, plan.start, plan.count, plan.container, strict=True):
        assert start == got.get(b, 0)
        got[b] = start + n
        fill[c : c + n] += b
    assert got == {b: n for b, n in histogram.items() if n}
    assert plan.containers == 0 or (fill.max() <= full and fill.min() > 0)
    return fill


@pytest.mark.parametrize("seed", range(5))
def test_plans_cover_all_items(seed):
    rng = np.random.default_rng(seed)
    full = [4, 10, 64][seed % 3]
    for n in (1, 3, 500, 20_000):
        bins, counts = np.unique(np.clip(rng.lognormal(np.log(full / 3), 0.8, n).astype(int) + 1, 1, full), return_counts=True)
        histogram = dict(zip(bins.tolist(), counts.tolist(), strict=True))
        fill = covered(packing.make_plan(histogram, full, 1), histogram, full)
        if n == 20_000:
            assert fill.sum() / (len(fill) * full) > 0.97


def test_plans_of_odd_histograms():
    for histogram in ({}, {1: 10**9}, {6: 1000, 5: 1}, {10: 7}, {3: 10**9, 4: 10**9, 7: 5, 10: 1}):
        fill_cheap = packing.make_plan(histogram, 10, 1)
        assert fill_cheap.containers >= -(-sum(b * n for b, n in histogram.items()) // 10)
        if fill_cheap.containers < 10**5:
            covered(fill_cheap, histogram, 10)


def test_least_squares_is_no_worse_than_any_choice_nearby():
    combos = packing.combinations(np.arange(1, 7), 6)
    assert {tuple(c[c > 0]) for c in combos} == {c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 7), k) if sum(c) == 6}
    target = np.array([0, 30, 11, 25, 7, 9, 4])
    x = packing.nnls(combos, target)
    a = np.zeros((7, len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], c[c > 0], 1)
    error = lambda y: ((a @ y - target) ** 2).sum()
    assert x.min() >= 0
    for j in range(len(x)):
        for d in (-0.3, -0.01, 0.01, 0.3):
            y = x.copy()
            y[j] = max(0.0, y[j] + d)
            assert error(x) <= error(y) + 1e-6


def test_pack(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(n)) for i, n in enumerate(np.clip(rng.lognormal(3.5, 1, 600), 0, 900))]
    sizes += [(1000 + i, 0) for i in range(300)] + [(2000, 1000), (2001, 200), (2002, 201), (2003, None), (2003, None), (2003, 40), (None, 41), (2004, -5)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").selectExpr("*", "'x' AS bin", "'x' AS slice", "0 AS container")
    got = packing.pack(df, capacity=200, grain=4).collect()
    whole, fill = {}, {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append(r["length"])
        fill[r["container"]] = fill.get(r["container"], 0) + r["length"]
        assert r["part"] == 0 or r["length"] <= 200
    asked = {}
    for i, n in sizes:
        asked.setdefault(i, []).append(max(n or 0, 0))
    assert {i: sum(v) for i, v in whole.items()} == {i: sum(v) for i, v in asked.items()}
    assert sorted(whole[2000]) == [200] * 5 and sorted(whole[2002]) == [1, 200] and whole[2001] == [200] and sorted(whole[2003]) == [0, 0, 40]
    assert len(got) == sum(max(1, -(-n // 200)) for v in asked.values() for n in v)
    assert max(fill.values()) <= 200
    assert sum(fill.values()) / (200 * len(fill)) > 0.93


def test_pack_of_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long")
    assert [tuple(r)[2:] for r in packing.pack(df).collect()] == [(0, 0), (0, 0)]
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=100, grain=8)
