"""Weighted mixture (bucketed exact top-k) against a brute-force ranking."""
import hashlib
import math

import pytest

from corpusgate.operators.mixture import quotas, weighted_mixture


def brute(rows, weights, seed):
    counts = {}
    for s, _ in rows:
        counts[s] = counts.get(s, 0) + 1
    n = min(math.floor(counts[s] / w) for s, w in weights.items())
    base = {s: math.floor(w * n) for s, w in weights.items()}
    rem = sorted(weights, key=lambda s: (-(weights[s] * n - base[s]), s))
    deficit = n - sum(base.values())
    quota = {s: base[s] + (1 if i < deficit and base[s] + 1 <= counts[s] else 0) for i, s in enumerate(rem)}
    picked = set()
    for s in weights:
        ids = sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for src, i in rows if src == s)
        picked |= {(s, i) for _, i in ids[:quota[s]]}
    return picked


def test_skewed_mixture_matches_brute_force(spark):
    # one hot source holds 90% of the rows
    rows = [("hot" if i % 10 else ("a" if i % 20 else "b"), i) for i in range(6000)]
    weights = {"hot": 0.6, "a": 0.25, "b": 0.15}
    df = spark.createDataFrame(rows, "source string, id long")
    w = spark.createDataFrame(list(weights.items()), "source string, weight double")
    got = {(r.source, r.row_id) for r in weighted_mixture(df, "source", "id", w, seed="3").collect()}
    assert got == brute(rows, weights, "3")


def test_fixed_total_cuts_inside_buckets(spark):
    rows = [("x" if i % 3 else "y", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, id long")
    w = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "source string, weight double")
    got = weighted_mixture(df, "source", "id", w, seed="9", total=1001).collect()
    assert len(got) == 1001
    per = {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + 1
    assert per == {"x": 501, "y": 500}


def poured(counts, weights, total):
    """Shares by pouring: a rising level fills every source by its weight until `total` is in or all are full."""
    left, share = min(total, sum(counts.values())), {s: 0.0 for s in counts}
    while left > 1e-9:
        open_ = [s for s in counts if share[s] < counts[s] - 1e-9]
        unit = sum(weights[s] for s in open_)
        step = min(left / unit, *((counts[s] - share[s]) / weights[s] for s in open_))
        for s in open_:
            share[s] += step * weights[s]
        left -= step * unit
    return share


@pytest.mark.parametrize("total", [1, 7, 100, 149, 210, 500])
@pytest.mark.parametrize("weights", [(0.5, 0.5), (0.9, 0.1), (0.1, 0.9)])
def test_what_a_source_lacks_comes_from_the_others(spark, total, weights):
    counts = {"small": 10, "large": 200}
    by = dict(zip(counts, weights))
    frames = (spark.createDataFrame(list(d.items()), t) for d, t in (
        (counts, "source string, n long"), (by, "source string, weight double")))
    got = {r.source: r for r in quotas(*frames, total=total).collect()}
    share = poured(counts, by, total)
    assert sum(r.quota for r in got.values()) == min(total, 210)
    for s, r in got.items():
        assert r.quota <= counts[s] and abs(r.quota - share[s]) < 1
        assert r.shortfall == max(0, math.floor(by[s] * total) - r.quota)


def test_rows_follow_the_quotas(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(200)], "source string, id long")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, weight double")
    got = [r.source for r in weighted_mixture(rows, "source", "id", w, total=100).collect()]
    assert (got.count("a"), got.count("b")) == (10, 90)
