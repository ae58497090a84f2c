import random
from datetime import datetime, timedelta

import numpy as np

from oddsloom.llm import asof
from oddsloom.llm.asof import nearest, nearest_recordings, piecewise_linear


def brute(rec, q):
    out = {}
    for e, a, t, tol in q:
        if e is None or t is None:
            continue
        best = min(((abs(t - rt), rt, i) for re, rt, i in rec if re == e and rt is not None), default=None)
        if best and best[0] <= timedelta(microseconds=tol):
            out[e, a] = best[2]
    return out


def test_segments_keep_their_error():
    t = np.sort(np.random.default_rng(1).choice([1, 5, 1000, 10**6], 5000) * np.random.default_rng(2).random(5000)).astype(np.int64)
    s, e = piecewise_linear(t, np.array([0]))
    assert s[0] == 0 and e[-1] == 5000 and (s[1:] == e[:-1]).all()
    for a, b in zip(s, e):
        guess = (t[a:b] - t[a]) / max(t[b - 1] - t[a], 1) * (b - a - 1)
        assert b - a <= asof.EPSILON + 1 or np.abs(guess - np.arange(b - a)).max() <= asof.EPSILON


def test_local_search_is_exact():
    rng = random.Random(3)
    rec = sorted((rng.choice([1, 1, 1, 2, 7]), rng.choice([rng.randrange(10**4), rng.randrange(10**9)]), i) for i in range(4000))
    e, t, i = (np.array(x) for x in zip(*rec))
    q = [(rng.choice([1, 2, 3, 7]), rng.choice([rng.randrange(-50, 10**4), rng.randrange(10**9), int(t[rng.randrange(4000)])])) for _ in range(2000)]
    got = nearest(e, t, i, np.array([x[0] for x in q]), np.array([x[1] for x in q]))
    for (qe, qt), g in zip(q, got):
        want = min(((abs(qt - y), y, z) for x, y, z in rec if x == qe), default=None)
        assert (g < 0) == (want is None) and (want is None or i[g] == want[2])


def test_hot_entities_ties_nulls_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(asof, "ROWS_PER_SHARD", 150)
    monkeypatch.setattr(asof, "SAMPLE", 500)
    rng, base = random.Random(4), datetime(2026, 1, 1)
    rec = [(1 if rng.random() < 0.5 else rng.randrange(2, 40), base + timedelta(seconds=rng.randrange(0, 40_000, 5)), i) for i in range(3000)]
    rec += [(None, base, 5000), (1, None, 5001), (50, base, 5003), (50, base, 5002), (50, base + timedelta(minutes=2), 5001)]
    q = [(e, a, base + timedelta(seconds=rng.randrange(-500, 41_000)), 600_000_000) for e in range(1, 45) for a in ("x", "y")]
    q += [(50, "tie", base + timedelta(minutes=1), 60_000_000), (50, "far", base - timedelta(minutes=5), 60_000_000), (51, "none", base, 10**12), (None, "n", base, 1), (50, "null", None, 1)]
    r = spark.createDataFrame([(*x, 1, "z") for x in rec], "b long, at timestamp_ntz, h long, e int, t string").repartition(5)
    k = spark.createDataFrame([(*x, 0) for x in q], "b long, a string, at2 timestamp_ntz, tol long, i int").repartition(3)
    got = {(x.b, x.a): x.h for x in nearest_recordings(r, k, entity="b", time="at", ident="h", anchor="a", q_time="at2", tolerance="tol").collect()}
    assert got == brute(rec, q) and got[50, "tie"] == 5002


def test_nothing(spark):
    r, k = spark.createDataFrame([], "b long, at timestamp_ntz, h long"), spark.createDataFrame([], "b long, a string, at2 timestamp_ntz, tol long")
    assert nearest_recordings(r, k, entity="b", time="at", ident="h", anchor="a", q_time="at2", tolerance="tol").count() == 0
