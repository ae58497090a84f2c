import random
from datetime import datetime, timedelta

import numpy as np

from oddsloom.llm.matching import fit_logistic, isotonic, league_likeness, match

SCHEMA = "id long, source string, domain string, home string, away string, league string, start_time timestamp_ntz, last_seen timestamp_ntz"
BASE = datetime(2026, 1, 1)


def world(n=60, seed=1):
    rng = random.Random(seed)
    syl = lambda k: "".join(rng.choice("bdfgjklmnprst") + rng.choice("aeiou") for _ in range(k)).capitalize()
    clubs = [f"{syl(4)} {rng.choice(['Rovers', 'Albion', 'United', 'Town'])}" for _ in range(80)]
    rows, truth, ident = [], [], 0
    for _ in range(n):
        h, a = rng.sample(clubs, 2)
        at = BASE + timedelta(hours=rng.randrange(24 * 60))
        ids = []
        for src in "abc":
            ident += 1
            x, y = (h, a) if rng.random() < 0.85 else (a, h)
            typo = lambda s: s if rng.random() < 0.6 else s[:3] + s[4:]
            rows.append((ident, src, "soccer", typo(x), typo(y), rng.choice(["Premier League", "PL", None]), at + timedelta(minutes=rng.choice([0, 0, 15, 60])), at - timedelta(hours=1)))
            ids.append(ident)
        truth += [(p, q) for p in ids for q in ids if p < q]
    return rows, set(truth)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", t string, mark double").repartition(3)
    return {(r.id_a, r.id_b): r.confidence for r in match(df, people=["tennis"]).collect()}


def test_held_out_accuracy_and_guards(spark):
    rows, truth = world()
    n = len(rows)
    first = rows[0]
    rows += [
        (n + 1, "d", "soccer", first[3] + " W", first[4] + " W", None, first[6], first[7]),  # the women's match
        (n + 2, "e", "soccer", first[3], first[4], "Cup, Women", first[6], first[7]),  # the same, named by the league
        (n + 3, "d", "soccer", first[3], first[4], None, first[6] + timedelta(days=4), first[7] + timedelta(days=4)),  # another leg
        (n + 4, "e", "soccer", first[3], first[4], None, None, first[7]),  # no kickoff
        (n + 5, "e", "soccer", None, first[4], None, first[6], first[7]), (n + 6, "e", "soccer", "?", "!", None, first[6], first[7]), (n + 7, None, "soccer", "A", "B", None, None, None), (n + 8, "e", "tennis", first[3], first[4], None, first[6], first[7]),
    ]
    got = found(spark, rows)
    yes = {p for p, c in got.items() if c >= 0.5}
    assert all(0 <= c <= 1 for c in got.values()) and all(a < b for a, b in got)
    senior = {p for p in yes if max(p) <= n}
    assert len(senior & truth) >= 0.95 * len(truth) and len(senior - truth) <= 0.03 * len(truth)
    extra = {p for p in yes if max(p) > n}
    assert (n + 1, n + 2) in extra and (1, n + 4) in extra
    assert not any(n + 3 in p for p in extra) and not any(set(p) & {n + 5, n + 6, n + 7, n + 8} for p in extra)


def test_parts():
    assert league_likeness("Premier Division (TRN)", "TRN Prem. Div.") == 1 and league_likeness("A League", "Other Cup") == 0
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=2000) > 0).astype(int)
    w = fit_logistic(x, y)
    assert w[0] > 5 * abs(w[1])
    knots, p = isotonic(x[:, 0], y)
    assert (np.diff(p) >= -1e-9).all() and p[0] < 0.1 and p[-1] > 0.9


def test_few_rows_and_none(spark):
    assert found(spark, []) == {}
    two = [(1, "a", "soccer", "Alpha Rovers", "Beta City", None, BASE, BASE), (2, "b", "soccer", "Beta City", "Alpha Rovers", None, BASE, BASE)]
    assert found(spark, two)[1, 2] >= 0.5
