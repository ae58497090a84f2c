"""matches_resolved: lines counted by their keys, matching without a round a pair, against the board and brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oddsloom import queries_edges as qe
from oddsloom.operators import board as bo
from oddsloom.operators import fixtures as fx

D = "/root/testdata/sf0.001"
PAIRS = "sport string, book string, a_id long, b_id long, mean double, low double, flipped boolean, gap long"
ODDS = "odds_id long, source string, sport string, home string, away string, raw_event_id string, market_type string, period string, submarket string, team_side string, line double, fetched_at long, selections map<string,double>"


def _taken(rows):
    gone, out = set(), set()
    for sport, book, a, b, *_ in sorted(rows, key=lambda r: (-r[4], r[2], r[3])):
        if not {(sport, a), (sport, book, b)} & gone:
            gone |= {(sport, a), (sport, book, b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("at_once", [None, 60])
def test_equal_fixtures_are_matched_without_a_round_each(spark, monkeypatch, at_once):
    """Forty listings of one fixture a book are as many rounds if each takes the best pair of all; some in rounds, the rest in order gives the same."""
    rng = random.Random(3)
    rows = [("soccer", book, 100 * k + i, 1000 + j, 90.0, 90.0, False, 0) for k, book in enumerate("xy") for i in range(40) for j in range(40)]
    rows += [("tennis", "x", 900 + i, 2000 + rng.randrange(20), float(rng.randrange(65, 100)), 60.0, False, None) for i in range(30) for _ in range(5)]
    rows = list({(r[2], r[3]): r for r in rows}.values())
    calls, real = [], fx.stored
    monkeypatch.setattr(fx, "stored", lambda df: calls.append(1) or real(df))
    if at_once:
        rows = [r for r in rows if r[2] % 100 < 10 and r[3] % 1000 < 10 or r[0] == "tennis"]
        monkeypatch.setattr(fx, "IN_ORDER", at_once)
    got = [(r.a_id, r.b_id) for r in fx.one_to_one(spark.createDataFrame(rows, PAIRS), ("book",)).collect()]
    assert len(got) == len(set(got)) and set(got) == _taken(rows)
    assert len(calls) > 1 if at_once else len(calls) == 1
    assert fx.one_to_one(spark.createDataFrame([], PAIRS), ("book",)).count() == 0


def test_lines_met_are_those_of_the_board(spark):
    rng = random.Random(6)
    spec = [("moneyline", None, None), ("spread", None, 1.5), ("spread", None, -1.5), ("spread", None, 0.0), ("spread", None, -0.0), ("total", "x", 2.5), ("total", None, 2.504), ("total", None, 2.52), ("team_total", "home", 1.0), ("team_total", "away", 1.0), ("total", None, None)]
    rows = []
    for n in range(1500):
        source, (market, team, line) = rng.choice(["s", "t", "r"]), rng.choice(spec)
        sport = rng.choice(["soccer", "soccer", "soccer", "tennis", None])
        rows.append((n, source, sport, "h", "a", rng.choice([None, *(f"e{k}" for k in range(9))]), market, rng.choice(["FT", "H1", None]), None if team != "x" else team, team if team != "x" else None, line, rng.randrange(50), {"home": 1.5 + n / 1000, "away": 2.0}))
    odds = spark.createDataFrame(rows, ODDS)
    pairs = spark.createDataFrame([(s, "soccer", f"e{k}", f"e{(k + d) % 9}", bool(k % 2)) for s in "st" for k in range(8) for d in ((1,) if k else (1, 2))], "source string, sport string, event string, ref_event string, flipped boolean")
    board, keys, on = bo.newest_board(odds), bo.board_lines(odds), ["source", "sport", "event"]
    assert board.count() == keys.count()
    sides = lambda df: (df.where("source <> 'r'"), df.where("source = 'r'"))
    counted = lambda df: {tuple(r) for r in df.groupBy(*on).agg(F.count("*")).collect()}
    want = counted(bo.closest_line(*sides(board), pairs))
    assert counted(bo.met_lines(*sides(keys), pairs)) == want and len(want) >= 12


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_lines_are_counted_without_prices(spark, monkeypatch):
    """The query neither ranks what was fetched nor carries the prices along; its rows are those of the board."""
    soft, ref = qe._both(spark, D)
    pairs, on = qe.stored(qe.resolved(spark, D)), ["source", "sport", "event"]
    lines, met = soft.groupBy(*on).agg(F.count("*").alias("lines")), bo.closest_line(soft, ref, pairs).groupBy(*on).agg(F.count("*").alias("met"))
    want = lines.join(pairs.groupBy(*on).agg(F.min("ref_event").alias("ref_event")), on, "left").join(met, on, "left").fillna(0, ["met"])
    want = sorted(str(r) for r in want.collect())
    monkeypatch.setattr(bo, "newest_board", None)
    assert sorted(str(r) for r in entry.queries()["matches_resolved"](spark, D).collect()) == want and len(want) > 20
