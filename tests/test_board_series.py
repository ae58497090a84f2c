from datetime import datetime

import pytest
from pyspark.sql import functions as F

from oddsloom.operators import board as bo
from oddsloom.operators import flags as fl
from oddsloom.operators import series as se

T = lambda m: datetime(2026, 1, 1, 0, m)
ODDS = "odds_id long, source string, sport string, event string, market_type string, period string, submarket string, team_side string, section string, line double, selections map<string,double>"


def rung(i, line, home, away, section="s"):
    return (i, "b", "soccer", "e", "spread", "FT", None, None, section, line, {"home": home, "away": away})


def test_ladders_by_section(spark):
    df = spark.createDataFrame([rung(1, 3.5, 1.75, 2.0), rung(2, 4.5, 1.90, 1.9), rung(3, 3.5, 9.0, 1.01), rung(4, 5.5, 1.5, None, "other")], ODDS)
    got = bo.ladder_anomalies(df).collect()
    assert len(got) == 2  # home rises, away falls
    home = next(r for r in got if r.side == "home")
    assert home.pct == pytest.approx(8.571, abs=1e-3) and home.inflated == 4.5


def test_closest_line_is_null_safe_and_keeps_the_first(spark):
    soft = spark.createDataFrame([(1, "b", "s", "e", "total", "FT", None, None, None, 2.5, {"over": 2.1, "under": 1.8}), (2, "b", "s", "e", "moneyline", "FT", None, None, None, None, {"home": 2.1, "away": 1.8}), (3, "b", "s", "e", "total", "FT", "corners", None, None, 2.5, {"over": 2.0})], ODDS)
    ref = spark.createDataFrame([(10, "r", "s", "x", "total", "FT", None, None, None, 2.51, {"over": 2.0, "under": 1.9}), (11, "r", "s", "x", "total", "FT", None, None, None, 2.5, {"over": 1.9, "under": 2.0}), (12, "r", "s", "x", "total", "FT", None, None, None, 2.5, {"over": 1.9, "under": 2.0}), (13, "r", "s", "x", "moneyline", "FT", None, None, None, None, {"home": 1.9, "away": 2.0})], ODDS)
    pairs = spark.createDataFrame([("b", "e", "x")], "source string, event string, ref_event string")
    got = {r.odds_id: r.ref_id for r in bo.closest_line(soft, ref, pairs).collect()}
    assert got == {1: 11, 2: 13}


def test_cross_source_arbs_need_two_sources_and_all_sides(spark):
    q = spark.createDataFrame([("a", "m1", "home", 2.2), ("b", "m1", "away", 2.1), ("a", "m2", "home", 2.2), ("a", "m2", "away", 2.2), ("a", "m3", "home", 4.0), ("b", "m3", "draw", 4.0)], "source string, meeting string, side string, price double")
    got = bo.cross_source_arbs(bo.best_prices(q, ["meeting"]), ["meeting"]).collect()
    assert [r.meeting for r in got] == ["m1"] and got[0].margin == pytest.approx((1 - 1 / 2.2 - 1 / 2.1) * 100)


def test_moves_see_slow_drift_and_reanchor_together(spark):
    rows = [("m", T(i), s, 0.5 + (0.007 * i if s == "home" else -0.007 * i)) for i in range(7) for s in ("home", "away")]
    got = se.steam_moves(spark.createDataFrame(rows, "k string, ts timestamp_ntz, side string, fair double"), ["k"]).orderBy("ts").collect()
    assert [(r.side, r.window_sec) for r in got] == [("home", 180), ("home", 180)]
    assert got[0].now == pytest.approx(0.521) and got[1].was == pytest.approx(0.521)


def test_disappearances_skip_failed_and_empty_cycles(spark):
    cycles = spark.createDataFrame([("b", i, i != 3) for i in range(1, 6)], "source string, cycle int, ok boolean")
    seen = spark.createDataFrame([("b", 1, "x"), ("b", 1, "y"), ("b", 3, "y"), ("b", 4, "y"), ("b", 5, "x")], "source string, cycle int, k string")
    got = {(r.k, r.cycle) for r in se.disappearances(cycles, seen, ["k"]).collect()}
    assert got == {("x", 4), ("y", 5)}


def test_first_seen_resets_after_absence_and_nulls_are_equal(spark):
    before = spark.createDataFrame([("a", None, datetime(2025, 1, 1))], "x string, y string, first_seen timestamp_ntz")
    now = spark.createDataFrame([("a", None), ("b", "z")], "x string, y string")
    got = {r.x: r.first_seen for r in fl.carry_first_seen(now, before, ["x", "y"], "2026-01-01 00:00:00").collect()}
    assert got == {"a": datetime(2025, 1, 1), "b": datetime(2026, 1, 1)}


def test_variants_and_confidence(spark):
    rows = [(1, 2.5, 1), (2, 2.5, 0), (3, 3.5, 1)]
    df = spark.createDataFrame([(i, "b", "e", "total", "FT", None, None, line, r) for i, line, r in rows], "odds_id long, source string, event string, market_type string, period string, submarket string, team_side string, line double, rank int")
    assert [r.odds_id for r in bo.merge_variants(df, "rank").collect()] == [2]
    cases = [("EV", 90.0, 60, 5.0, "strong"), ("EV", 70.0, 60, 5.0, "weak"), ("EV", None, None, 5.0, "medium"), ("EV", 90.0, 2500, 5.0, "weak"), ("ARB", 90.0, None, 13.0, "weak"), ("EV", 85.0, 60, 11.0, "weak")]
    df = spark.createDataFrame(cases, "k string, s double, g long, e double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", bo.match_confidence(F.col("k"), F.col("s"), F.col("g"), F.col("e"))).collect())
