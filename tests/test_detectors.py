"""Detectors and identities on boards made to trip them, and the neighbours that must not."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from oddsloom.operators import capital as ca
from oddsloom.operators import consistency as co
from oddsloom.operators import identities as idn
from oddsloom.operators import ledger as le
from oddsloom.operators import models as mo
from oddsloom.plans.ranges import running_total
from oddsloom.streaming import quotes as sq

ROW = "odds_id long, source string, sport string, event string, league string, market_type string, period string, submarket string, team_side string, section string, line double, selections map<string,double>"


def board(spark, rows):
    """Rows of (event, sport, market, period, line, selections[, section[, league]])."""
    return spark.createDataFrame([(i, "s", r[1], r[0], r[7] if len(r) > 7 else None, r[2], r[3], None, None, r[6] if len(r) > 6 else None, r[4], r[5]) for i, r in enumerate(rows)], ROW)


def flags(df):
    return {(r.event, r.kind, r.outcome): round(r.severity, 2) for r in df.collect()}


def test_regulation_cannot_beat_overtime(spark):
    b = board(spark, [("flip", "basketball", "moneyline", "FT", None, {"home": 1.6, "away": 2.0}), ("flip", "basketball", "moneyline", "FT", None, {"home": 2.3, "draw": 12.25, "away": 1.6}),
                      ("fine", "basketball", "moneyline", "FT", None, {"home": 1.9, "away": 1.9}), ("fine", "basketball", "moneyline", "FT", None, {"home": 2.1, "draw": 12.0, "away": 2.1}),
                      ("home", "basketball", "moneyline", "FT", None, {"home": 1.9, "away": 1.9}), ("home", "basketball", "moneyline", "FT", None, {"home": 1.7, "draw": 14.0, "away": 2.4}), ("other", "tennis", "moneyline", "FT", None, {"home": 1.2, "away": 4.0})])
    got = flags(co.overtime_fold(co.period_view(b)))
    assert set(got) == {("flip", "overtime_fold", "away*"), ("home", "overtime_fold", "home*")} or set(got) == {("flip", "overtime_fold", "away*"), ("home", "overtime_fold", "home")}
    assert got[("flip", "overtime_fold", "away*")] > 10


def test_combo_gate_and_favourites(spark):
    legs = lambda e, h1, ft, c, **k: [(e, "soccer", "moneyline", "H1", None, h1), (e, "soccer", "moneyline", "FT", None, ft), (e, "soccer", "htft", "FT", None, c)]
    three = lambda h, a: {"home": h, "draw": 4.0, "away": a}
    b = board(spark, legs("short", three(2.0, 6.0), three(1.5, 7.0), {"1/1": 1.9, "2/2": 20.0}) + legs("long", three(1.6, 6.0), three(1.25, 9.0), {"1/1": 2.2}) + legs("gate", three(4.0, 6.0), three(3.0, 9.0), {"1/1": 12.0}) + legs("fine", three(2.0, 6.0), three(1.5, 7.0), {"1/1": 2.45}))
    got = flags(co.half_full_combos(b))
    assert set(got) == {("short", "htft_combo", "1/1"), ("long", "htft_combo", "1/1")} and math.isclose(got["short", "htft_combo", "1/1"], round((2.0 / 1.9 - 1) * 100, 2))
    # 2.2 / 1.6 = 1.375 against the first half; a league of the top is not swept
    assert flags(co.favourite_combo(b)) == {("long", "soccer_htft", "1/1"): 38.0}
    top = board(spark, [(*r, None, "UEFA Cup") for r in legs("long", three(1.6, 6.0), three(1.25, 9.0), {"1/1": 2.2})])
    assert flags(co.sweep_flags(top)) == {} and flags(co.sweep_flags(b)) == {("long", "soccer_htft", "1/1"): 38.0}
    only_ml = board(spark, [("ml", "soccer", "moneyline", "FT", None, {"home": 8.0, "draw": 6.0, "away": 1.25}), ("ml", "soccer", "htft", "FT", None, {"2/2": 1.75})])
    assert flags(co.favourite_combo(only_ml)) == {("ml", "soccer_htft", "2/2"): 40.0}


def test_half_full_against_the_model(spark):
    assert np.allclose(mo._normal_cdf(np.array([-3.0, -0.5, 0.0, 1.7])), [NormalDist().cdf(x) for x in (-3.0, -0.5, 0.0, 1.7)], atol=1e-14)
    assert np.allclose(mo.margin_of(np.array([0.3, 0.5, 0.9]), np.array([11.0, 11.0, 11.0])), [11 * NormalDist().inv_cdf(p) for p in (0.3, 0.5, 0.9)], atol=1e-9)
    fair = {k: float(v[0]) for k, v in mo.half_full_fair(np.array([0.0]), nine=False).items()}
    posted = {k: round(1 / p * (1.1 if k == "1/1" else 0.93), 3) for k, p in fair.items()}
    rows = [("e", "basketball", "moneyline", "FT", None, {"home": 1.9, "away": 1.9}), ("e", "basketball", "htft", "FT", None, posted), ("n", "soccer", "htft", "FT", None, posted)]
    b = board(spark, rows)
    got = flags(co.half_full_against_model(b, co.period_view(b), co.leagues_of(b)))
    assert set(got) == {("e", "htft_fair", "1/1")} and abs(got["e", "htft_fair", "1/1"] - 10) < 0.2
    # by the spread's centre at -10 the home side is ahead: flat prices are off in shape
    spread = [("s", "basketball", "spread", "FT", x, {"home": h, "away": a}) for x, h, a in ((-12.0, 2.2, 1.7), (-8.0, 1.7, 2.2))]
    b = board(spark, [*spread, ("s", "basketball", "htft", "FT", None, {k: 3.4 for k in fair})])
    view = co.period_view(b)
    assert abs(view.first().spread_center + 10) < 1e-9
    assert {k[2] for k in flags(co.half_full_against_model(b, view, co.leagues_of(b)))} >= {"1/1"}


def test_main_section_decides(spark):
    rows = [("e", "basketball", "total", "FT", x, {"over": o, "under": u}, "main") for x, o, u in ((150.5, 1.7, 2.2), (152.5, 1.95, 1.95), (154.5, 2.2, 1.7))] + [("e", "basketball", "total", "FT", x, {"over": o, "under": u}, "alt") for x, o, u in ((170.5, 1.8, 2.1), (171.5, 2.1, 1.8))]
    assert co.period_view(board(spark, rows)).first().total_center == 152.5


def test_identities_on_a_full_sheet(spark):
    scores = {f"{i}-{j}": 30.0 for i in range(6) for j in range(6)} | {"other:1": 20.0, "other:X": 50.0, "other:2": 20.0}
    b = board(spark, [("e", "soccer", "correct_score", "FT", None, scores), ("e", "soccer", "total", "FT", 1.5, {"over": 1.1, "under": 4.0}), ("e", "soccer", "exact", "FT", None, {"0": 12.0, "1": 8.0, "2": 4.0}), ("e", "soccer", "multigoal", "FT", None, {"0-1": 4.0, "1-2": 3.0}),
                      ("e", "soccer", "dc", "FT", None, {"1X": 1.3, "X2": 1.9}), ("e", "soccer", "dnb", "FT", None, {"home": 1.5, "away": 2.6}), ("e", "soccer", "spread", "FT", 0.0, {"home": 1.6, "away": 3.2}), ("e", "soccer", "moneyline", "FT", None, {"home": 2.0, "draw": 3.5, "away": 4.0})])
    sheet = idn.posted_sheet(b)
    keys = {r.key: r.posted for r in sheet.collect()}
    assert keys["dc:X2"] == 1.9 and keys["dnb:2"] == 2.6 and keys["cs:other:X"] == 50.0 and keys["multigoal:0-1"] == 4.0 and keys["exact:2"] == 4.0 and keys["ah:away_0"] == 3.2
    parts = {r.name: round(r.excess, 4) for r in idn.partitions(sheet).collect()}
    assert math.isclose(parts["Multigoal 0-1"], round((1 / 4 - 1 / 12 - 1 / 8) * 100, 4)) and "Multigoal 1-2" not in parts
    assert math.isclose(parts["Scores to Under 1.5"], round((1 / 4 - 3 / 30) * 100, 4)) and math.isclose(parts["Under 1.5"], round((1 / 4 - 1 / 12 - 1 / 8) * 100, 4))
    assert "Scores to FT 1" not in parts and idn.partitions(sheet.where("key <> 'cs:5-5'")).where("name = 'Scores to FT X'").count() == 0
    kinds = {(r.kind, r.name) for r in idn.identity_flags(sheet).collect()}
    assert ("equivalence", "ah:home_0 = dnb:1") in kinds and ("arb", "ah:away_0 + dnb:1") in kinds and ("partition", "Multigoal 0-1") in kinds
    assert idn.identity_flags(sheet.limit(0)).count() == 0


def test_capital_by_hand(spark):
    accounts = spark.createDataFrame([(1, "bk", False, False, 5.0), (2, None, False, False, None), (3, None, False, True, None)], "id int, book_tag string, archived boolean, is_dividend boolean, manual_open double")
    moves = spark.createDataFrame([("2026-01-02 00:00:00", 1, 2, 100.0), ("2026-01-03 00:00:00", 2, 3, 40.0)], "ts string, source int, target int, amount double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    paid = ca.transfers(moves, accounts)
    assert sorted((r.account_id, r.kind, r.amount) for r in paid.collect()) == [(1, "commission", -6.38), (1, "transfer", -100.0), (2, "transfer", -40.0), (2, "transfer", 100.0), (3, "transfer", 40.0)]
    entries = spark.createDataFrame([(1, "2026-01-01 00:00:00", "opening", 1000.0), (1, "2026-01-04 00:00:00", "pnl", -3.0)], "account_id int, ts string, kind string, amount double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).unionByName(paid).withColumn("id", F.monotonically_increasing_id())
    bet = "bet_id int, account_id int, book string, status string, stake double, payout double, placed_at string, settled_at string"
    bets = spark.createDataFrame([(1, None, "bk", "won", 10.0, 25.0, "2026-01-02 10:00:00", "2026-01-05 00:00:00"), (2, None, "bk", "open", 20.0, None, "2026-01-02 10:00:00", None), (3, None, "zz", "lost", 7.0, 0.0, "2026-01-02 10:00:00", "2026-01-02 20:00:00"), (4, 2, None, "pushed", 50.0, 50.0, "2026-01-06 10:00:00", "2026-01-06 20:00:00")], bet)
    bets = bets.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("placed_at", "settled_at")})
    rows = {r.id: r for r in ca.balances(accounts, entries, bets).collect()}
    one = rows[1]
    assert (one.opening, one.ledger_net, one.bet_pnl, one.manual_pnl, one.open_stake) == (1000.0, 893.62, 15.0, -3.0, 25.0) and one.balance == round(893.62 + 15 - 3 - 25, 2)
    assert one.withdrawal_cost == round((one.balance + 25) * 6 / 94, 2) and rows[2].balance == 60.0 and rows[2].withdrawal_cost == 0.0 and rows[3].balance == 40.0 and rows[None].bet_pnl == -7.0
    t = ca.totals(accounts, entries, bets).first()
    assert t.dividend_total == 40.0 and t.commission_paid == 6.38 and t.settled_pnl == 5.0 and t.equity == round(one.balance + 60.0 - 7.0, 2) and t.yield_pct == round(8 / 17 * 100, 2)
    since = ca.totals(accounts, entries, bets, since="2026-01-04 00:00:00").first()
    assert since.starting_capital == round(t.equity - 15.0 + 3.0, 2) and since.dividend_total == 0.0 and since.settled_pnl == 12.0
    fresh = {r.id: r for r in ca.balances(accounts, entries, bets, since="2027-01-01 00:00:00", mode="fresh").collect()}
    assert fresh[1].balance == -5.0 and fresh[2].balance == 0.0 and None not in fresh
    assert [r.balance for r in ca.curve(accounts, entries, bets).orderBy("ts").collect()] == [-7.0, -10.0, 5.0, 5.0]
    assert {r.id: r.deletable for r in ca.references(accounts, entries, bets).collect()} == {1: False, 2: False, 3: False}
    want = spark.createDataFrame([(1, one.balance + 4.0), (2, 60.001)], "id int, balance double").withColumn("ts", F.lit("2026-02-01").cast("timestamp_ntz"))
    assert [(r.account_id, r.amount) for r in le.balance_entries(want, ca.balances(accounts, entries, bets)).collect()] == [(1, 4.0)]


def test_running_total_over_shards(spark):
    rows = [(i * 7 % 101, i, None if i % 13 == 0 else float(i)) for i in range(500)]
    got = {(r.a, r.b): r.running for r in running_total(spark.createDataFrame(rows, "a int, b int, v double").repartition(5), ["a", "b"], "v", rows=500 * 1_000_000 // 60).collect()}
    total = 0.0
    for a, b, v in sorted(rows):
        total += v or 0.0
        assert math.isclose(got[a, b], total)
    assert running_total(spark.createDataFrame([], "a int, v double"), ["a"], "v").count() == 0


def test_late_rows_and_silent_keys_of_a_stream(spark, tmp_path):
    schema = "market_id long, selection string, ts timestamp, odds double, tick_id long"
    batches = [[(1, "h", "2026-01-01 10:00:00", 2.0, 1), (2, "h", "2026-01-01 10:00:00", 3.0, 2)], [(1, "h", "2026-01-01 09:59:00", 9.0, 3), (1, "h", "2026-01-01 10:01:00", 2.0, 4)], [(1, "h", "2026-01-01 14:00:00", 2.1, 5)], [(1, "h", "2026-01-01 14:01:00", 2.1, 6)], [(2, "h", "2026-01-01 14:02:00", 3.0, 7)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "t.parquet" / f"b={i}"))
        for f in (tmp_path / "t.parquet" / f"b={i}").glob("*.parquet"):
            f.rename(tmp_path / f"{i}-{f.name}")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    ids = lambda **k: sorted(r.tick_id for r in sq.start(sq.change_only(source(), ["market_id", "selection"], at="ts", value="odds", ident="tick_id", **k)).collect())
    assert ids() == [1, 2, 5]
    # key 2's state is dropped once the watermark is an hour beyond it, so its next row is a first one
    assert ids(late="1 minute", forget=3600) == [1, 2, 5, 7]


def test_markets_of_a_feed_are_picked_and_compared(spark):
    schema = "event string, seq int, market_id int, market string, outcome string, price double, lined boolean, open boolean"
    market = lambda e, seq, mid, name, prices, lined=False: [(e, seq, mid, name, k, p, lined, True) for k, p in prices.items()]
    rows = market("e", 1, 7, "2nd Half - Winner (1X2)", {"1": 9.0, "X": 9.0, "2": 1.1}) + market("e", 2, 70, "Match Result", {"1": 5.0, "X": 9.0, "2": 1.2}) + market("e", 3, 409, "1x2", {"1": 2.3, "X": 12.25, "2": 1.6}) + market("e", 4, 5, "Points Spread", {"1": 1.9, "2": 1.9}, True)
    rows += market("e", 5, 396, "Home/Away", {"1": 1.9, "2": 1.9}) + market("e", 6, 8, "12 (OT)", {"1": 1.6, "2": 2.0}) + market("f", 1, 1, "Result", {"1": 2.0, "X": 3.0, "2": 3.0}) + [("f", 2, 396, "Winner", "1", 1.5, False, True), ("f", 2, 396, "Winner", "2", 2.4, False, False)]
    df = spark.createDataFrame(rows, schema)
    got = {r.event: (r.reg.asDict(), r.ot.asDict()) for r in co.moneyline_markets(df).collect()}
    assert got == {"e": ({"market": "1x2", "h": 2.3, "d": 12.25, "a": 1.6}, {"market": "12 (OT)", "h": 1.6, "a": 2.0})}
    flag = co.overtime_flags(df).collect()
    assert [(r.event, r.kind, r.outcome) for r in flag] == [("e", "overtime_flip", "away")] and flag[0].severity > 10
    assert co.overtime_flags(df.limit(0)).count() == 0
