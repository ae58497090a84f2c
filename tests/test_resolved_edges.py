"""Matching rules and what is priced on matched events, on small cases worked out by hand or by brute force."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import text as tx
from oddsloom.operators import board as bo
from oddsloom.operators import fixtures as fx
from oddsloom.operators import flags as fl
from oddsloom.operators import grid as gr
from oddsloom.operators import series as se

FX = "id long, book string, sport string, home string, away string, league string, start long"


def matched(spark, soft, ref, **kw):
    m, rest = fx.match_fixtures(spark.createDataFrame(soft, FX), spark.createDataFrame(ref, FX), ("book",), **kw)
    return {(r.a_id, r.b_id, r.flipped) for r in m.collect()}, {r.a_id: r.reason for r in rest.collect()}


def test_initialisms_lift_a_side_beside_a_strong_one(spark):
    assert tx.initialism("seinajoen jk", "sjk") and tx.initialism("crb", "cr brasil") and tx.initialism("sj", "seinajoen jk")
    assert not tx.initialism("sjx", "seinajoen jk") and not tx.initialism("sj", "sjk") and not tx.initialism("abcde", "a b c d e")
    row = lambda i, h, a, t=1000, b="b": (i, b, "soccer", h, a, None, t)
    got, why = matched(spark, [row(1, "Seinajoen JK", "Inter Turku"), row(2, "Seinajoen JK", "Ilves"), row(3, "Nobody", "Noone", 900_000)], [row(11, "SJK", "Inter Turku", b="a"), row(12, "SJK", "Honka", b="a")])
    assert got == {(1, 11, False)} and why == {2: "name", 3: "no_candidate"}


def test_sides_changed_without_kickoff_and_women_by_accents(spark):
    row = lambda i, h, a, lg=None, t=None, b="b": (i, b, "soccer", h, a, lg, t)
    assert matched(spark, [row(1, "Ajax", "PSV"), row(2, "Olimpija", "Rudar")], [row(11, "PSV", "Ajax", t=500, b="a"), row(12, "Olimpia", "Rudar", t=500, b="a")])[0] == {(1, 11, True), (2, 12, False)}
    got, why = matched(spark, [row(1, "Ajax", "PSV", "Division 1 Féminine", 500)], [row(11, "Ajax", "PSV", "Division 1", 500, "a")])
    assert not got and why == {1: "gender"}
    df = spark.createDataFrame([("D1 Féminine",), ("Féminine",), ("Feminist Cup",), ("Liga (W)",), (None,)], "s string").select(tx.women(F.col("s")).alias("w"))
    assert [r.w for r in df.collect()] == [True, True, False, True, False]


def test_aliases_go_before_everything(spark):
    aliases = spark.createDataFrame([(" zenit ", "Zenit Saint Petersburg"), ("UNICS", "UNICS Kazan"), (None, "x"), ("y", None)], "alias string, canonical string")
    row = lambda i, h, a, b="b": (i, b, "basketball", h, a, None, 1000)
    soft, ref = [row(1, "ZENIT", "Unics")], [row(11, "Saint Petersburg", "Kazan", "a")]
    assert not matched(spark, soft, ref)[0] and matched(spark, soft, ref, aliases=aliases)[0] == {(1, 11, False)}


BOARD = "odds_id long, source string, sport string, event string, market_type string, period string, submarket string, team_side string, line double, selections map<string,double>"


def test_flipped_reference_is_priced_from_the_other_side(spark):
    soft = spark.createDataFrame([(1, "s", "soccer", "e", "spread", "FT", None, None, -1.5, {"home": 2.2, "away": 1.7}), (2, "s", "soccer", "e", "team_total", "FT", None, "home", 1.5, {"over": 2.0, "under": 1.8}), (3, "s", "tennis", "e", "spread", "FT", None, None, -1.5, {"home": 2.2, "away": 1.7})], BOARD)
    ref = spark.createDataFrame([(11, "r", "soccer", "x", "spread", "FT", None, None, 1.5, {"home": 1.9, "away": 2.0}), (12, "r", "soccer", "x", "team_total", "FT", None, "away", 1.5, {"over": 1.9, "under": 1.9})], BOARD)
    pairs = lambda flip: spark.createDataFrame([("s", "soccer", "e", "x", flip)], "source string, sport string, event string, ref_event string, flipped boolean")
    got = {r.odds_id: (r.ref_id, r.ref_line, r.ref_selections) for r in bo.closest_line(soft, ref, pairs(True)).collect()}
    assert got == {1: (11, -1.5, {"home": 2.0, "away": 1.9}), 2: (12, 1.5, {"over": 1.9, "under": 1.9})}
    assert bo.closest_line(soft, ref, pairs(False)).count() == 0


def test_grid_by_brute_force(spark):
    """Markets of a source with shared ids, another bridged over the reference, with sides changed, a third without a match."""
    rng = random.Random(4)
    rows, n = [], 0
    for source, event in product("abc", ("e1", "e2")):
        for market, sides, line in (("moneyline", ("home", "draw", "away"), None), ("total", ("over", "under"), 2.5), ("total", ("over", "under"), 3.5), ("spread", ("home", "away"), -1.0)):
            if source == "a" and line == 3.5:
                continue
            n += 1
            rows.append((n, source, "soccer", event, market, "FT", None, None, line, {s: round(rng.uniform(1.8, 4.5), 2) for s in sides}, f"sr{event}" if source == "a" else None))
    board = spark.createDataFrame(rows, BOARD + ", sr_match_id string")
    pairs = spark.createDataFrame([(s, "soccer", e, f"r{e}", s == "b") for s, e in (("a", "e1"), ("b", "e1"), ("a", "e2"))], "source string, sport string, event string, ref_event string, flipped boolean")
    known = gr.meetings(board, pairs)
    assert {(r.source, r.event, r.meeting, r.own, r.flipped) for r in known.collect()} == {("a", "e1", "sre1", True, False), ("a", "e2", "sre2", True, False), ("b", "e1", "sre1", False, True)}
    priced = gr.priced_markets(board, known)
    want = {}
    swap = {"home": "away", "away": "home"}
    for _, source, _, event, market, _, _, _, line, sel, _ in rows:
        if source == "c" or (source, event) == ("b", "e2") or line == 3.5:
            continue
        for s, p in sel.items():
            flip = source == "b"
            at = -line if flip and market == "spread" else line
            want[(f"sr{event}", market, at, swap.get(s, s) if flip else s, source)] = p
    want = {k: v for k, v in want.items() if any(m[:3] == k[:3] and m[4] == "a" for m in want)}
    assert {(r.meeting, r.market_type, r.line, r.side, r.source): r.price for r in priced.collect()} == want
    legs = gr.arb_legs(priced).collect()
    best = {}
    for (m, k, at, s, source), p in want.items():
        best.setdefault((m, k, at), {}).setdefault(s, []).append((p, source))
    arbs = set()
    for key, sides in best.items():
        top = {s: max(v, key=lambda x: (x[0], [-ord(c) for c in x[1]])) for s, v in sides.items()}
        if len({x[1] for x in top.values()}) >= 2 and sum(1 / x[0] for x in top.values()) <= 1 and len(top) >= (3 if "draw" in top else 2):
            arbs.add(key)
    assert {(r.meeting, r.market_type, r.line) for r in legs} == arbs and arbs
    for key in arbs:
        own = [r for r in legs if (r.meeting, r.market_type, r.line) == key]
        assert abs(sum(r.stake_pct for r in own) - 100) < 1e-9 and len({round(r.stake_pct * r.price, 6) for r in own}) == 1
    lines = gr.best_lines(priced, least=-1000.0).collect()
    assert all(max(r.prices.values()) == r.best_price and r.sources == len(r.prices) for r in lines)
    fair = gr.best_lines(priced, priced.where("source = 'a'").withColumnRenamed("price", "fair").drop("source"), kind="ev", least=0.0).collect()
    assert fair and all(any(x.edge_pct is not None and x.edge_pct >= 0 for x in fair if (x.meeting, x.market_type, x.line) == (r.meeting, r.market_type, r.line)) for r in fair)


def test_alerts_are_new_or_grown(spark):
    edges = spark.createDataFrame([("a", None, 20.0, "strong"), ("b", 1, 20.0, "medium"), ("c", 1, 20.0, "weak"), ("d", 1, 14.0, "strong"), ("e", 1, 30.0, "strong"), ("m", 1, 40.0, "strong")], "source string, k int, edge double, confidence string")
    seen = spark.createDataFrame([("b", 1, 18.0), ("e", 1, 25.0), ("a", 2, 20.0)], "source string, k int, edge double")
    assert {r.source for r in fl.alerts(edges, seen, ["source", "k"], muted=["m"]).collect()} == {"a", "e"}
    assert fl.alerts(edges, seen, ["source", "k"], first=True).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_previous_rows_across_slices(spark, seed):
    rng = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else t0 + timedelta(hours=rng.randrange(0, 200)), None if rng.random() < 0.2 else float(rng.randrange(3)), "x") for i in range(300)]
    got = {r.id: (r["_first"], r["_v"]) for r in se.with_previous(spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, v double, z string").repartition(4), ["k"], "ts", "id", ["v"]).collect()}
    want, held = {}, {}
    for i, k, t, v, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2] or t0, r[0])):
        want[i] = (k not in held, held.get(k))
        held[k] = v
    assert got == want


def test_nearest_market(spark):
    want = spark.createDataFrame([("e", "total", None, 2.5), ("e", "total", None, 3.1), ("e", "total", None, 9.0), ("e", "ml", None, None), ("e", "total", "home", 2.5)], "event string, kind string, team string, line double")
    have = spark.createDataFrame([("e", "total", None, 2.25, 1), ("e", "total", None, 2.75, 2), ("e", "total", None, 3.3, 3), ("e", "ml", None, None, 4), ("e", "total", None, 2.6, 5)], "event string, kind string, team string, line double, market_id int")
    assert {(r.kind, r.line): r.market_id for r in se.nearest_market(want, have, ["event", "kind"], ["team"]).collect()} == {("total", 2.5): 5, ("total", 3.1): 3, ("ml", None): 4}
