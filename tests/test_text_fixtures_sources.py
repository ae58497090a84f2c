import json
import struct
from datetime import datetime

from pyspark.sql import functions as F

from oddsloom.functions import text as tx
from oddsloom.operators.fixtures import match_fixtures
from oddsloom.sources import html_pages as hp
from oddsloom.sources import json_feeds as jf
from oddsloom.sources import sinks, wire

FX = "id long, sport string, home string, away string, league string, start long"


def test_names():
    assert tx.normal("FC Bayern München") == "bayern munchen" and tx.normal("Нуэва Чикаго") == "nueva chikago" and tx.normal("F.C.") == "f c" and tx.normal("BC") == ""
    assert tx.normal_player("J. Landaluce M.") == "landaluce" and tx.normal_player("B/A") == "a/b"
    assert tx.token_set("real madrid", "madrid real club deportivo") == 100 and tx.token_set("", "x") == 0 and tx.indel("abc", "abd") == 200 * 2 / 6
    assert tx.contradict("gold coast knights", "gold coast united") and not tx.contradict("man city", "manchester city")


def test_fixtures_are_matched_one_to_one_with_reasons(spark):
    soft = [(1, "soccer", "Alpha Rovers", "Beta City", None, 1000), (2, "soccer", "Alpha Rovers W", "Beta City W", None, 1000), (3, "soccer", "Gamma", "Delta United", None, 5000), (4, "soccer", "Epsilon", "Zeta", None, None), (5, "soccer", "Alpha Rovers", "Beta City", None, 1500), (6, "soccer", "Gamma U19", "Delta United U19", None, 5000), (7, "soccer", None, None, None, 1000)]
    ref = [(11, "soccer", "FC Alpha Rovers", "Beta City", None, 1900), (13, "soccer", "Delta United", "Gamma", None, 5100), (14, "soccer", "Epsilon", "Zeta", None, 90_000)]
    m, rest = match_fixtures(spark.createDataFrame(soft, FX), spark.createDataFrame(ref, FX))
    got = {(r.a_id, r.b_id, r.flipped) for r in m.collect()}
    assert got == {(1, 11, False), (3, 13, True), (4, 14, False)}
    assert {r.a_id: r.reason for r in rest.collect()} == {2: "gender", 5: "taken", 6: "youth", 7: "name"}
    empty = spark.createDataFrame([], FX)
    assert match_fixtures(empty, empty)[0].count() == 0


def test_reference_feed(spark):
    matchups = [{"id": 1, "type": "matchup", "startTime": "2026-01-01T10:00:00Z", "league": "L", "participants": [{"alignment": "home", "name": "A"}, {"alignment": "away", "name": "B"}]}, {"id": 2, "parentId": 1, "type": "matchup", "units": "Corners"}, {"id": 3, "type": "special", "participants": []}]
    price = lambda d, p, pts=None: {"designation": d, "price": p, "points": pts}
    markets = [
        {"matchupId": 1, "type": "spread", "period": 0, "prices": [price("away", 120, 1.5), price("home", -140, -1.5)], "limits": [{"type": "maxRiskStake", "amount": 500.0}]},
        {"matchupId": 2, "type": "total", "period": 1, "prices": [price("over", 100, 4.5), price("under", -120, 4.5)]},
        {"matchupId": 1, "type": "moneyline", "period": 0, "prices": [price("home", 110), price("away", None)]},
        {"matchupId": 9, "type": "moneyline", "period": 0, "prices": [price("home", 110), price("away", -130)]},
    ]
    one = lambda x: spark.createDataFrame([(json.dumps(x).replace("}]", "},]", 1),)], "body string")
    got = {r.market_type: r for r in jf.reference_odds(one(matchups), one(markets), "soccer").collect()}
    assert set(got) == {"spread", "total"} and got["spread"].line == -1.5 and got["spread"].max_stake == 500 and got["spread"].selections["away"] == 2.2
    assert got["total"].submarket == "corners" and got["total"].period == "H1" and got["total"].raw_event_id == "1" and got["total"].start_time == datetime(2026, 1, 1, 10)


def test_list_view_titles_and_cells(spark):
    body = '[{"name":"1","bet":"1.8","handicap":""},{"name":"2","bet":"2.0","handicap":""},{"name":"h1","bet":"1.9","handicap":""},{"name":"AH","bet":"-3.5","handicap":"handicap"},{"name":"h2","bet":"1.95","handicap":""},{"name":"u","bet":"1.7","handicap":""},{"name":"OU","bet":"160.5","handicap":"total"},{"name":"o","bet":"","handicap":""},]'
    got = {r.market_type: (r.line, r.selections) for r in jf.list_view(spark.createDataFrame([(1, body)], "i long, body string"), "i", "body").collect()}
    assert got == {"moneyline": (None, {"home": 1.8, "away": 2.0}), "spread": (-3.5, {"home": 1.9, "away": 1.95})}
    titles = spark.createDataFrame([("1st Half  Total",), ("Total",), ("Corner Total",), ("?",)], "t string")
    rules = [("1st half.*total", "total", "H1"), ("total", "total", "FT")]
    assert [r.c and tuple(r.c) for r in titles.select(jf.classify(F.col("t"), rules, ["corner"]).alias("c")).collect()] == [("total", "H1"), ("total", "FT"), None, None]
    page = '<div class="title">Handicap</div><div class="x cell">1 <b>(-3.0)</b> 1.85</div><div class=cell>2 (+3.0) 1.95<br></div><div class="title">Winner</div><div class="cell">X 3.4</div><div class="cell">bad</div>'
    cells = hp.detail_cells(spark.createDataFrame([(7, page), (8, None)], "i long, h string"), "i", "h")
    assert {(r.section, r.side, r.line, r.price) for r in hp.cell_prices(cells).collect()} == {("Handicap", "home", -3.0, 1.85), ("Handicap", "away", -3.0, 1.95), ("Winner", "draw", None, 3.4)}
    form = spark.createDataFrame([('<input type="hidden" name="a" value="1"/><input type="hidden" name="b" value="">',)], "h string")
    assert form.select(hp.hidden_fields(F.col("h")).alias("m")).first().m == {"a": "1", "b": ""}
    assert hp.delta_parts("5|panel|p1|a|b|c|3|hidden|f|xyz|9|cut|z|ab") == [("panel", "p1", "a|b|c"), ("hidden", "f", "xyz")]


def test_wire(spark):
    value = bytes([0x93, 0x01, 0xA2]) + b"hi" + bytes([0x81, 0xA1]) + b"k" + b"\xcb" + struct.pack(">d", 1.5)
    data = bytes([len(value)]) + value + bytes([200])
    assert wire.unpack(value)[0] == [1, "hi", {"k": 1.5}] and wire.frames(data) == [value]
    got = wire.messages(spark.createDataFrame([(1, bytearray(data)), (2, None)], "i long, c binary"), "i", "c").collect()
    assert [json.loads(r.message) for r in got] == [[1, "hi", {"k": 1.5}]]


def test_sinks(spark, tmp_path):
    odds = spark.createDataFrame([("b", "s", "H", "A", "total", "FT", 2.5, None, "corners", None, {"over": 2.0, "under": None}, datetime(2026, 1, 1), 10.0)], "source string, sport string, home string, away string, market_type string, period string, line double, team_side string, submarket string, raw_event_id string, selections map<string,double>, fetched_at timestamp, max_stake double")
    rows = sinks.tick_rows(odds)
    r = rows.where("selection = 'over'").first()
    assert (r.market_type, r.source_event_id, r.meta) == ("corners_total", "H|A", '{"max_stake":10.0}') and rows.count() == 2
    for _ in range(2):
        sinks.append_history(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    sinks.write_snapshot(odds.select("source"), str(tmp_path / "s"), "2026-01-01 00:00:00")
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), "2026-01-01 11:00:00").count() == 1 and sinks.read_snapshot(spark, str(tmp_path / "s"), "2026-01-01 13:00:00").count() == 0
    log = spark.createDataFrame([("2026-01-01 00:00:00",), ("2025-01-01 00:00:00",), ("?",)], "t string")
    assert sinks.prune(log, "t", "2026-01-02 00:00:00", 10).count() == 2
