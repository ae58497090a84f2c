"""Queries over the whole of their tables, against brute force."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oddsloom.operators import fixtures as fx
from oddsloom.operators import series as se

D = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def test_sessions_of_all_markets_by_brute_force(spark):
    hours = {1: [0, 1, 5, 11, 23, 23.5, 24.5, 30.4, 36.5, 100], 2: [3, 9, 14.9], 3: [47.9, 48.1, 54.0]}
    t0 = datetime(2026, 1, 1)
    ticks = [(m, t0 + timedelta(hours=h)) for m, hs in hours.items() for h in hs]
    df = spark.createDataFrame(ticks, "market_id long, ts timestamp_ntz").repartition(3)
    want = set()
    for m, hs in hours.items():
        held = []
        for h in [*sorted(hs), float("inf")]:
            if held and h >= held[-1] + 6:
                want.add((m, t0 + timedelta(hours=held[0]), t0 + timedelta(hours=held[-1]), len(held)))
                held = []
            held.append(h)
    assert {tuple(r) for r in se.sessions(df, 6).select("market_id", "start", "last", "n").collect()} == want
    assert {tuple(r) for r in se.sessions(df, 6, slice_hours=7).select("market_id", "start", "last", "n").collect()} == want


@needs_tables
def test_session_windows_all_holds_every_tick(spark):
    out = entry.queries()["session_windows_all"](spark, D)
    assert out.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{D}/ticks.parquet").count() and out.where("market_id = 1").count() > 0


FX = "id long, book string, sport string, home string, away string, league string, start long"


def test_fixtures_of_every_book_and_without_kickoff(spark):
    soft = [(1, "b", "soccer", "Alpha Rovers", "Beta City", None, 1000), (2, "c", "soccer", "Alpha Rovers", "Beta City", None, 1000), (3, "c", "soccer", "Alpha Rovers", "Beta City", None, 1200),
            (4, "b", "soccer", "Topimujra", "Sotihanur", None, None), (5, "c", "soccer", "Gemobonal Sporting", "Hufneamur", None, None), (6, "c", "soccer", "Ub", "Deffupani", None, None), (7, "d", "soccer", "Rimolaka", "Wesotunu", None, 50)]
    ref = [(11, "a", "soccer", "Alpha Rovers", "Beta City", None, 1100), (14, "a", "soccer", "Topimujar", "Sotihanur", None, 9000), (15, "a", "soccer", "Hufneamur", "Gemobonal Sporting", None, 9000), (16, "a", "soccer", "Ub", "Deffupani", None, 9000), (17, "a", "soccer", "Wesotunu", "Rimolaka", None, None)]
    m, rest = fx.match_fixtures(spark.createDataFrame(soft, FX), spark.createDataFrame(ref, FX), ("book",))
    assert {(r.a_id, r.b_id, r.flipped) for r in m.collect()} == {(1, 11, False), (2, 11, False), (4, 14, False), (5, 15, True), (6, 16, False), (7, 17, True)}
    assert {r.a_id: r.reason for r in rest.collect()} == {3: "taken"}


@needs_tables
def test_event_match_holds_every_soft_book(spark):
    e = spark.read.parquet(f"{D}/book_events.parquet")
    books = {r.book for r in entry.queries()["event_match"](spark, D).join(e, F.col("a_id") == F.col("event_id")).select("book").distinct().collect()}
    assert books == {r.book for r in e.where("book <> 'apex'").select("book").distinct().collect()}
