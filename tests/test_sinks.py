from pyspark.sql import functions as F

from oddsloom.operators import flags as fl
from oddsloom.sources import sinks

TICK = "book string, sport string, source_event_id string, market_type string, period string, line double, team_side string, selection string, odds double, meta string"


def tick(book, event, side, odds, line=None):
    return (book, "soccer", event, "total", "FT", line, None, side, odds, None)


def test_cycles_append_changes_only_and_end_what_is_missing(spark, tmp_path):
    d = str(tmp_path / "store")
    run = lambda rows, at, **k: sorted((r.book, r.source_event_id, r.selection, r.line, r.odds) for r in sinks.record_cycle(spark.createDataFrame(rows, TICK), d, at, **k).collect())
    first = [tick("b", "1", "over", 1.9, 2.5), tick("b", "1", "under", 1.9, 2.5), tick("b", "2", "home", 2.0), tick("c", "1", "over", 1.8, 2.5)]
    assert len(run(first, "2026-01-01 10:00:00")) == 4
    assert run([tick("b", "1", "over", 1.95, 2.5), tick("b", "1", "under", 1.9, 2.5), tick("b", "1", "under", 1.7, 2.5)], "2026-01-01 10:01:00", failed=[("c", "soccer")]) == [("b", "1", "over", 2.5, 1.95), ("b", "2", "home", None, None)]
    # partial and empty cycles end nothing; a price that comes back is a change
    assert run([tick("b", "2", "home", 2.0)], "2026-01-01 10:02:00", partial=[("b", "soccer")]) == [("b", "2", "home", None, 2.0)]
    assert {(r.book, r.source_event_id, r.selection): r.odds for r in sinks.newest_prices(spark, d).collect()} == {("b", "1", "over"): 1.95, ("b", "1", "under"): 1.9, ("b", "2", "home"): 2.0, ("c", "1", "over"): 1.8}
    beats = {(r.book, str(r.ts)[-5:]): (r.ok, r.rows) for r in spark.read.parquet(f"{d}/cycles").collect()}
    assert beats[("c", "01:00")] == (False, 0) and beats[("b", "02:00")] == (True, 1)


def test_snapshots_lose_only_what_is_broken(spark, tmp_path):
    p = str(tmp_path / "snap")
    sinks.write_snapshot(spark.createDataFrame([(1, "a", {"x": 1.5}), (2, None, None)], "i int, s string, m map<string,double>"), p, "2026-01-01 10:00:00")
    assert sorted((r.i, r.s, r.m) for r in sinks.read_snapshot(spark, p, "2026-01-01 21:00:00").collect()) == [(1, "a", {"x": 1.5}), (2, None, None)]
    assert sinks.read_snapshot(spark, p, "2026-01-02 21:00:00").count() == 0
    more = spark.read.parquet(p).limit(1).withColumn("entry", F.lit('{"i": 3')).unionByName(spark.read.parquet(p).limit(1).withColumn("version", F.lit(0)))
    more.write.mode("append").parquet(p)
    assert sinks.read_snapshot(spark, p, "2026-01-01 21:00:00").count() == 2


def test_histories_of_scans_and_plans(spark, tmp_path):
    for at in ("a", "b"):
        sinks.append_csv(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "h"), at)
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 2
    listing = spark.createDataFrame([(i, p, s) for i, p, s in ((1, "p", None), (2, "p", "2026-01-01 12:00:00"), (3, "new", "2026-01-01 12:00:00"), (4, "p", "2026-01-09 12:00:00"), (5, "p", "2026-01-01 12:00:00"), (6, None, "2026-01-01 12:00:00"))], "id int, p string, s string").withColumn("s", F.col("s").cast("timestamp_ntz"))
    cache = spark.createDataFrame([(2, "p", "2026-01-01 09:00:00", False), (3, "p", "2026-01-01 09:00:00", True), (5, "p", "2026-01-01 01:00:00", False), (6, "", "2026-01-01 09:00:00", True), (6, "z", "2025-01-01 09:00:00", False)], "id int, p string, loaded_at string, failed boolean")
    cache = cache.select("id", F.sha2("p", 256).alias("hash"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), "failed")
    got = {r.id: r.plan for r in fl.refresh_plan(listing, cache, "id", "p", start="s", now="2026-01-01 10:00:00", horizon_hours=24).collect()}
    assert got == {1: "expand", 2: "cached", 3: "expand", 4: "beyond_horizon", 5: "list_fallback", 6: "failed"}
