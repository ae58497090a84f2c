from datetime import datetime, timedelta

from pyspark.sql import functions as F

from oddsloom.operators import series as se
from oddsloom.streaming import quotes as sq


def test_streams_equal_batches_over_many_micro_batches(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i, i % 3, "home", start + timedelta(minutes=i), None if i % 17 == 0 else 2.0 + (i // 5) % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "tick_id long, market_id long, selection string, ts timestamp_ntz, odds double")
    d = str(tmp_path)
    for k in range(3):
        df.where((F.col("tick_id") >= k * 100) & (F.col("tick_id") < (k + 1) * 100)).coalesce(1).write.mode("append").parquet(f"{d}/ticks.parquet")
    ticks = sq.read_table(spark, d, "ticks")
    got = {r.tick_id for r in sq.start(sq.change_only(ticks, ["market_id", "selection"], at="ts", value="odds", ident="tick_id")).collect()}
    want = {r.tick_id for r in se.change_ticks(df).collect()}
    assert got == want
    pts = df.where("odds IS NOT NULL").select(F.col("market_id").alias("k"), "ts", F.col("selection").alias("side"), (F.col("odds") / 10).alias("fair"))
    batch = {(r.k, round(r.now, 6), r.window_sec) for r in se.steam_moves(pts, ["k"]).collect()}
    live = ticks.where("odds IS NOT NULL").select(F.col("market_id").alias("k"), "ts", F.col("selection").alias("side"), (F.col("odds") / 10).alias("fair"))
    assert {(r.k, round(r.now, 6), r.window_sec) for r in sq.start(sq.steam(live, ["k"], at="ts", side="side", fair="fair")).collect()} == batch
    seen = []
    sq.each_batch(sq.without_repeats(ticks, ["market_id"], at="ts", late="1 day"), lambda b, _: seen.extend(r.market_id for r in b.collect()))
    assert sorted(seen) == [0, 1, 2]
    assert sq.start(sq.sessions(ticks, ["market_id"], at="ts", gap="10 minutes", late="0 minutes")).count() == 0
