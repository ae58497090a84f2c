"""Writing results: partitioned histories, snapshots with an age, exports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.plans.materialize import table as stored

#: What names a tick's series, and the number of the snapshots' form.
TICK_KEY = ["book", "sport", "source_event_id", "market_type", "period", "line", "team_side", "selection"]
SNAPSHOT_VERSION = 1
FILES_A_PARTITION = 8


def tick_rows(odds: DataFrame) -> DataFrame:
    """Canonical rows as tick rows: the submarket in front of the market, names for a missing event id, the stake limit as JSON."""
    return odds.select(
        F.col("source").alias("book"), "sport", F.coalesce("raw_event_id", F.concat_ws("|", "home", "away")).alias("source_event_id"), F.concat_ws("_", "submarket", "market_type").alias("market_type"), "period", "line", "team_side",
        F.explode(F.map_entries("selections")).alias("e"), F.col("fetched_at").alias("ts"), F.when(F.col("max_stake").isNotNull(), F.to_json(F.struct("max_stake"))).alias("meta"),
    ).select("*", F.col("e.key").alias("selection"), F.col("e.value").alias("odds")).drop("e")


def append_history(ticks: DataFrame, path: str, by: tuple[str, ...] = ("book", "sport"), spread_by: str = "selection") -> None:
    """Appends, one directory a book and sport, of at most FILES_A_PARTITION files, so that a hot partition is written by several tasks."""
    ticks.repartition(*by, F.pmod(F.xxhash64(spread_by), F.lit(FILES_A_PARTITION))).write.mode("append").partitionBy(*by).parquet(path)


def append_csv(df: DataFrame, path: str, at: str) -> None:
    """Adds a scan's rows, with the scan's time, to a history of scans."""
    df.withColumn("scanned_at", F.lit(at)).write.mode("append").option("header", True).csv(path)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return like.limit(0)


def record_cycle(rows: DataFrame, folder: str, at: str, *, failed: list[tuple[str, str]] = (), partial: list[tuple[str, str]] = ()) -> DataFrame:
    """One poll of all books: rows (TICK_KEY, odds, meta) as ticks of the time `at`. Appends to the history what differs from the newest price of its series,
    and a null for each priced series of a book and sport that is missing from its cycle; renews the table of newest prices; last, a
    heartbeat (book, sport, ts, ok, rows) a book and sport marks the cycle as complete. Returns the ticks appended.

    A failed, partial or empty cycle of a book and sport ends no series. Null parts of a key are equal. Repeated keys keep the highest price."""
    spark = rows.sparkSession
    ts = F.lit(at).cast("timestamp_ntz")
    now = rows.groupBy(*TICK_KEY).agg(F.max_by(F.struct("odds", "meta"), "odds").alias("x")).select(*TICK_KEY, "x.odds", "x.meta", ts.alias("ts"))
    cycles = spark.createDataFrame([(b, s, False) for b, s in failed] or [], "book string, sport string, ok boolean")
    beat = now.groupBy("book", "sport").agg(F.count("*").alias("rows")).join(F.broadcast(cycles), ["book", "sport"], "full").select("book", "sport", ts.alias("ts"), F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    done = _stored(spark, f"{folder}/cycles", beat)
    turn = done.select("ts").distinct().count()
    latest = _stored(spark, f"{folder}/latest/turn={turn}", now)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(f"_{c}") for c in TICK_KEY]
    names = [f"_{c}" for c in TICK_KEY]
    old = latest.select(*key, F.col("odds").alias("_odds"), F.lit(True).alias("_known"))
    changed = now.select("*", *key).join(old, names, "left").where(F.col("_known").isNull() | ~F.col("odds").eqNullSafe(F.col("_odds"))).select(*now.columns)
    partly = spark.createDataFrame(list(partial) or [], "book string, sport string")
    whole = beat.where("ok AND rows > 0").join(F.broadcast(partly), ["book", "sport"], "left_anti").select("book", "sport")
    gone = latest.where("odds IS NOT NULL").join(F.broadcast(whole), ["book", "sport"], "left_semi").select("*", *key).join(now.select(*key), names, "left_anti")
    gone = gone.select(*TICK_KEY, F.lit(None).cast("double").alias("odds"), F.lit(None).cast("string").alias("meta"), ts.alias("ts"))
    ticks = stored(changed.unionByName(gone))
    append_history(ticks, f"{folder}/history")
    newest = latest.unionByName(ticks).groupBy(*TICK_KEY).agg(F.max_by(F.struct("odds", "meta", "ts"), "ts").alias("x")).select(*TICK_KEY, "x.*")
    newest.select(*now.columns).write.mode("overwrite").parquet(f"{folder}/latest/turn={turn + 1}")
    beat.coalesce(1).write.mode("append").parquet(f"{folder}/cycles")  # a row a book and sport
    return _stored(spark, f"{folder}/history", now).where(F.col("ts") == ts)


def newest_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The newest prices after the last complete cycle."""
    turn = spark.read.parquet(f"{folder}/cycles").select("ts").distinct().count()
    return spark.read.parquet(f"{folder}/latest/turn={turn}")


def write_snapshot(df: DataFrame, path: str, at: str) -> None:
    """Entries as JSON with the number of their form and the time of saving, so that an entry that cannot be read later costs only itself."""
    df.select(F.to_json(F.struct("*")).alias("entry"), F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(at).cast("timestamp").alias("saved_at"), F.lit(json.dumps([f"`{c}` {t}" for c, t in df.dtypes])).alias("columns")).write.mode("overwrite").parquet(path)


def read_snapshot(spark: SparkSession, path: str, now: str, hours: int = 12) -> DataFrame:
    """Entries of a snapshot that is not older than so many hours at `now`; those of another form and those that are broken are left out."""
    kept = spark.read.parquet(path).where((F.col("saved_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("version") == SNAPSHOT_VERSION))
    head = spark.read.parquet(path).select("columns").first()
    schema = ", ".join(json.loads(head["columns"])) if head else "entry string"
    told = kept.select(F.from_json("entry", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("e"), "saved_at")
    return told.where("e IS NOT NULL AND e._broken IS NULL").select("e.*", "saved_at").drop("_broken")


def prune(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows not older than so many days, and those whose time cannot be read."""
    t = F.col(at).try_cast("timestamp")
    return df.where(t.isNull() | (t >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
