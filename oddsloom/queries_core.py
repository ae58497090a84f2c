"""Queries of the general data problems (1 to 3) over the engine's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions.times import micros
from oddsloom.operators.instants import with_instants
from oddsloom.operators.shredding import shred
from oddsloom.operators.spikes import implausible
from oddsloom.plans.joins import lookup
from oddsloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    markets, events = table(spark, d, "markets"), table(spark, d, "book_events").select("event_id", F.col("book").alias("source"))
    book_of = markets.select("market_id", "event_id").join(events, "event_id", "left").select("market_id", "source")
    ticks, latest = table(spark, d, "ticks"), table(spark, d, "latest")
    readings = ticks.select(F.lit("ticks").alias("tab"), F.col("tick_id").alias("row_id"), "market_id", "selection", micros(ticks, "ts").alias("t"), F.col("odds").alias("v"), F.lit(0).alias("probe")).unionByName(
        latest.select(F.lit("latest").alias("tab"), F.col("latest_id").alias("row_id"), "market_id", "selection", micros(latest, "ts").alias("t"), F.col("odds").alias("v"), F.lit(1).alias("probe"))
    )
    known = lookup(readings, book_of, ["market_id"], salt_from="row_id", rows=markets.count())
    return implausible(known.select("tab", "row_id", F.xxhash64("market_id", "selection").alias("series"), "source", "t", "v", "probe"), rows=ticks.count())


#: Natural keys of the tables in the payloads, and the relations asked for: feed, table, key of the child.
PAYLOAD_KEYS = {
    "gamezip_bball_matched": {"$": "Value.I", "$.Value.GE": "G", "+$.Value.GE": "parent"},
    "basketball_board": {"$.data": "eventId", "$.data.eventGames": "gameId"},
    "soccer_events": {"$": "@key"},
    "tennis_events": {"$": "@key"},
}
RELATIONS = [
    ("sg", "gamezip_bball_matched", "$.Value.SG", "I"),
    ("group", "gamezip_bball_matched", "$.Value.GE", "G"),
    ("price", "gamezip_bball_matched", "$.Value.GE.E.[]", None),
    ("game", "basketball_board", "$.data.eventGames", "gameId"),
    ("outcome", "basketball_board", "$.data.eventGames.outcomes", "outcomeId"),
    ("competitor", "soccer_events", "$.competitors", "name"),
    ("competitor", "tennis_events", "$.competitors", "name"),
]


def payload_tables(spark: SparkSession, d: str) -> DataFrame:
    return _shredded(table(spark, d, "raw_payloads"))


def _shredded(payloads: DataFrame) -> DataFrame:
    repeated = {f: [t for _, g, t, _ in RELATIONS if g == f] for f in PAYLOAD_KEYS}
    repeated["gamezip_bball_matched"].append("$.Value.GE.E")
    repeated["basketball_board"].append("$.data")
    return shred(payloads, ident="payload_id", feed="feed", body="body", keys=PAYLOAD_KEYS, repeated=repeated, carry=["book"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = payload_tables(spark, d)
    spot = F.regexp_replace(F.regexp_extract("row_id", r"/E/([0-9]+/\[\]/[0-9]+)$", 1), r"/\[\]/", ".")
    is_ = lambda feed, tab: (F.col("feed") == feed) & (F.col("tab") == tab)
    rel, child = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, feed, tab, key in reversed(RELATIONS):
        there = is_(feed, tab)
        rel = F.when(there, F.lit(name)).otherwise(rel)
        child = F.when(there, F.col("columns")[key] if key else F.when(F.size("columns") > 1, spot)).otherwise(child)
    found = rows.select("payload_id", rel.alias("rel"), F.col("parent_key").alias("parent_id"), child.alias("child_id"))
    return found.where("rel IS NOT NULL AND parent_id IS NOT NULL AND child_id IS NOT NULL").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return kickoff_instants(spark, d).where("utc_ms IS NOT NULL").select("src", "row_id", "item", "utc_ms").distinct()


def kickoff_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every kickoff text of the odds and the two payload feeds with its instant and status."""
    odds = table(spark, d, "odds").select(F.lit("odds").alias("src"), F.col("odds_id").alias("row_id"), F.lit("").alias("item"), F.col("source").alias("book"), F.col("start_time").alias("said"))
    rows = _shredded(table(spark, d, "raw_payloads").where(F.col("feed").isin("soccer_events", "basketball_board")))
    col = lambda name: F.col("columns")[name]
    soccer = (F.col("feed") == "soccer_events") & (F.col("tab") == "$")
    inside = rows.where(soccer | ((F.col("feed") == "basketball_board") & (F.col("tab") == "$.data"))).select(
        F.col("feed").alias("src"), F.col("payload_id").alias("row_id"), F.when(soccer, col("@key")).otherwise(col("eventId")).alias("item"), "book", F.when(soccer, col("startTime")).otherwise(col("eventStart")).alias("said")
    )
    books = table(spark, d, "books")
    said = lookup(odds.unionByName(inside.where("item IS NOT NULL")), books.select("book", "home_zone", "day_first"), ["book"], salt_from="row_id")
    return with_instants(said, text="said", zone="home_zone", day_first="day_first", zones=books)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {}
