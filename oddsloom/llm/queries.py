"""Queries of the llm subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm.asof import nearest_recordings
from oddsloom.llm.matching import match
from oddsloom.llm.mixing import memberships, mixture, share_report
from oddsloom.llm.names import link_names, linked_pairs
from oddsloom.llm.packing import fill_report, pack
from oddsloom.llm.quality import not_prose, quality
from oddsloom.llm.tokens import with_tokens
from oddsloom.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    bets = table(spark, d, "bets")
    asked = bets.select("bet_id", F.explode(F.array(
        F.struct(F.lit("placed").alias("anchor"), F.col("placed_at").alias("at"), F.lit(600_000_000).alias("tol")),
        F.struct(F.lit("start").alias("anchor"), F.col("start_time").alias("at"), F.lit(1_800_000_000).alias("tol")),
    )).alias("q")).select("bet_id", "q.*")
    return nearest_recordings(table(spark, d, "bet_odds_history"), asked, entity="bet_id", time="recorded_at", ident="history_id", anchor="anchor", q_time="at", tolerance="tol")


P5_FOUND = """
WITH asked AS (
  SELECT bet_id, 'placed' AS anchor, placed_at AS at, 600000000 AS tol FROM bets
  UNION ALL SELECT bet_id, 'start', start_time, 1800000000 FROM bets
), near AS (
  SELECT a.bet_id, a.anchor, h.history_id,
         row_number() OVER (PARTITION BY a.bet_id, a.anchor
                            ORDER BY abs(epoch_us(h.recorded_at) - epoch_us(a.at)), h.recorded_at, h.history_id) AS n
  FROM asked a JOIN bet_odds_history h ON h.bet_id = a.bet_id
  WHERE abs(epoch_us(h.recorded_at) - epoch_us(a.at)) <= a.tol
)
SELECT bet_id, anchor, history_id FROM near WHERE n = 1
"""


def name_links(spark: SparkSession, d: str) -> DataFrame:
    odds = table(spark, d, "odds")
    names = odds.select("sport", F.explode(F.array("home", "away")).alias("name")).unionByName(table(spark, d, "unmatched_events").select("sport", F.col("best_pin_home").alias("name")))
    return link_names(names.withColumnRenamed("sport", "domain"), people=["tennis"])


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with the centre of its cluster: the links without their expansion into pairs."""
    return name_links(spark, d).select(F.col("domain").alias("sport"), "name", "side", "centre")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(name_links(spark, d)).withColumnRenamed("domain", "sport")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs of book_events with their confidence."""
    events = table(spark, d, "book_events").withColumnsRenamed({"event_id": "id", "book": "source", "sport": "domain"})
    return match(events, people=["tennis"]).withColumnsRenamed({"id_a": "event_id_a", "id_b": "event_id_b"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).where("confidence >= 0.5").select("event_id_a", "event_id_b")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one of over 2,048 tokens, with its container."""
    return pack(with_tokens(table(spark, d, "documents"), ident="doc_id", text="text"), ident="doc_id", size="n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packing(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their numbers of copies."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), ident="doc_id", text="text", source="source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of every source its target, its actual share of the tokens and the share expected by the memberships."""
    targets = table(spark, d, "mix_targets")
    return share_report(memberships(table(spark, d, "documents"), targets, ident="doc_id", text="text", source="source"), targets)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and outlier score of every document."""
    return quality(table(spark, d, "documents"), table(spark, d, "common_words"), ident="doc_id", text="text", lang="lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(p9_statistics(spark, d)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p6_found": p6_found, "p7_packing": p7_packing, "p7_fill": p7_fill, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND}
