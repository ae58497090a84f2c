"""Prices of several sources side by side: markets joined by a shared meeting id, sources without one attached over the reference, best
prices, edges, stakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.operators import board as bo

MARKET = ["sport", "meeting", "market_type", "period", "line", "submarket", "team_side"]


def _line_as_text(df: DataFrame) -> DataFrame:
    """Rows spread by a double are spread again to be grouped by it, as Spark takes its zeros as equal; by a text they are not. Minus nought is nought."""
    return df.withColumn("line", (F.col("line") + 0.0).cast("string"))


def _line_as_number(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.col("line").cast("double"))


def meetings(board: DataFrame, pairs: DataFrame, shared: str = "sr_match_id") -> DataFrame:
    """(source, sport, event, meeting, own, flipped): the shared id of each event. own: given by its source. Events of sources that give none get it from a
    reference event with which both they and an event with an id are matched (of several ids the one that sorts first).

    pairs: source, sport, event, ref_event, flipped. Null ids and empty ones count as none."""
    on = ["source", "sport", "event"]
    own = board.where(F.length(shared) > 0).groupBy(*on).agg(F.min(shared).alias("meeting"))
    bridge = own.join(pairs, on).groupBy("sport", "ref_event").agg(F.min_by(F.struct("meeting", "flipped"), "meeting").alias("x"))
    by_ref = pairs.join(own.select(*on), on, "left_anti").join(bridge, ["sport", "ref_event"])
    return own.withColumns({"own": F.lit(True), "flipped": F.lit(False)}).unionByName(by_ref.select(*on, "x.meeting", F.lit(False).alias("own"), (F.col("flipped") != F.col("x.flipped")).alias("flipped")))


def priced_markets(board: DataFrame, known: DataFrame) -> DataFrame:
    """(MARKET, side, source, price): the best price of each source. Markets exist by the sources that give the id; others only add to them."""
    rows = _line_as_text(bo.flip_quotes(board.join(known, ["source", "sport", "event"]), "flipped").withColumn("line", F.round("line", 2)))
    q = bo.long_quotes(rows, *MARKET, "source", "own").repartition(*MARKET).groupBy(*MARKET, "side", "source").agg(F.max("price").alias("price"), F.max("own").alias("own"))
    return _line_as_number(q.withColumn("_there", F.max("own").over(Window.partitionBy(*MARKET))).where("_there").drop("_there", "own"))


def fair_prices(board: DataFrame, reference: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(MARKET, side, fair): the reference's price without margin for markets of sources that give the id (of several the largest)."""
    on = ["source", "sport", "event"]
    own = known.where("own").select(*on, "meeting")
    near = bo.closest_line(board.select("odds_id", *on, *bo.SPEC, "line").join(own, on), reference, pairs.join(own.select(*on), on, "left_semi"))
    j = bo.fair_sides(near, "ref_selections").where("fair IS NOT NULL")
    return j.withColumn("line", F.round("line", 2)).select(*MARKET, F.explode("fair").alias("side", "p")).where("p > 0").groupBy(*MARKET, "side").agg(F.max(1 / F.col("p")).alias("fair"))


def best_lines(priced: DataFrame, fair: DataFrame | None = None, *, least: float = 0.0, kind: str | None = None) -> DataFrame:
    """A row a side of every market that two sources price on some side: prices (map of source to price), best source and price, its edge over the
    fair price in percent and, for the market, arb_pct where the best prices of all its sides imply less than 1.

    Kept are markets whose best edge (kind 'ev'), arbitrage ('arb') or either (None) is at least `least` percent. A market has three sides if
    a draw is priced in a moneyline, else two."""
    rows = priced.select(*MARKET, "side", "source", "price", F.lit(None).cast("double").alias("fair"))
    if fair is not None:
        rows = rows.unionByName(fair.select(*MARKET, "side", "fair"), allowMissingColumns=True)
    quote = lambda *c: F.when(F.col("price").isNotNull(), F.struct(*c))
    sides = _line_as_text(rows).repartition(*MARKET).groupBy(*MARKET, "side").agg(
        F.map_from_entries(F.array_sort(F.collect_list(quote("source", "price")))).alias("prices"), F.count("price").alias("sources"), F.max_by(quote("source", "price"), quote("price", "source")).alias("best"), F.max("fair").alias("fair")
    ).where("sources > 0")
    sides = sides.select(*MARKET, "side", "prices", "sources", F.col("best.source").alias("best_source"), F.col("best.price").alias("best_price"), "fair")
    sides = sides.withColumn("edge_pct", (F.col("best_price") / F.col("fair") - 1) * 100)
    all_of = lambda f: f.over(Window.partitionBy(*MARKET))
    draw = F.max(((F.col("side") == "draw") & (F.col("market_type") == "moneyline")).cast("int"))
    by = sides.withColumns({"_n": all_of(F.count("*")), "_most": all_of(F.max("sources")), "_draw": all_of(draw), "_implied": all_of(F.sum(1 / F.col("best_price"))), "_top": all_of(F.max("edge_pct"))}).where("_most >= 2")
    by = by.withColumn("arb_pct", F.when((F.col("_n") >= F.when(F.col("_draw") == 1, 3).otherwise(2)) & (F.col("_implied") < 1), (1 - F.col("_implied")) * 100))
    ev, ar = F.coalesce(F.col("_top") >= least, F.lit(False)), F.coalesce(F.col("arb_pct") >= least, F.lit(False))
    return _line_as_number(by.where(ev if kind == "ev" else ar if kind == "arb" else ev | ar).drop("_n", "_most", "_draw", "_implied", "_top"))


def arb_legs(priced: DataFrame, least: float = 0.0) -> DataFrame:
    """Legs of arbitrages over sources: MARKET, side, source, price, edge_pct and stake_pct, the share of the whole stake that makes all sides pay
    alike. All sides are needed, from two sources at least; ties of prices go to the source that sorts first."""
    best = bo.best_prices(priced, MARKET)
    safe = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in MARKET}
    best = best.withColumns(safe)
    by = best.groupBy(*safe).agg(F.count("*").alias("n"), F.max(((F.col("side") == "draw") & (F.col("market_type") == "moneyline")).cast("int")).alias("draw"), F.size(F.collect_set("source")).alias("books"), F.sum(1 / F.col("price")).alias("implied"))
    by = by.where((F.col("n") >= F.when(F.col("draw") == 1, 3).otherwise(2)) & (F.col("books") >= 2)).withColumn("edge_pct", (1 - F.col("implied")) * 100).where(F.col("edge_pct") >= least)
    return best.join(by, list(safe)).select(*MARKET, "side", "source", "price", "edge_pct", (1 / F.col("price") / F.col("implied") * 100).alias("stake_pct"))


def opportunities(joined: DataFrame, least: float = 1.0, *, kind: str | None = None, source: str | None = None) -> DataFrame:
    """Value and arbitrage rows of all sources and sports in one relation: kind ('EV' or 'ARB'), odds_id, ref_id, source, sport, event, side, price, fair or
    reference price, edge in percent, confidence. joined: closest_line() with score and gap_seconds of the match."""
    scored = joined.select("odds_id", "sport", "score", "gap_seconds").distinct()
    ev = bo.value_edges(joined, least).select(F.lit("EV").alias("kind"), "odds_id", "ref_id", "source", "event", "side", "price", (1 / F.col("p")).alias("ref_price"), "edge")
    ar = bo.arb_edges(joined).where(F.col("margin") >= least).select(F.lit("ARB").alias("kind"), "odds_id", "ref_id", "source", "event", "side", "price", "ref_price", F.col("margin").alias("edge"))
    out = ev.unionByName(ar).join(scored, "odds_id")
    out = out.withColumn("confidence", bo.match_confidence(F.col("kind"), F.col("score"), F.col("gap_seconds"), F.col("edge"))).drop("score", "gap_seconds")
    return out.where((F.lit(kind is None) | (F.col("kind") == kind)) & (F.lit(source is None) | (F.col("source") == source)))
