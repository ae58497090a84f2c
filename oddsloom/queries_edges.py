"""Edges, arbitrages and grids on resolved events, and markets joined by a shared meeting id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsloom.functions import odds as fo
from oddsloom.functions import text as tx
from oddsloom.operators import board as bo
from oddsloom.operators import flags as fl
from oddsloom.operators import grid as gr
from oddsloom.operators import series as se
from oddsloom.plans.materialize import table as stored
from oddsloom.queries_board import _BOARD, _LONG, _PAIRS, REFERENCE, _board, _same_names, resolved
from oddsloom.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _both(spark, d):
    b = _board(spark, d)
    return b.where(F.col("source") != REFERENCE), b.where(F.col("source") == REFERENCE)


def _joined(spark, d):
    return bo.closest_line(*_both(spark, d), resolved(spark, d))


_EDGE = ["odds_id", "ref_id", "source", "sport", "event", "side", "price"]


@_query()
def resolved_events(spark, d):
    return resolved(spark, d)


@_query()
def closest_line_join(spark, d):
    return _joined(spark, d).select("odds_id", "ref_id", "source", "event", "flipped", F.round("gap", 6).alias("gap"))


@_query()
def ev_edges(spark, d):
    """All markets of all matched events, three-way ones by the Arrow solver."""
    return bo.value_edges(_joined(spark, d)).select(*_EDGE, F.round("p", 6).alias("p"), F.round("edge", 5).alias("edge"), F.round("stake", 4).alias("stake"))


@_query()
def arb_edges(spark, d):
    return bo.arb_edges(_joined(spark, d)).withColumn("margin", F.round("margin", 5))


@_query()
def opportunities(spark, d):
    """The feed over all sports and soft sources: value and arbitrage rows with the confidence of their match, the largest edge first by place."""
    o = gr.opportunities(stored(_joined(spark, d)))  # read three times
    w = Window.partitionBy("kind", "sport").orderBy(F.col("edge").desc(), "odds_id", "side")
    return o.withColumn("place", F.row_number().over(w)).withColumns({"edge": F.round("edge", 5), "ref_price": F.round("ref_price", 6)})


@_query()
def opportunity_alerts(spark, d):
    """What a second look at the feed alerts of: edges of five percent that are not weak, unseen in the first look (rows of even ids) or grown by a point."""
    o = stored(gr.opportunities(_joined(spark, d)))
    return fl.alerts(o, o.where("odds_id % 2 = 0").withColumn("edge", F.col("edge") - 0.5), ["kind", "source", "event", "odds_id", "side"], threshold=5.0, rise=1.0)


@_query()
def opportunities_ranked(spark, d):
    return fl.ranked(gr.opportunities(_joined(spark, d)), ["sport"])


def _quotes(spark, d):
    pairs = resolved(spark, d).select("source", "sport", "event", F.col("ref_event").alias("meeting"), "flipped")
    soft, ref = _both(spark, d)
    rows = bo.flip_quotes(soft.join(pairs, ["source", "sport", "event"]), "flipped").drop("flipped").unionByName(ref.withColumn("meeting", F.col("event")))
    return bo.long_quotes(rows, "source", "sport", "meeting", *bo.SPEC, "line")


@_query()
def cross_book_grid(spark, d):
    """The best price of every side of every market over all sources, by matched events."""
    return bo.best_prices(_quotes(spark, d), gr.MARKET).select(*gr.MARKET, "side", "source", "price", "sources")


@_query()
def cross_book_arbs(spark, d):
    best = bo.best_prices(_quotes(spark, d), gr.MARKET)
    return bo.cross_source_arbs(best, gr.MARKET).withColumns({"implied": F.round("implied", 6), "margin": F.round("margin", 5)})


@_query()
def cross_arb_legs(spark, d):
    """Stakes that lock the arbitrages over sources."""
    return gr.arb_legs(_quotes(spark, d)).withColumns({"edge_pct": F.round("edge_pct", 5), "stake_pct": F.round("stake_pct", 4)})


@_query()
def longest_prices(spark, d):
    """The twenty longest prices of every sport that two sources quote: a top-k report."""
    w = Window.partitionBy("sport").orderBy(F.col("price").desc(), "meeting", "market_type", "period", "line", "submarket", "team_side", "side")
    best = bo.best_prices(_quotes(spark, d), gr.MARKET)
    return best.where("sources >= 2").withColumn("place", F.row_number().over(w)).where("place <= 20").select("sport", "place", "meeting", "market_type", "period", "line", "side", "source", "price")


@_query()
def anomaly_reference(spark, d):
    """Ladder anomalies of matched events with the reference's row for the inflated line, its fair chance, the edge of the inflated price and the
    event's largest move of that source."""
    soft, ref = _both(spark, d)
    pairs = stored(resolved(spark, d))
    key = ["source", "event"]
    a = bo.ladder_anomalies(soft.join(pairs, ["source", "sport", "event"], "left_semi"))
    price = F.when(F.col("inflated") == F.col("hi_line"), F.col("hi_price")).otherwise(F.col("lo_price"))
    rows = a.select(*key, *bo.SPEC, F.col("inflated").alias("line"), "side", "pct", price.alias("price"), F.monotonically_increasing_id().alias("odds_id"))
    j = bo.fair_sides(bo.closest_line(stored(rows), ref, pairs.groupBy(*key).agg(F.min_by(F.struct("ref_event", "flipped"), "ref_event").alias("x")).select(*key, "x.*")), "ref_selections")
    p = F.try_element_at("fair", F.col("side"))
    top = se.net_moves(_points(spark, d), ["source", "raw_event_id", "period"], hours=48.0).groupBy("source", F.col("raw_event_id").alias("event")).agg(F.max(F.abs("change")).alias("top_move"))
    out = j.withColumn("p", p).join(top, key, "left")
    return out.select(*key, "market_type", "period", "side", "line", "ref_id", "price", F.round("pct", 5).alias("pct"), F.round("p", 6).alias("p"), F.round(fo.edge_pct(F.col("price"), F.col("p")), 5).alias("edge"), F.round("top_move", 6).alias("top_move"))


def _points(spark, d):
    from oddsloom.queries_board import _points as points

    return points(spark, d)


@_query()
def matches_resolved(spark, d):
    """Every soft event with its reference event, if it has one, the number of its lines and of those for which the reference has a line."""
    board = bo.board_lines(table(spark, d, "odds"))
    soft, ref = board.where(F.col("source") != REFERENCE), board.where(F.col("source") == REFERENCE)
    pairs = stored(resolved(spark, d))
    on = ["source", "sport", "event"]
    lines = soft.groupBy(*on).agg(F.count("*").alias("lines"))
    met = bo.met_lines(soft, ref, pairs).groupBy(*on).agg(F.count("*").alias("met"))
    return lines.join(pairs.groupBy(*on).agg(F.min("ref_event").alias("ref_event")), on, "left").join(met, on, "left").fillna(0, ["met"])


def _shared(spark, d, pairs):
    soft, ref = _both(spark, d)
    soft = soft.select("odds_id", "source", "sport", "event", *bo.SPEC, "line", "selections", "sr_match_id")
    soft, pairs = stored(soft), stored(pairs)
    known = stored(gr.meetings(soft, pairs))
    return soft, ref, pairs, known


@_query()
def shared_id_grid(spark, d):
    """Markets by the shared meeting id, other sources attached over the reference, with the reference's fair price, edges and arbitrage."""
    soft, ref, pairs, known = _shared(spark, d, resolved(spark, d))
    lines = gr.best_lines(gr.priced_markets(soft, known), gr.fair_prices(soft, ref, pairs, known), least=-1000.0)
    prices = F.concat_ws(" ", F.transform(F.map_entries("prices"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return lines.select(*gr.MARKET, "side", prices.alias("prices"), "sources", "best_source", "best_price", F.round("fair", 6).alias("fair"), F.round("edge_pct", 5).alias("edge_pct"), F.round("arb_pct", 5).alias("arb_pct"))


_SHARED = f"""board AS ({_BOARD}), pairs AS ({_PAIRS}), soft AS (SELECT * FROM board WHERE source <> 'apex'),
own AS (SELECT source, sport, event, min(sr_match_id) AS meeting FROM soft WHERE length(sr_match_id) > 0 GROUP BY ALL),
bridge AS (SELECT o.sport, p.ref_event, min(o.meeting) AS meeting FROM own o JOIN pairs p USING (source, event) GROUP BY ALL),
evs AS (SELECT DISTINCT source, sport, event FROM soft), known AS (SELECT source, sport, event, meeting, true AS own FROM own UNION ALL
  SELECT e.source, e.sport, e.event, b.meeting, false FROM evs e JOIN pairs p USING (source, event) JOIN bridge b ON b.sport = e.sport AND b.ref_event = p.ref_event WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.source = e.source AND o.sport = e.sport AND o.event = e.event)),
long AS ({_LONG}), q AS (SELECT k.sport, k.meeting, market_type, period, round(line, 2) AS line, submarket, team_side, side, source, max(price) AS price, bool_or(own) AS own FROM long l JOIN known k USING (source, sport, event) GROUP BY ALL),
there AS (SELECT DISTINCT sport, meeting, market_type, period, line, submarket, team_side FROM q WHERE own),
m AS (SELECT q.* FROM q JOIN there t ON t.sport = q.sport AND t.meeting = q.meeting AND t.market_type IS NOT DISTINCT FROM q.market_type AND t.period IS NOT DISTINCT FROM q.period AND t.line IS NOT DISTINCT FROM q.line AND t.submarket IS NOT DISTINCT FROM q.submarket AND t.team_side IS NOT DISTINCT FROM q.team_side)"""


@_query(f"WITH {_SHARED} SELECT sport, meeting, market_type, period, line, submarket, team_side, side, source, price FROM m")
def shared_id_markets_same_name(spark, d):
    """The markets by the shared id; the bridge over pairs of the same spelling."""
    pairs = _same_names(spark, d)
    soft, _ = _both(spark, d)
    sports = soft.select("source", "sport", "event").distinct()
    _, _, _, known = _shared(spark, d, pairs.join(sports, ["source", "event"]).withColumn("flipped", F.lit(False)))
    return gr.priced_markets(soft, known)


@_query(f"""WITH {_SHARED}, s AS (SELECT sport, meeting, market_type, period, line, submarket, team_side, side, count(*) AS sources, arg_max(source, (price, source)) AS best_source, max(price) AS best_price FROM m GROUP BY ALL),
k AS (SELECT sport, meeting, market_type, period, line, submarket, team_side, count(*) AS n, max(sources) AS most, max((side = 'draw' AND market_type = 'moneyline')::INT) AS draw, sum(1/best_price) AS implied FROM s GROUP BY ALL)
SELECT s.*, round(CASE WHEN n >= CASE WHEN draw = 1 THEN 3 ELSE 2 END AND implied < 1 THEN (1 - implied)*100 END, 5) AS arb_pct FROM s JOIN k ON k.sport = s.sport AND k.meeting = s.meeting AND k.market_type IS NOT DISTINCT FROM s.market_type AND k.period IS NOT DISTINCT FROM s.period
AND k.line IS NOT DISTINCT FROM s.line AND k.submarket IS NOT DISTINCT FROM s.submarket AND k.team_side IS NOT DISTINCT FROM s.team_side WHERE most >= 2 AND n >= CASE WHEN draw = 1 THEN 3 ELSE 2 END AND implied < 1""")
def shared_id_arbs_same_name(spark, d):
    soft, _ = _both(spark, d)
    sports = soft.select("source", "sport", "event").distinct()
    _, _, _, known = _shared(spark, d, _same_names(spark, d).join(sports, ["source", "event"]).withColumn("flipped", F.lit(False)))
    lines = gr.best_lines(gr.priced_markets(soft, known), kind="arb")
    return lines.select(*gr.MARKET, "side", "sources", "best_source", "best_price", F.round("arb_pct", 5).alias("arb_pct"))


@_query("""SELECT bet_id, CASE WHEN len(p) = 2 THEN p[1] END AS home, CASE WHEN len(p) = 2 THEN p[2] END AS away FROM (SELECT bet_id, string_split_regex(trim(match_label), '\\s+(?:[-–—]|[vV][sS]?\\.?)\\s+') AS p FROM bets)""")
def bet_sides(spark, d):
    """The sides of a bet by its label, split at a dash or 'vs'; null where the label does not name two."""
    b = table(spark, d, "bets")
    home, away = tx.label_sides(F.col("match_label"))
    return b.select("bet_id", home.alias("home"), away.alias("away"))


@_query(f"""WITH board AS ({_BOARD}), names AS (SELECT source, sport, lower(home) AS h, lower(away) AS a, min(event) AS event FROM board WHERE home IS NOT NULL AND away IS NOT NULL GROUP BY ALL),
b AS (SELECT *, CASE WHEN len(p) = 2 THEN lower(p[1]) END AS h, CASE WHEN len(p) = 2 THEN lower(p[2]) END AS a FROM (SELECT *, string_split_regex(trim(match_label), '\\s+(?:[-–—]|[vV][sS]?\\.?)\\s+') AS p FROM bets)),
evs AS (SELECT DISTINCT source, sport, event FROM board)
SELECT bet_id, coalesce(e.event, n.event) AS event, e.event IS NULL AND n.event IS NOT NULL AS by_name FROM b LEFT JOIN evs e ON e.source = b.book AND e.sport = b.sport AND e.event = b.cb_event_id LEFT JOIN names n ON n.source = b.book AND n.sport = b.sport AND n.h = b.h AND n.a = b.a""")
def bet_events(spark, d):
    """The board's event of every bet: by the event's id, else by the names in its label."""
    board = _board(spark, d)
    names = board.where("home IS NOT NULL AND away IS NOT NULL").groupBy(F.col("source").alias("book"), "sport", F.lower("home").alias("h"), F.lower("away").alias("a")).agg(F.min("event").alias("named"))
    events = board.select(F.col("source").alias("book"), "sport", F.col("event").alias("cb_event_id")).distinct().withColumn("listed", F.col("cb_event_id"))
    home, away = tx.label_sides(F.col("match_label"))
    b = table(spark, d, "bets").select("bet_id", "book", "sport", "cb_event_id", F.lower(home).alias("h"), F.lower(away).alias("a"))
    j = b.join(events, ["book", "sport", "cb_event_id"], "left").join(names, ["book", "sport", "h", "a"], "left")
    return j.select("bet_id", F.coalesce("listed", "named").alias("event"), (F.col("listed").isNull() & F.col("named").isNotNull()).alias("by_name"))
