"""Queries on the board of quotes and on price histories, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.functions import odds as fo
from oddsloom.operators import board as bo
from oddsloom.operators import fixtures as fx
from oddsloom.operators import flags as fl
from oddsloom.operators import series as se
from oddsloom.sources.tables import table

REFERENCE = "apex"
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _v(c: str) -> str:
    return f"(CASE WHEN {c} > 1 AND isfinite({c}) THEN {c} END)"


_SIDES = "SELECT *, " + ", ".join(f"{_v(f'selections[$${k}$$]')} AS {n}" for k, n in (("home", "h"), ("draw", "d"), ("away", "a"), ("over", "o"), ("under", "u"))) + ", coalesce(list_contains(map_keys(selections), 'draw'), false) AS three_way FROM odds"
_BOARD = """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY source, sport, event, market_type, period, submarket, team_side, line ORDER BY fetched_at DESC, odds_id DESC) AS n
  FROM (SELECT *, coalesce(raw_event_id, concat_ws('|', home, away)) AS event FROM odds)) WHERE n = 1"""
_LONG = """
SELECT odds_id, source, sport, event, market_type, period, submarket, team_side, section, line, fetched_at, e.key AS side, e.value AS price
FROM (SELECT *, unnest(map_entries(selections)) AS e FROM board) WHERE e.value > 1 AND isfinite(e.value)"""
_PAIRS = """
SELECT s.book AS source, s.source_event_id AS event, min(r.source_event_id) AS ref_event
FROM book_events s JOIN book_events r ON s.sport = r.sport AND s.start_time = r.start_time AND lower(s.home) = lower(r.home)
WHERE s.book <> 'apex' AND r.book = 'apex' GROUP BY ALL"""
_SHIN = """
CASE WHEN {s} <= 1 THEN {a} / {s} WHEN {z} < 0.5 THEN {a} - ({s} - 1) / 2
     ELSE (sqrt(0.25 + 2 * {a} * {a} / {s}) - 0.5) / (sqrt(0.25 + 2 * {a} * {a} / {s}) - 0.5 + sqrt(0.25 + 2 * {b} * {b} / {s}) - 0.5) END"""


def _shin(x: str, y: str) -> str:
    a, b = f"(1.0::DOUBLE / {x})", f"(1.0::DOUBLE / {y})"
    s, d = f"({a} + {b})", f"(({a} - {b}) * ({a} - {b}))"
    return _SHIN.format(a=a, b=b, s=s, z=f"(({s} - 1) * ({d} - {s}) / ({s} * ({d} - 1)))")


def _board(spark: SparkSession, d: str) -> DataFrame:
    return bo.newest_board(table(spark, d, "odds"))


def _same_names(spark: SparkSession, d: str) -> DataFrame:
    """Soft and reference listings with the same sport, kickoff and spelling of the home side: what SQL can say of the matching. The queries
    on these pairs (..._same_name) hold the operators against SQL; those without the suffix take all resolved pairs."""
    e = table(spark, d, "book_events").where("start_time IS NOT NULL").select("book", "sport", "source_event_id", "start_time", F.lower("home").alias("k"))
    soft = e.where(F.col("book") != REFERENCE).select(F.col("book").alias("source"), F.col("source_event_id").alias("event"), "sport", "start_time", "k")
    ref = e.where(F.col("book") == REFERENCE).select(F.col("source_event_id").alias("ref_event"), "sport", "start_time", "k")
    return soft.join(ref, ["sport", "start_time", "k"]).groupBy("source", "event").agg(F.min("ref_event").alias("ref_event"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """(source, sport, event, ref_event, flipped, score, gap_seconds): every soft source's events matched with the reference's by the fuzzy matcher."""
    e = table(spark, d, "book_events")
    rows = e.select(F.col("event_id").alias("id"), "book", "sport", "home", "away", "league", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start_time)").alias("start"))
    found = fx.matches(rows.where(F.col("book") != REFERENCE), rows.where(F.col("book") == REFERENCE), ("book",))
    a = e.select(F.col("event_id").alias("a_id"), F.col("book").alias("source"), "sport", F.col("source_event_id").alias("event"))
    b = e.select(F.col("event_id").alias("b_id"), F.col("source_event_id").alias("ref_event"))
    return found.join(a, "a_id").join(b, "b_id").select("source", "sport", "event", "ref_event", "flipped", F.col("mean").alias("score"), F.col("gap").alias("gap_seconds"))


def _joined(spark: SparkSession, d: str, pairs=_same_names) -> DataFrame:
    b = _board(spark, d)
    return bo.closest_line(b.where(F.col("source") != REFERENCE), b.where(F.col("source") == REFERENCE), pairs(spark, d))


_JOINED = f"""
board AS ({_BOARD}), pairs AS ({_PAIRS}), joined AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT s.*, p.ref_event, r.odds_id AS ref_id, r.line AS ref_line, r.selections AS ref_selections, coalesce(abs(s.line - r.line), 0) AS gap,
           row_number() OVER (PARTITION BY s.odds_id ORDER BY coalesce(abs(s.line - r.line), 0), r.odds_id) AS n
    FROM board s JOIN pairs p ON s.source = p.source AND s.event = p.event
    JOIN board r ON r.source = 'apex' AND r.event = p.ref_event AND r.market_type IS NOT DISTINCT FROM s.market_type AND r.period IS NOT DISTINCT FROM s.period
     AND r.submarket IS NOT DISTINCT FROM s.submarket AND r.team_side IS NOT DISTINCT FROM s.team_side AND (s.line IS NULL) = (r.line IS NULL) AND coalesce(abs(s.line - r.line), 0) <= 0.01 + 1e-9
    WHERE s.source <> 'apex') WHERE n = 1)"""


@_query("SELECT market_id, market_id % 801 - 400 AS american, round(CASE WHEN market_id % 801 - 400 < 0 THEN 100.0::DOUBLE / (400 - market_id % 801) + 1 WHEN market_id % 801 - 400 > 0 THEN (market_id % 801 - 400) / 100.0::DOUBLE + 1 END, 6) AS dec FROM markets")
def american_to_decimal(spark, d):
    m = table(spark, d, "markets").select("market_id", (F.col("market_id") % 801 - 400).alias("american"))
    return m.withColumn("dec", F.round(fo.american_to_decimal(F.col("american")), 6))


@_query(f"SELECT odds_id, three_way, round((CASE WHEN three_way THEN 1.0::DOUBLE/h + 1.0::DOUBLE/d + 1.0::DOUBLE/a ELSE coalesce(1.0::DOUBLE/h + 1.0::DOUBLE/a, 1.0::DOUBLE/o + 1.0::DOUBLE/u) END - 1) * 100, 6) AS vig FROM ({_SIDES})")
def vig_pct(spark, d):
    s = bo.with_sides(table(spark, d, "odds"))
    two = F.coalesce(fo.vig_pct(F.col("h"), F.col("a")), fo.vig_pct(F.col("o"), F.col("u")))
    return s.select("odds_id", "three_way", F.round(F.when(F.col("three_way"), fo.vig_pct(F.col("h"), F.col("d"), F.col("a"))).otherwise(two), 6).alias("vig"))


@_query(f"SELECT odds_id, round((1.0::DOUBLE/h) / (1.0::DOUBLE/h + 1.0::DOUBLE/a), 6) AS p_home, round((1.0::DOUBLE/o) / (1.0::DOUBLE/o + 1.0::DOUBLE/u), 6) AS p_over FROM ({_SIDES}) WHERE NOT three_way")
def devig_proportional(spark, d):
    s = bo.with_sides(table(spark, d, "odds")).where("NOT three_way")
    return s.select("odds_id", F.round(fo.proportional(F.col("h"), F.col("a")), 6).alias("p_home"), F.round(fo.proportional(F.col("o"), F.col("u")), 6).alias("p_over"))


@_query(f"SELECT odds_id, round({_shin('h', 'a')}, 6) AS p_home, round({_shin('o', 'u')}, 6) AS p_over FROM ({_SIDES}) WHERE NOT three_way")
def devig_shin_two_way(spark, d):
    s = bo.with_sides(table(spark, d, "odds")).where("NOT three_way")
    return s.select("odds_id", F.round(fo.shin_two_way(F.col("h"), F.col("a")), 6).alias("p_home"), F.round(fo.shin_two_way(F.col("o"), F.col("u")), 6).alias("p_over"))


_P3 = "((sqrt(z*z + 4*(1-z)*{p}*{p}/s) - z) / (2*(1-z)))"
_SHIN3 = f"""
WITH RECURSIVE t AS (SELECT DISTINCT 1.0::DOUBLE/h AS p, 1.0::DOUBLE/d AS q, 1.0::DOUBLE/a AS r FROM ({_SIDES}) WHERE three_way AND h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL),
it AS (
  SELECT p, q, r, p + q + r AS s, 0.0::DOUBLE AS lo, {{cap}}::DOUBLE AS hi, 0 AS i FROM t
  UNION ALL
  SELECT p, q, r, s, CASE WHEN f > 1 THEN z ELSE lo END, CASE WHEN f > 1 THEN hi ELSE z END, i + 1
  FROM (SELECT *, {_P3.format(p='p')} + {_P3.format(p='q')} + {_P3.format(p='r')} AS f FROM (SELECT *, (lo + hi) / 2 AS z FROM it WHERE i < {{steps}}))
), last AS (SELECT *, (lo + hi) / 2 AS z FROM it WHERE i = {{steps}}),
fair AS (SELECT p, q, r, s, {_P3.format(p='p')} AS a, {_P3.format(p='q')} AS b, {_P3.format(p='r')} AS c FROM last)
SELECT odds_id, round(CASE WHEN s <= 1 THEN p/s ELSE f.a/(f.a+b+c) END, 6) AS p_home, round(CASE WHEN s <= 1 THEN q/s ELSE b/(f.a+b+c) END, 6) AS p_draw, round(CASE WHEN s <= 1 THEN r/s ELSE c/(f.a+b+c) END, 6) AS p_away
FROM ({_SIDES}) o JOIN fair f ON 1.0::DOUBLE/o.h = f.p AND 1.0::DOUBLE/o.d = f.q AND 1.0::DOUBLE/o.a = f.r WHERE three_way"""


def _three(spark, d, method):
    s = bo.with_sides(table(spark, d, "odds")).where("three_way AND h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL").withColumn("p", method("h", "d", "a"))
    return s.select("odds_id", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p_home", "p_draw", "p_away"))])


@_query(_SHIN3.format(cap=0.5, steps=60))
def devig_shin_three_way(spark, d):
    return _three(spark, d, fo.shin_three_way)


@_query(_SHIN3.format(cap=0.99, steps=80))
def devig_shin_model(spark, d):
    return _three(spark, d, fo.shin_model)


_POWER3 = f"""
WITH RECURSIVE t AS (SELECT DISTINCT 1.0::DOUBLE/h AS p, 1.0::DOUBLE/d AS q, 1.0::DOUBLE/a AS r FROM ({_SIDES}) WHERE three_way AND h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL),
it AS (
  SELECT p, q, r, 0.001::DOUBLE AS lo, 1024.0::DOUBLE AS hi, 0 AS i FROM t
  UNION ALL SELECT p, q, r, CASE WHEN f > 1 THEN z ELSE lo END, CASE WHEN f > 1 THEN hi ELSE z END, i + 1 FROM (SELECT *, pow(p, z) + pow(q, z) + pow(r, z) AS f FROM (SELECT *, (lo + hi) / 2 AS z FROM it WHERE i < 120))
), last AS (SELECT *, (lo + hi) / 2 AS z FROM it WHERE i = 120), fair AS (SELECT p, q, r, pow(p, z) AS u, pow(q, z) AS v, pow(r, z) AS w FROM last)
SELECT odds_id, round(f.u/(f.u+f.v+f.w), 6) AS p_home, round(f.v/(f.u+f.v+f.w), 6) AS p_draw, round(f.w/(f.u+f.v+f.w), 6) AS p_away FROM ({_SIDES}) o JOIN fair f ON 1.0::DOUBLE/o.h = f.p AND 1.0::DOUBLE/o.d = f.q AND 1.0::DOUBLE/o.a = f.r WHERE three_way"""


@_query(_POWER3)
def devig_power_three_way(spark, d):
    return _three(spark, d, fo.power_three_way)


@_query(f"WITH {_JOINED} SELECT odds_id, ref_id, source, event, round(gap, 6) AS gap FROM joined")
def closest_line_join_same_name(spark, d):
    return _joined(spark, d).select("odds_id", "ref_id", "source", "event", F.round("gap", 6).alias("gap"))


_FAIR = f"""
fair AS (
  SELECT odds_id, ref_id, source, sport, event, selections, {_shin('x', 'y')} AS p, {_shin('y', 'x')} AS q, s1, s2 FROM (
    SELECT *, CASE WHEN rh IS NOT NULL AND ra IS NOT NULL THEN rh ELSE ro END AS x, CASE WHEN rh IS NOT NULL AND ra IS NOT NULL THEN ra ELSE ru END AS y,
           CASE WHEN rh IS NOT NULL AND ra IS NOT NULL THEN 'home' ELSE 'over' END AS s1, CASE WHEN rh IS NOT NULL AND ra IS NOT NULL THEN 'away' ELSE 'under' END AS s2
    FROM (SELECT *, {_v("ref_selections['home']")} AS rh, {_v("ref_selections['away']")} AS ra, {_v("ref_selections['over']")} AS ro, {_v("ref_selections['under']")} AS ru FROM joined
          WHERE NOT list_contains(map_keys(ref_selections), 'draw'))
  ) WHERE x IS NOT NULL AND y IS NOT NULL), side AS (
  SELECT odds_id, ref_id, source, sport, event, s1 AS side, {_v("selections[s1]")} AS price, p FROM fair UNION ALL
  SELECT odds_id, ref_id, source, sport, event, s2, {_v("selections[s2]")}, q FROM fair)"""


@_query(f"WITH {_JOINED}, {_FAIR} SELECT odds_id, ref_id, source, sport, event, side, price, round(p, 6) AS p, round((price*p - 1)*100, 5) AS edge, round(greatest(0, (p*price - 1)/(price - 1)*0.25*1000), 4) AS stake FROM side WHERE (price*p - 1)*100 >= 1")
def ev_edges_two_way_same_name(spark, d):
    j = _joined(spark, d).where(~F.map_contains_key("ref_selections", F.lit("draw")))
    e = bo.value_edges(j)
    return e.select("odds_id", "ref_id", "source", "sport", "event", "side", "price", F.round("p", 6).alias("p"), F.round("edge", 5).alias("edge"), F.round("stake", 4).alias("stake"))


@_query(f"""WITH {_JOINED}, long AS (SELECT odds_id, ref_id, source, event, ref_selections, e.key AS side, e.value AS price FROM (SELECT *, unnest(map_entries(selections)) AS e FROM joined WHERE NOT list_contains(map_keys(selections), 'draw')) WHERE e.value > 1 AND isfinite(e.value)),
opp AS (SELECT *, {_v("ref_selections[CASE side WHEN 'home' THEN 'away' WHEN 'away' THEN 'home' WHEN 'over' THEN 'under' WHEN 'under' THEN 'over' END]")} AS ref_price FROM long)
SELECT odds_id, ref_id, source, event, side, price, ref_price, round((1 - (1/price + 1/ref_price))*100, 5) AS margin FROM opp WHERE (1 - (1/price + 1/ref_price))*100 > 0""")
def arb_edges_same_name(spark, d):
    return bo.arb_edges(_joined(spark, d)).withColumn("margin", F.round("margin", 5))


_CONF = "CASE WHEN {e} >= 25 OR coalesce({g} > 2400, false) OR coalesce({s} < 78, false) OR ({e} >= 10 AND ({s} IS NULL OR {s} < 88)) THEN 'weak' WHEN coalesce({s} >= 88, false) AND {e} < 10 AND ({g} IS NULL OR {g} <= 1500) THEN 'strong' ELSE 'medium' END"


@_query("SELECT unmatched_id, " + _CONF.format(e="(unmatched_id % 30)", g="abs(epoch(cb_start_time) - epoch(best_pin_start_time))", s="best_score") + " AS confidence FROM unmatched_events")
def match_confidence(spark, d):
    u = table(spark, d, "unmatched_events")
    gap = F.abs(F.expr("timestampdiff(SECOND, best_pin_start_time, cb_start_time)"))
    return u.select("unmatched_id", bo.match_confidence(F.lit("EV"), F.col("best_score"), gap, (F.col("unmatched_id") % 30).cast("double")).alias("confidence"))


_LADDER = "source, event, market_type, period, submarket, team_side, section, side"
_W1 = f"""WITH board AS ({_BOARD}), long AS ({_LONG}), rungs AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {_LADDER}, line ORDER BY odds_id) AS n FROM long WHERE line IS NOT NULL AND market_type IN ('spread', 'total', 'team_total')) WHERE n = 1),
pairs AS (SELECT *, lead(line) OVER w AS hi_line, lead(price) OVER w AS hi_price FROM rungs WINDOW w AS (PARTITION BY {_LADDER} ORDER BY line)),
bad AS (SELECT *, CASE WHEN side IN ('home', 'under') THEN hi_price - price ELSE price - hi_price END AS delta FROM pairs WHERE hi_line IS NOT NULL)
SELECT {_LADDER}, line AS lo_line, hi_line, price AS lo_price, hi_price, round(delta, 6) AS delta, round(delta / least(price, hi_price) * 100, 5) AS pct, CASE WHEN side IN ('home', 'under') THEN hi_line ELSE line END AS inflated FROM bad WHERE delta > 1e-9"""


@_query(_W1)
def ladder_anomalies(spark, d):
    return bo.ladder_anomalies(_board(spark, d)).withColumns({"delta": F.round("delta", 6), "pct": F.round("pct", 5)})


@_query(f"""WITH board AS ({_BOARD}), r AS (SELECT source, sport, event, market_type, period, submarket, team_side, section, count(DISTINCT line) AS n FROM board WHERE line IS NOT NULL AND market_type IN ('spread', 'total', 'team_total') GROUP BY ALL HAVING count(DISTINCT line) >= 2),
e AS (SELECT source, sport, event, count(*) AS rows, sum((market_type = 'moneyline')::INT) AS ml FROM board GROUP BY ALL), l AS (SELECT source, sport, event, count(*) AS ladders, sum(n) AS rungs FROM r GROUP BY ALL)
SELECT e.source, e.sport, sum(e.rows)::BIGINT AS rows, count(*) AS events, sum(coalesce(ladders, 0))::BIGINT AS ladders, sum(coalesce(rungs, 0))::BIGINT AS rungs, sum(ml)::BIGINT AS moneylines, sum((ladders IS NULL)::INT)::BIGINT AS bare_events FROM e LEFT JOIN l USING (source, sport, event) GROUP BY ALL""")
def coverage_stats(spark, d):
    return bo.coverage(_board(spark, d))


@_query(f"""WITH board AS ({_BOARD}), n AS (SELECT source, event, period, market_type, section, count(*) AS rungs, min(odds_id) AS first_id FROM board WHERE line IS NOT NULL GROUP BY ALL)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source, event, period, market_type ORDER BY rungs DESC, first_id) AS k FROM n) WHERE k = 1""")
def main_section(spark, d):
    return bo.main_section(_board(spark, d))


@_query("""WITH o AS (SELECT odds_id, source, coalesce(raw_event_id, concat_ws('|', home, away)) AS event, market_type, period, submarket, team_side, line, odds_id % 3 AS rank FROM odds),
b AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY source, event, market_type, period, submarket, team_side, line ORDER BY rank, odds_id) AS n FROM o) WHERE n = 1)
SELECT odds_id, source, event, market_type, period, line, rank FROM (SELECT *, min(rank) OVER (PARTITION BY source, event, market_type, period, submarket, team_side) AS m FROM b) WHERE m > 0 OR rank = 0""")
def variant_merge(spark, d):
    o = table(spark, d, "odds").withColumn("event", F.coalesce("raw_event_id", F.concat_ws("|", "home", "away"))).withColumn("rank", F.col("odds_id") % 3)
    return bo.merge_variants(o, "rank").select("odds_id", "source", "event", "market_type", "period", "line", "rank")


_KEY = ["sport", "meeting", "market_type", "period", "line", "submarket", "team_side"]
_GRID = f"""board AS ({_BOARD}), pairs AS ({_PAIRS}), long AS ({_LONG}), q AS (
  SELECT l.*, coalesce(p.ref_event, CASE WHEN l.source = 'apex' THEN l.event END) AS meeting FROM long l LEFT JOIN pairs p ON l.source = p.source AND l.event = p.event),
m AS (SELECT sport, meeting, market_type, period, line, submarket, team_side, side, source, max(price) AS price FROM q WHERE meeting IS NOT NULL GROUP BY ALL),
best AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sport, meeting, market_type, period, line, submarket, team_side, side ORDER BY price DESC, source) AS n,
  count(*) OVER (PARTITION BY sport, meeting, market_type, period, line, submarket, team_side, side) AS sources FROM m) WHERE n = 1)"""


def _grid(spark, d):
    q = bo.long_quotes(_board(spark, d), "source", "sport", "event", *bo.SPEC, "line")
    q = q.join(_same_names(spark, d), ["source", "event"], "left").withColumn("meeting", F.coalesce("ref_event", F.when(F.col("source") == REFERENCE, F.col("event")))).where("meeting IS NOT NULL")
    return bo.best_prices(q, _KEY)


@_query(f"WITH {_GRID} SELECT * FROM best")
def cross_book_grid_same_name(spark, d):
    return _grid(spark, d).select(*_KEY, "side", "source", "price", "sources")


@_query(f"""WITH {_GRID}, s AS (SELECT sport, meeting, market_type, period, line, submarket, team_side, count(*) AS sides, max((side = 'draw')::INT) AS draw, count(DISTINCT source)::INT AS books, sum(1/price) AS implied FROM best GROUP BY ALL)
SELECT * EXCLUDE (draw, implied), round(implied, 6) AS implied, round((1 - implied)*100, 5) AS margin FROM s WHERE sides = CASE WHEN draw = 1 THEN 3 ELSE 2 END AND books >= 2 AND implied < 1""")
def cross_book_arbs_same_name(spark, d):
    return bo.cross_source_arbs(_grid(spark, d), _KEY).withColumns({"implied": F.round("implied", 6), "margin": F.round("margin", 5)})


@_query("""SELECT market_id, CASE market_type WHEN 'moneyline' THEN 'ML' WHEN 'spread' THEN 'Spread' WHEN 'total' THEN 'Total' WHEN 'team_total' THEN 'Team Total' ELSE upper(market_type) END || ' ' || period
 || coalesce(' ' || CASE WHEN line > 0 THEN '+' WHEN line < 0 THEN '-' ELSE '' END || regexp_replace(printf('%.2f', abs(line)), '\\.?0+$', ''), '') || coalesce(' (' || team_side || ')', '') AS label FROM markets""")
def market_labels(spark, d):
    m = table(spark, d, "markets")
    name = F.when(F.col("market_type") == "moneyline", "ML").when(F.col("market_type") == "spread", "Spread").when(F.col("market_type") == "total", "Total").when(F.col("market_type") == "team_total", "Team Total").otherwise(F.upper("market_type"))
    opt = lambda pre, c, post="": F.when(c.isNotNull(), F.concat(F.lit(pre), c, F.lit(post))).otherwise("")
    return m.select("market_id", F.concat(name, F.lit(" "), "period", opt(" ", fo.line_text(F.col("line"))), opt(" (", F.col("team_side"), ")")).alias("label"))


@_query("""SELECT tick_id, market_id, selection, ts, odds FROM (SELECT *, lag(odds) OVER w AS p, row_number() OVER w AS n FROM ticks WINDOW w AS (PARTITION BY market_id, selection ORDER BY ts, tick_id)) WHERE n = 1 OR odds IS DISTINCT FROM p""")
def change_ticks(spark, d):
    return se.change_ticks(table(spark, d, "ticks")).select("tick_id", "market_id", "selection", "ts", "odds")


@_query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market_id, selection ORDER BY ts DESC, tick_id DESC) AS n FROM ticks) WHERE n = 1 AND odds IS NULL),
p AS (SELECT market_id, selection, odds FROM (SELECT *, row_number() OVER (PARTITION BY market_id, selection ORDER BY ts DESC, tick_id DESC) AS n FROM ticks WHERE odds IS NOT NULL) WHERE n = 1)
SELECT l.market_id, l.selection, l.ts AS gone_at, p.odds AS last_odds FROM l LEFT JOIN p USING (market_id, selection)""")
def vanished_prices(spark, d):
    return se.vanished(table(spark, d, "ticks"))


@_query("SELECT market_id, selection, odds, ts, tick_id FROM (SELECT *, row_number() OVER (PARTITION BY market_id, selection ORDER BY ts DESC, tick_id DESC) AS n FROM ticks) WHERE n = 1")
def latest_ticks(spark, d):
    return se.latest_of(table(spark, d, "ticks"))


@_query("""SELECT market_id, selection, ts, odds, false AS seed FROM ticks WHERE ts >= TIMESTAMP '2026-01-15' UNION ALL
SELECT market_id, selection, TIMESTAMP '2026-01-15', odds, true FROM (SELECT *, row_number() OVER (PARTITION BY market_id, selection ORDER BY ts DESC, tick_id DESC) AS n FROM ticks WHERE ts < TIMESTAMP '2026-01-15') WHERE n = 1""")
def step_series(spark, d):
    return se.step_series(table(spark, d, "ticks"), "2026-01-15 00:00:00")


def _cycles(spark, d):
    """Daily cycles of each source: the lines it listed on a day; a day is healthy unless its number is divisible by 7."""
    o = table(spark, d, "odds").where("raw_event_id IS NOT NULL").select("source", F.col("raw_event_id").alias("event"), "market_type", F.expr("datediff(to_date(fetched_at), DATE'1970-01-01')").alias("cycle")).distinct()
    return o.select("source", "cycle").distinct().withColumn("ok", F.col("cycle") % 7 != 0), o


@_query("""WITH o AS (SELECT DISTINCT source, raw_event_id AS event, market_type, date_diff('day', DATE '1970-01-01', fetched_at::DATE)::INT AS cycle FROM odds WHERE raw_event_id IS NOT NULL),
c AS (SELECT source, cycle, lead(cycle) OVER (PARTITION BY source ORDER BY cycle) AS next FROM (SELECT DISTINCT source, cycle FROM o WHERE cycle % 7 <> 0))
SELECT DISTINCT o.source, o.event, o.market_type, c.next AS cycle FROM o JOIN c USING (source, cycle) WHERE c.next IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM o x WHERE x.source = o.source AND x.event = o.event AND x.market_type = o.market_type AND x.cycle = c.next)""")
def disappearances(spark, d):
    cycles, seen = _cycles(spark, d)
    return se.disappearances(cycles, seen, ["event", "market_type"])


def _points(spark, d):
    """Fair probabilities of two-way moneylines over time, one row an event, period, time and side."""
    o = bo.with_sides(table(spark, d, "odds")).where("market_type = 'moneyline' AND NOT three_way AND h IS NOT NULL AND a IS NOT NULL AND raw_event_id IS NOT NULL")
    pts = o.groupBy("source", "raw_event_id", "period", F.col("fetched_at").alias("ts")).agg(F.min_by(F.struct("h", "a"), "odds_id").alias("x"))
    side = lambda s, p: F.struct(F.lit(s).alias("side"), p.alias("fair"))
    h, a = F.col("x.h"), F.col("x.a")
    return pts.select("source", "raw_event_id", "period", "ts", F.explode(F.array(side("home", fo.shin_two_way(h, a)), side("away", fo.shin_two_way(a, h)))).alias("s")).select("source", "raw_event_id", "period", "ts", "s.*")


_POINTS = f"""o AS (SELECT source, raw_event_id, period, fetched_at AS ts, arg_min(h, odds_id) AS h, arg_min(a, odds_id) AS a FROM ({_SIDES}) WHERE market_type = 'moneyline' AND NOT three_way AND h IS NOT NULL AND a IS NOT NULL AND raw_event_id IS NOT NULL GROUP BY ALL),
pts AS (SELECT source, raw_event_id, period, ts, 'home' AS side, {_shin('h', 'a')} AS fair FROM o UNION ALL SELECT source, raw_event_id, period, ts, 'away', {_shin('a', 'h')} FROM o)"""


@_query(f"""WITH RECURSIVE {_POINTS}, w AS (SELECT source, raw_event_id, period, ts, fair AS h, 1 - fair AS a, row_number() OVER (PARTITION BY source, raw_event_id, period ORDER BY ts) AS n FROM pts WHERE side = 'home'),
g AS (SELECT w.*, x.fair AS aw FROM w JOIN pts x ON x.source = w.source AND x.raw_event_id = w.raw_event_id AND x.period = w.period AND x.ts = w.ts AND x.side = 'away'),
it AS (SELECT source, raw_event_id, period, n, ts, h, aw, h AS ah, aw AS aa, ts AS since, NULL::DOUBLE AS ph, NULL::DOUBLE AS pa, NULL::TIMESTAMP AS t0 FROM g WHERE n = 1
  UNION ALL SELECT g.source, g.raw_event_id, g.period, g.n, g.ts, g.h, g.aw, CASE WHEN g.h - ah >= 0.02 OR g.aw - aa >= 0.02 THEN g.h ELSE ah END, CASE WHEN g.h - ah >= 0.02 OR g.aw - aa >= 0.02 THEN g.aw ELSE aa END,
    CASE WHEN g.h - ah >= 0.02 OR g.aw - aa >= 0.02 THEN g.ts ELSE since END, ah, aa, since FROM it JOIN g ON g.source = it.source AND g.raw_event_id = it.raw_event_id AND g.period = it.period AND g.n = it.n + 1)
SELECT source, raw_event_id, period, ts, 'home' AS side, round(ph, 6) AS was, round(h, 6) AS now, date_diff('microsecond', t0, ts) // 1000000 AS window_sec FROM it WHERE h - ph >= 0.02
UNION ALL SELECT source, raw_event_id, period, ts, 'away', round(pa, 6), round(aw, 6), date_diff('microsecond', t0, ts) // 1000000 FROM it WHERE aw - pa >= 0.02""")
def steam_moves(spark, d):
    return se.steam_moves(_points(spark, d), ["source", "raw_event_id", "period"]).withColumns({"was": F.round("was", 6), "now": F.round("now", 6)})


@_query(f"""WITH {_POINTS}, i AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY source, raw_event_id, period) AS t FROM pts) WHERE ts >= t - INTERVAL 48 HOUR),
s AS (SELECT source, raw_event_id, period, side, round(arg_min(fair, ts), 6) AS first, round(arg_max(fair, ts), 6) AS last, count(*) AS n, arg_max(fair, ts) - arg_min(fair, ts) AS change FROM i GROUP BY ALL HAVING count(*) >= 2)
SELECT source, raw_event_id, period, first, last, n, round(abs(change), 6) AS size FROM (SELECT *, row_number() OVER (PARTITION BY source, raw_event_id, period ORDER BY abs(round(change, 9)) DESC, side) AS k FROM s) WHERE k = 1""")
def cumulative_moves(spark, d):
    return _net_two_way(_points(spark, d))


def _net_two_way(points: DataFrame) -> DataFrame:
    key = ["source", "raw_event_id", "period"]
    m = se.net_moves(points.withColumn("fair", F.round("fair", 9)), key, hours=48.0)
    return m.select(*key, F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), "n", F.round(F.abs("change"), 6).alias("size"))


@_query("""WITH s AS (SELECT source, raw_event_id, market_type, date_diff('day', DATE '1970-01-01', fetched_at::DATE)::INT AS scan FROM odds WHERE raw_event_id IS NOT NULL),
now AS (SELECT DISTINCT source, raw_event_id, market_type FROM s WHERE scan % 2 = 0), old AS (SELECT source, raw_event_id, market_type, min(TIMESTAMP '1970-01-01' + to_days(scan)) AS first_seen FROM s WHERE scan % 2 = 1 GROUP BY ALL)
SELECT now.*, coalesce(old.first_seen, TIMESTAMP '2026-07-01') AS first_seen FROM now LEFT JOIN old USING (source, raw_event_id, market_type)""")
def flags_first_seen(spark, d):
    s = table(spark, d, "odds").where("raw_event_id IS NOT NULL").select("source", "raw_event_id", "market_type", F.expr("datediff(to_date(fetched_at), DATE'1970-01-01')").alias("scan"))
    key = ["source", "raw_event_id", "market_type"]
    old = s.where("scan % 2 = 1").groupBy(*key).agg(F.min(F.expr("CAST(date_add(DATE'1970-01-01', scan) AS TIMESTAMP_NTZ)")).alias("first_seen"))
    return fl.carry_first_seen(s.where("scan % 2 = 0").select(*key).distinct(), old, key, "2026-07-01 00:00:00")


_UN = ["unmatched_id", "book", "sport", "cb_home", "cb_away", "best_pin_start_time", "reject_reason"]


@_query("""WITH u AS (SELECT unmatched_id, book, sport, cb_home, cb_away, best_pin_start_time, reject_reason FROM unmatched_events), fresh AS (SELECT * FROM u WHERE unmatched_id % 2 = 0 AND book <> 'dune'), old AS (SELECT * FROM u WHERE unmatched_id % 2 = 1)
SELECT *, false AS stale FROM fresh UNION ALL SELECT *, true FROM old WHERE book = 'dune' AND NOT coalesce(best_pin_start_time < TIMESTAMP '2026-01-01', false)""")
def stale_carry(spark, d):
    u = table(spark, d, "unmatched_events").select(*_UN)
    failed = table(spark, d, "books").where("book = 'dune'").select("book")
    expired = F.coalesce(F.col("best_pin_start_time") < F.lit("2026-01-01").cast("timestamp_ntz"), F.lit(False))
    return fl.carry_stale(u.where("unmatched_id % 2 = 0 AND book <> 'dune'"), u.where("unmatched_id % 2 = 1"), failed, ["book"], expired)


@_query("""WITH u AS (SELECT unmatched_id, book, sport, cb_home, cb_away, best_pin_start_time, reject_reason FROM unmatched_events), f AS (SELECT * FROM u WHERE unmatched_id % 5 = 0)
SELECT * FROM u WHERE unmatched_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.book = u.book AND f.cb_home = u.cb_home AND f.cb_away = u.cb_away) UNION ALL SELECT * FROM f""")
def watch_merge(spark, d):
    u = table(spark, d, "unmatched_events").select(*_UN)
    return fl.replace_slice(u.where("unmatched_id % 5 <> 0"), u.where("unmatched_id % 5 = 0"), ["book", "cb_home", "cb_away"])


@_query("""SELECT unmatched_id, book, cb_home, cb_away, logged_at, reject_reason FROM (SELECT *, lag(reject_reason) OVER w AS r, lag(best_pin_home) OVER w AS b, lag(logged_at) OVER w AS t, row_number() OVER w AS n FROM unmatched_events
WINDOW w AS (PARTITION BY book, sport, cb_home, cb_away ORDER BY logged_at, unmatched_id)) WHERE n = 1 OR reject_reason IS DISTINCT FROM r OR best_pin_home IS DISTINCT FROM b OR coalesce(logged_at > t + INTERVAL 24 HOUR, false)""")
def unmatched_log(spark, d):
    u = fl.log_on_change(table(spark, d, "unmatched_events"), ["book", "sport", "cb_home", "cb_away"], ["reject_reason", "best_pin_home"], "logged_at", "unmatched_id")
    return u.select("unmatched_id", "book", "cb_home", "cb_away", "logged_at", "reject_reason")


@_query("SELECT reject_reason, count(*) AS n, count(DISTINCT book || '|' || cb_home || '|' || cb_away) AS fixtures, round(avg(best_score), 6) AS mean_score FROM unmatched_events WHERE logged_at >= TIMESTAMP '2025-12-01' GROUP BY ALL")
def unmatched_reasons(spark, d):
    u = table(spark, d, "unmatched_events").where(F.col("logged_at") >= F.lit("2025-12-01").cast("timestamp_ntz"))
    return u.groupBy("reject_reason").agg(F.count("*").alias("n"), F.countDistinct(F.concat_ws("|", "book", "cb_home", "cb_away")).alias("fixtures"), F.round(F.avg("best_score"), 6).alias("mean_score"))


@_query("""WITH p AS (SELECT payload_id, feed, body FROM raw_payloads), old AS (SELECT feed, md5(coalesce(body, '')) AS h FROM p WHERE payload_id % 2 = 1)
SELECT payload_id, feed FROM p WHERE payload_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.feed = p.feed AND old.h = md5(coalesce(p.body, '')))""")
def changed_payloads(spark, d):
    """Payloads of the later half that the earlier half does not hold: an anti-join on the hash of the body."""
    p = table(spark, d, "raw_payloads").withColumn("h", F.sha2(F.coalesce("body", F.lit("")), 256))
    return p.where("payload_id % 2 = 0").join(p.where("payload_id % 2 = 1").select("feed", "h"), ["feed", "h"], "left_anti").select("payload_id", "feed")


@_query("""WITH a AS (SELECT market_id, selection, arg_max(odds, (ts, tick_id)) AS v FROM ticks WHERE tick_id % 3 = 0 AND odds IS NOT NULL GROUP BY ALL), b AS (SELECT market_id, selection, arg_max(odds, (ts, tick_id)) AS v FROM ticks WHERE tick_id % 3 = 1 AND odds IS NOT NULL GROUP BY ALL), c AS (SELECT market_id, selection, arg_max(odds, (ts, tick_id)) AS v FROM ticks WHERE tick_id % 3 = 2 AND odds IS NOT NULL GROUP BY ALL),
k AS (SELECT market_id, selection FROM a UNION SELECT market_id, selection FROM b UNION SELECT market_id, selection FROM c)
SELECT market_id, selection, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'exact' WHEN a.v IS DISTINCT FROM c.v THEN 'drift' ELSE 'structural' END AS verdict FROM k LEFT JOIN a USING (market_id, selection) LEFT JOIN b USING (market_id, selection) LEFT JOIN c USING (market_id, selection)""")
def capture_parity(spark, d):
    t = table(spark, d, "ticks").where("odds IS NOT NULL")
    cap = [se.latest_of(t.where(f"tick_id % 3 = {i}")).select(*se.SERIES, "odds") for i in range(3)]
    return fl.compare_captures(*cap, se.SERIES, "odds")


@_query("SELECT source, sport, market_type, grouping(source, sport, market_type)::BIGINT AS level, count(*) AS rows, count(DISTINCT raw_event_id) AS events FROM odds GROUP BY CUBE (source, sport, market_type)")
def board_cube(spark, d):
    return table(spark, d, "odds").cube("source", "sport", "market_type").agg(F.grouping_id().alias("level"), F.count("*").alias("rows"), F.countDistinct("raw_event_id").alias("events")).select("source", "sport", "market_type", "level", "rows", "events")


@_query("SELECT sport, market_type, period, count(*) AS rows FROM odds GROUP BY ROLLUP (sport, market_type, period)")
def sweep_summary(spark, d):
    return table(spark, d, "odds").rollup("sport", "market_type", "period").agg(F.count("*").alias("rows"))


@_query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS start, market_id, count(*) AS n, round(avg(odds), 6) AS mean FROM ticks, range(4) r(k) WHERE odds > 1 AND isfinite(odds) GROUP BY ALL""")
def sliding_windows(spark, d):
    """Hourly windows every quarter of an hour."""
    t = table(spark, d, "ticks").where("odds > 1 AND NOT isnan(odds) AND odds < double('infinity')")
    return t.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "market_id").agg(F.count("*").alias("n"), F.round(F.avg("odds"), 6).alias("mean")).select(F.col("w.start").alias("start"), "market_id", "n", "mean")


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, market_id, count(*) AS n, round(avg(odds), 6) AS mean, min(odds) AS lo, max(odds) AS hi FROM ticks WHERE odds > 1 AND isfinite(odds) GROUP BY ALL")
def tumbling_windows(spark, d):
    t = table(spark, d, "ticks").where("odds > 1 AND NOT isnan(odds) AND odds < double('infinity')")
    return t.groupBy(F.window("ts", "1 hour").alias("w"), "market_id").agg(F.count("*").alias("n"), F.round(F.avg("odds"), 6).alias("mean"), F.min("odds").alias("lo"), F.max("odds").alias("hi")).select(F.col("w.start").alias("start"), "market_id", "n", "mean", "lo", "hi")


@_query("""WITH g AS (SELECT market_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY market_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY market_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT market_id, min(ts) AS start, max(ts) AS last, count(*)::BIGINT AS n FROM s GROUP BY market_id, k""")
def session_windows_all(spark, d):
    """Sessions of every market, the hot one too."""
    return se.sessions(table(spark, d, "ticks"), 6)


@_query("(SELECT market_id, selection FROM ticks EXCEPT SELECT market_id, selection FROM latest)")
def series_without_latest(spark, d):
    return table(spark, d, "ticks").select("market_id", "selection").subtract(table(spark, d, "latest").select("market_id", "selection"))


@_query("(SELECT home AS name FROM odds INTERSECT SELECT best_pin_home FROM unmatched_events)")
def names_in_both(spark, d):
    return table(spark, d, "odds").select(F.col("home").alias("name")).intersect(table(spark, d, "unmatched_events").select("best_pin_home"))


@_query(f"""WITH board AS ({_BOARD}), j AS (SELECT b.bet_id, q.odds_id, coalesce(abs(b.line - q.line), 0) AS gap, {_v('q.selections[b.side]')} AS now_odds FROM bets b JOIN board q ON q.source = b.book AND q.event = b.cb_event_id AND q.market_type IS NOT DISTINCT FROM b.market_type AND q.period IS NOT DISTINCT FROM b.period
AND q.submarket IS NOT DISTINCT FROM b.submarket AND q.team_side IS NOT DISTINCT FROM b.team_side AND (q.line IS NULL) = (b.line IS NULL) AND coalesce(abs(b.line - q.line), 0) <= 0.01 + 1e-9)
SELECT bet_id, odds_id, now_odds FROM (SELECT *, row_number() OVER (PARTITION BY bet_id ORDER BY gap, odds_id) AS n FROM j) WHERE n = 1""")
def bet_quotes(spark, d):
    """The board's present price of every bet: its own event, specification and nearest line."""
    at = lambda source, event: F.concat_ws("|", source, event)
    b = table(spark, d, "bets").where("book IS NOT NULL AND cb_event_id IS NOT NULL").select(F.col("bet_id").alias("odds_id"), F.lit("bet").alias("source"), at("book", "cb_event_id").alias("event"), *bo.SPEC, "line", "side")
    q = _board(spark, d).withColumn("event", at("source", "event"))
    j = bo.closest_line(b, q, b.select("source", "event", F.col("event").alias("ref_event")).distinct())
    return j.select(F.col("odds_id").alias("bet_id"), F.col("ref_id").alias("odds_id"), fo.valid(F.try_element_at("ref_selections", F.col("side"))).alias("now_odds"))


@_query("SELECT source, sport, max(fetched_at) AS newest, count(*) AS rows, sum((fetched_at >= TIMESTAMP '2026-05-01')::INT)::BIGINT AS late_rows FROM odds GROUP BY ALL")
def latest_cycle(spark, d):
    o = table(spark, d, "odds")
    return o.groupBy("source", "sport").agg(F.max("fetched_at").alias("newest"), F.count("*").alias("rows"), F.sum((F.col("fetched_at") >= F.lit("2026-05-01").cast("timestamp_ntz")).cast("long")).alias("late_rows"))


@_query(f"""WITH {_GRID}, k AS (SELECT *, row_number() OVER (PARTITION BY sport ORDER BY price DESC, meeting, market_type, period, line NULLS FIRST, submarket NULLS FIRST, team_side NULLS FIRST, side) AS place FROM best WHERE sources >= 2)
SELECT sport, place, meeting, market_type, period, line, side, source, price FROM k WHERE place <= 20""")
def longest_prices_same_name(spark, d):
    """The twenty longest prices of every sport that two sources quote: a top-k report."""
    from pyspark.sql import Window

    w = Window.partitionBy("sport").orderBy(F.col("price").desc(), "meeting", "market_type", "period", "line", "submarket", "team_side", "side")
    return _grid(spark, d).where("sources >= 2").withColumn("place", F.row_number().over(w)).where("place <= 20").select("sport", F.col("place").cast("long").alias("place"), "meeting", "market_type", "period", "line", "side", "source", "price")
