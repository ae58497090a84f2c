"""Queries on models, names, feeds and matching that SQL does not state, and those on texts that it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.functions import text as tx
from oddsloom.operators import consistency as co
from oddsloom.operators import fixtures as fx
from oddsloom.operators import identities as idn
from oddsloom.operators import models as mo
from oddsloom.operators.board import with_sides
from oddsloom.operators.shredding import flat
from oddsloom.queries_board import _board
from oddsloom.queries_core import payload_tables
from oddsloom.plans.materialize import table as stored
from oddsloom.sources import feeds as fd
from oddsloom.sources import sinks
from oddsloom.sources import titles as ti
from oddsloom.sources.tables import table
from oddsloom.streaming import quotes as sq

_Q: dict = {}
_SQL: dict[str, str] = {}
EVENT = ["source", "event"]


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


def _anchors(spark, d):
    """Whole-game three-way prices of soccer with the total whose sides are priced most alike."""
    s = with_sides(_board(spark, d)).where("sport = 'soccer' AND period = 'FT' AND submarket IS NULL AND team_side IS NULL")
    ml = s.where("market_type = 'moneyline' AND three_way").groupBy(*EVENT).agg(F.min_by(F.struct("h", "d", "a"), "odds_id").alias("x")).select(*EVENT, "x.*")
    total = s.where("market_type = 'total' AND o IS NOT NULL AND u IS NOT NULL").groupBy(*EVENT).agg(F.min_by(F.struct("line", "o", "u"), F.struct(F.abs(1 / F.col("o") - 1 / F.col("u")), "odds_id")).alias("x")).select(*EVENT, "x.*")
    return ml.join(total, EVENT, "left")


@_query()
def goal_rates(spark, d):
    return mo.rates(_anchors(spark, d), EVENT)


@_query()
def price_sheet(spark, d):
    return mo.sheets(mo.rates(_anchors(spark, d), EVENT), EVENT)


@_query()
def model_ev(spark, d):
    posted = idn.posted_sheet(_board(spark, d)).withColumnRenamed("key", "market")
    return mo.posted_values(posted, goal_rates(spark, d), EVENT)


@_query()
def half_full_fair(spark, d):
    """Basketball: fair half/full chances from the centre of the spread ladder."""
    view = co.period_view(_board(spark, d)).where("sport = 'basketball'")
    full = view.where("period = 'FT'").select("source", "event", (-F.col("spread_center")).alias("mu"))
    half = view.where("period = 'H1'").select("source", "event", (-F.col("spread_center")).alias("mu1"))
    league = table(spark, d, "odds").select("source", F.coalesce("raw_event_id", F.concat_ws("|", "home", "away")).alias("event"), "league").groupBy("source", "event").agg(F.min("league").alias("league"))
    return mo.half_full_sheet(full.join(half, EVENT, "left").join(league, EVENT, "left"), EVENT)


def _ladders(spark, d):
    s = with_sides(_board(spark, d)).where("sport = 'soccer' AND period = 'FT' AND submarket IS NULL AND team_side IS NULL AND line IS NOT NULL")
    ah = s.where("market_type = 'spread'").select(*EVENT, F.lit("ah").alias("kind"), "line", F.col("h").alias("x"), F.col("a").alias("y"))
    return ah.unionByName(s.where("market_type = 'total'").select(*EVENT, F.lit("total").alias("kind"), "line", F.col("o").alias("x"), F.col("u").alias("y"))).where("x IS NOT NULL AND y IS NOT NULL")


@_query()
def ladder_curves(spark, d):
    return mo.ladder_curves(_ladders(spark, d), EVENT)


@_query()
def cross_fit(spark, d):
    return mo.cross_fit(_ladders(spark, d), goal_rates(spark, d), EVENT)


def _fixtures(spark, d, cond):
    e = table(spark, d, "book_events").where(cond)
    return e.select(F.col("event_id").alias("id"), "book", "sport", "home", "away", "league", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', start_time)").alias("start"))


def _event_match(spark, d):
    return fx.match_fixtures(_fixtures(spark, d, "book <> 'apex'"), _fixtures(spark, d, "book = 'apex'"), ("book",))


@_query()
def event_match(spark, d):
    """Fixtures of every soft book matched with the reference's, one-to-one for each book."""
    return _event_match(spark, d)[0]


@_query()
def event_match_rejects(spark, d):
    return _event_match(spark, d)[1]


@_query("""SELECT event_id, regexp_matches(home, '\\b[uU][- ]?(1[6-9]|2[0-3])\\b') AS youth, regexp_matches(coalesce(league, ''), '(?i)(\\b(women|womens|woman|ladies|female|feminine|feminin|femminile|frauen|damen|dames|femenino|femenina|mujeres|senhoras)\\b|\\(w\\))') AS women,
regexp_matches(home, '(?i)\\s(w|wom)\\.?\\s*$') AND regexp_matches(away, '(?i)\\s(w|wom)\\.?\\s*$') AS women_pair FROM book_events""")
def name_guards(spark, d):
    e = table(spark, d, "book_events")
    return e.select("event_id", tx.youth(F.col("home")).alias("youth"), tx.women(F.col("league")).alias("women"), tx.women_suffix_pair(F.col("home"), F.col("away")).alias("women_pair"))


@_query("SELECT unmatched_id, " + " OR ".join(f"contains(lower(coalesce(cb_league, '')), '{w}')" for w in tx.SIMULATED) + " AS simulated FROM unmatched_events")
def simulated_leagues(spark, d):
    return table(spark, d, "unmatched_events").select("unmatched_id", tx.simulated(F.col("cb_league")).alias("simulated"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in [*tx.LETTERS.items(), *((k.upper(), v) for k, v in tx.LETTERS.items() if k.upper() != k)]) + "}"


@_query(f"""WITH n AS (SELECT DISTINCT name FROM (SELECT home AS name FROM odds WHERE sport <> 'tennis' UNION ALL SELECT away FROM odds WHERE sport <> 'tennis') WHERE name IS NOT NULL),
r AS (SELECT name, array_to_string(list_transform(regexp_extract_all(name, '(?s).'), lambda c: coalesce({_MAP}[c], c)), '') AS t FROM n),
w AS (SELECT name, list_filter(string_split_regex(trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda t: t <> '' AND NOT list_contains(['fc', 'bc', 'bk', 'sk', 'sc', 'ac', 'kk', 'nk', 'club', 'clubs', 'basketball', 'basket', 'basquet', 'baloncesto', 'pallacanestro', 'csk'], t)) AS l FROM r)
SELECT name, array_to_string(l, ' ') AS norm FROM w""")
def normalized_names(spark, d):
    """Every spelling of a team, whatever its script."""
    n = table(spark, d, "odds").where("sport <> 'tennis'").select(F.explode(F.array("home", "away")).alias("name")).where("name IS NOT NULL").distinct()
    return n.withColumn("norm", tx.normal_team("name"))


@_query(f"""WITH n AS (SELECT DISTINCT name FROM (SELECT home AS name FROM odds WHERE sport = 'tennis' UNION ALL SELECT away FROM odds WHERE sport = 'tennis') WHERE name IS NOT NULL),
p AS (SELECT name, unnest(string_split(name, '/')) AS part FROM n), r AS (SELECT name, array_to_string(list_transform(regexp_extract_all(part, '(?s).'), lambda c: coalesce({_MAP}[c], c)), '') AS t FROM p),
w AS (SELECT name, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda t: t <> '' AND NOT list_contains(['fc', 'bc', 'bk', 'sk', 'sc', 'ac', 'kk', 'nk', 'club', 'clubs', 'basketball', 'basket', 'basquet', 'baloncesto', 'pallacanestro', 'csk'], t)), ' ') AS l FROM r)
SELECT name, string_agg(regexp_replace(regexp_replace(l, '( [a-z0-9])+$', ''), '^([a-z0-9] )+', ''), '/' ORDER BY regexp_replace(regexp_replace(l, '( [a-z0-9])+$', ''), '^([a-z0-9] )+', '')) AS norm FROM w GROUP BY ALL""")
def normalized_players(spark, d):
    n = table(spark, d, "odds").where("sport = 'tennis'").select(F.explode(F.array("home", "away")).alias("name")).where("name IS NOT NULL").distinct()
    return n.withColumn("norm", tx.normal_player_name("name"))


_TITLES = {
    ("moneyline", "FT"): "Winner (incl. overtime)", ("total", "FT"): "Total  Points (including overtime)", ("spread", "FT"): "Asian Handicap (incl. overtime)", ("moneyline", "H1"): "1st half - Draw no bet", ("total", "H1"): "1st Half - Total*", ("spread", "H1"): "1st. half - Handicap",
    ("moneyline", "H2"): "2nd half - draw no bet (OT)", ("total", "H2"): "2nd half - Total", ("spread", "H2"): "2nd half - handicap (incl. overtime)", ("moneyline", "Q1"): "1st quarter - draw no bet", ("total", "Q1"): "1st quarter - total points", ("spread", "Q1"): "1st quarter - handicap",
}


@_query("SELECT market_id, CASE WHEN market_type IN ('moneyline', 'total', 'spread') AND period IN ('FT', 'H1', 'H2', 'Q1') THEN market_type || ' ' || period || CASE WHEN market_type = 'total' AND period = 'H2' THEN ' 1' ELSE ' 0' END END AS class FROM markets")
def title_classes(spark, d):
    """Markets by the titles under which a two-way sport lists them, read back into market, period and rank."""
    t = F.create_map(*[F.lit(x) for (m, p), title in _TITLES.items() for x in (f"{m} {p}", title)])
    m = table(spark, d, "markets").select("market_id", F.try_element_at(t, F.concat_ws(" ", "market_type", "period")).alias("title"))
    c = ti.strict_class(F.col("title"), F.lit("basketball"))
    return m.select("market_id", F.when(c.isNotNull(), F.concat_ws(" ", c["market_type"], c["period"], c["rank"].cast("string"))).alias("class"))


@_query()
def board_feed_rows(spark, d):
    """Canonical rows of the board feed: its flat tables and the code tables."""
    rows = stored(payload_tables(spark, d))
    games = flat(rows, "basketball_board", "$.data.eventGames", ["gameId", "gameType", "argument"])
    outs = flat(rows, "basketball_board", "$.data.eventGames.outcomes", ["outcomeName", "outcomeOdds"])
    events = flat(rows, "basketball_board", "$.data", ["eventId", "eventName", "category3Name", "category2Name", "remoteId"])
    home, away = fd.split_fixture(F.col("eventName"))
    ev = events.select("payload_id", F.col("row_id").alias("event_row"), tx.romanised_text(home).alias("home"), tx.romanised_text(away).alias("away"), F.coalesce("category3Name", "category2Name").alias("league"), F.col("eventId").alias("raw_event_id"), F.col("remoteId").alias("sr_match_id"))
    g = games.select("payload_id", F.col("row_id").alias("game_row"), F.col("parent_id").alias("event_row"), F.col("gameType").try_cast("int").alias("game_type"), F.col("argument").try_cast("double").alias("argument"))
    o = outs.select("payload_id", F.col("parent_id").alias("game_row"), F.col("outcomeName").alias("outcome"), F.col("outcomeOdds").try_cast("double").alias("price"))
    j = ev.join(g, ["payload_id", "event_row"]).join(o, ["payload_id", "game_row"]).withColumns({"sport": F.lit("basketball"), "start_time": F.lit(None).cast("timestamp_ntz"), "game_id": F.concat_ws("|", F.col("payload_id").cast("string"), "game_row")})
    return fd.feed_c(j, source="board")


@_query("""SELECT tick_id, market_id, selection, odds FROM (SELECT *, lag(odds) OVER w AS p, row_number() OVER w AS n FROM ticks WINDOW w AS (PARTITION BY market_id, selection ORDER BY ts, tick_id)) WHERE n = 1 OR odds IS DISTINCT FROM p""")
def stream_change_ticks(spark, d):
    """The change-only history by a stream with keyed state, over several micro-batches."""
    ticks = sq.replay(table(spark, d, "ticks"), "ts")
    out = sq.start(sq.change_only(ticks, ["market_id", "selection"], at="ts", value="odds", ident="tick_id"))
    return out.select("tick_id", "market_id", "selection", "odds")


@_query("""WITH g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, market_id, count(*) AS n, round(avg(odds), 6) AS mean, min(odds) AS lo, max(odds) AS hi FROM ticks WHERE odds > 1 AND isfinite(odds) GROUP BY ALL)
SELECT start, market_id, n, mean, lo, hi FROM g WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks WHERE odds > 1 AND isfinite(odds)) - INTERVAL 2 HOUR""")
def stream_tumbling_windows(spark, d):
    """Hourly windows by a stream over several micro-batches; those that the watermark has passed."""
    ticks = sq.replay(table(spark, d, "ticks"), "ts").where("odds > 1 AND NOT isnan(odds) AND odds < double('infinity')")
    out = sq.start(sq.tumbling(ticks, ["market_id"], at="ts", value="odds", width="1 hour", late="2 hours"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@_query()
def payload_outcomes(spark, d):
    """Outcomes of the board feed with their game: one flat table out of the payloads."""
    rows = payload_tables(spark, d)
    o = flat(rows, "basketball_board", "$.data.eventGames.outcomes", ["outcomeId", "outcomeName", "outcomeOdds"])
    return o.select("payload_id", F.col("parent_key").alias("game_id"), F.col("outcomeId").alias("outcome_id"), F.col("outcomeName").alias("name"), F.col("outcomeOdds").try_cast("double").alias("price"))


@_query()
def payload_prices(spark, d):
    """Prices of the grouped feed with their event and group."""
    p = flat(payload_tables(spark, d), "gamezip_bball_matched", "$.Value.GE.E.[]", ["T", "P", "C"])
    return p.select("payload_id", F.col("parent_key").alias("event_group"), F.col("T").try_cast("int").alias("kind"), F.col("P").try_cast("double").alias("line"), F.col("C").try_cast("double").alias("price"))


@_query("""SELECT source AS book, sport, coalesce(raw_event_id, concat_ws('|', home, away)) AS source_event_id, concat_ws('_', submarket, market_type) AS market_type, period, line, team_side, e.key AS selection, e.value AS odds FROM (SELECT *, unnest(map_entries(selections)) AS e FROM odds)""")
def tick_rows(spark, d):
    return sinks.tick_rows(table(spark, d, "odds")).select("book", "sport", "source_event_id", "market_type", "period", "line", "team_side", "selection", "odds")
