"""Feeds of several shapes as canonical rows of odds: codes and names by dimension tables, one row a market line with all its sides."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsloom.functions.odds import valid
from oddsloom.functions.text import simulated
from oddsloom.sources.titles import named_market

EVENT = ["source", "sport", "home", "away", "league", "start_time", "raw_event_id", "sr_match_id"]
#: Codes of game types of feed C to (market, period, ways, team), by sport.
GAME_TYPES = {
    "basketball": {
        -2527: ("moneyline", "FT", 2, None), -2966: ("total", "FT", 2, None), -2950: ("spread", "FT", 2, None), 182: ("team_total", "FT", 2, "home"), 183: ("team_total", "FT", 2, "away"), -2541: ("total", "H1", 2, None),
        -6008: ("spread", "H1", 2, None), 33: ("total", "Q1", 2, None), -421: ("total", "Q2", 2, None), -422: ("total", "Q3", 2, None), -423: ("total", "Q4", 2, None), -430: ("spread", "Q1", 2, None), -2502: ("spread", "Q2", 2, None),
        -5004: ("spread", "Q3", 2, None), -5006: ("spread", "Q4", 2, None),
    },
    "soccer": {1: ("moneyline", "FT", 3, None), 8: ("total", "FT", 2, None), -458: ("spread", "FT", 2, None)},
}
#: Names of outcomes of feed C.
OUTCOME_NAMES = {"1": "home", "2": "away", "X": "draw", "მეტი": "over", "ნაკლები": "under"}
#: Group and type codes of feed D: (sports, group, type, market, side, team, whole game only).
GROUP_TYPES = [
    ("soccer", 1, 1, "moneyline", "home", None, True), ("soccer", 1, 2, "moneyline", "draw", None, True), ("soccer", 1, 3, "moneyline", "away", None, True), ("basketball", 101, 401, "moneyline", "home", None, True),
    ("basketball", 101, 402, "moneyline", "away", None, True), ("tennis", 1, 1, "moneyline", "home", None, True), ("tennis", 1, 3, "moneyline", "away", None, True),
    *[(s, 2, t, "spread", side, None, False) for s in ("basketball", "soccer", "tennis") for t, side in ((7, "home"), (8, "away"))], *[(s, 17, t, "total", side, None, False) for s in ("basketball", "soccer", "tennis") for t, side in ((9, "over"), (10, "under"))],
    ("basketball", 15, 11, "team_total", "over", "home", False), ("basketball", 15, 12, "team_total", "under", "home", False), ("basketball", 62, 13, "team_total", "over", "away", False), ("basketball", 62, 14, "team_total", "under", "away", False),
]
#: Names of feed D's parts of games, and its names of fixtures that are none.
PARTS = {("basketball", "1 Half"): "H1", ("basketball", "1st quarter"): "Q1", ("basketball", "2nd quarter"): "Q2", ("basketball", "3rd quarter"): "Q3", ("basketball", "4th quarter"): "Q4", ("soccer", "1st half"): "H1"}
PLACEHOLDERS = ["home", "away", "team 1", "team 2", "1", "2"]
#: Codes of feed E by sport: market types, periods; outcome types by market.
MARKET_CODES = {"F": {2: ("moneyline", 3), 5: ("total", 2), 4: ("spread", 2), 7: ("team_total", 2)}, "B": {145: ("moneyline", 2), 5: ("total", 2), 4: ("spread", 2), 7: ("team_total", 2)}, "T": {1: ("moneyline", 2), 5: ("total", 2), 4: ("spread", 2)}}
PERIOD_CODES = {"F": {0: "FT", 1: "H1"}, "B": {0: "FT", 4010: "H1", 1: "Q1", 2: "Q2", 3: "Q3", 4: "Q4"}, "T": {0: "FT"}}
OUTCOME_CODES = {"moneyline": {0: "home", 1: "draw", 3: "away"}, "total": {4: "over", 5: "under"}, "team_total": {37: "over", 38: "under"}, "spread": {86: "home", 87: "away"}}


def _dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))  # a fixed list


def assemble(long: DataFrame, keep: list[str] = EVENT) -> DataFrame:
    """Canonical rows of long ones (keep, market_type, period, line, team_side, n_way, side, price): a market line with all sides it needs at a
    valid price, else none of it; lined markets need a line. Of repeated sides the one with the larger price; null keys equal null."""
    key = [*keep, "market_type", "period", "line", "team_side", "n_way"]
    sides = long.withColumn("price", valid(F.col("price"))).where("price IS NOT NULL AND side IS NOT NULL").groupBy(*key, "side").agg(F.max("price").alias("price"))
    rows = sides.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", "price")))).alias("selections"))
    over = F.map_contains_key("selections", F.lit("over")) & F.map_contains_key("selections", F.lit("under"))
    both = F.map_contains_key("selections", F.lit("home")) & F.map_contains_key("selections", F.lit("away"))
    whole = F.when(F.col("market_type").isin("total", "team_total"), over).otherwise(both & ((F.col("n_way") == 2) | F.map_contains_key("selections", F.lit("draw"))))
    wanted = F.when(F.col("market_type").isin("total", "team_total"), F.array(F.lit("over"), F.lit("under"))).otherwise(F.when(F.col("n_way") == 3, F.array(F.lit("home"), F.lit("draw"), F.lit("away"))).otherwise(F.array(F.lit("home"), F.lit("away"))))
    rows = rows.where(whole & ((F.col("market_type") == "moneyline") | F.col("line").isNotNull())).withColumn("_w", wanted)
    return rows.withColumn("selections", F.map_filter("selections", lambda k, _: F.array_contains("_w", k))).drop("_w", "n_way")


def feed_a(matches: DataFrame, ancestors: DataFrame, market_types: DataFrame, *, source: str, sport: str) -> DataFrame:
    """Markets keyed by id, names and outcome labels in dimensions.

    matches: m, the JSON of a match. ancestors: id, name, parent (of sides, tournaments and categories). market_types: id, name, labels (map of
    outcome type to label). A match without both names is left out, and one whose tournament or a category above it (two levels) is simulated."""
    outcome = "struct<value:string,specifier:map<string,string>>"
    shape = f"struct<id:string,homeId:string,awayId:string,tourId:string,startTime:string,meta:struct<matchProvider:struct<matchId:string>>,markets:map<string,struct<typeId:string,specifier:map<string,string>,outcomes:map<string,{outcome}>>>>"
    m = matches.select(F.from_json("m", shape).alias("m")).select("m.*")
    a = ancestors.select("id", "name", "parent")
    up = a.join(a.select(F.col("id").alias("parent"), F.col("name").alias("above")), "parent", "left")
    name = lambda c, n: a.select(F.col("id").alias(c), F.trim("name").alias(n))
    m = m.join(name("homeId", "home"), "homeId").join(name("awayId", "away"), "awayId").join(up.select(F.col("id").alias("tourId"), F.col("name").alias("league"), "above"), "tourId", "left")
    m = m.where((F.length("home") > 0) & (F.length("away") > 0) & ~simulated(F.col("league")) & ~simulated(F.col("above")))
    sr = F.regexp_extract("meta.matchProvider.matchId", r"^sr:match:(.+)$", 1)
    k = m.select(F.lit(source).alias("source"), F.lit(sport).alias("sport"), "home", "away", "league", F.col("startTime").try_cast("timestamp_ntz").alias("start_time"), F.col("id").alias("raw_event_id"), F.nullif(sr, F.lit("")).alias("sr_match_id"), F.explode(F.map_values("markets")).alias("k"))
    t = market_types.select(F.col("id").alias("type"), named_market(F.col("name")).alias("c"), "labels").where("c IS NOT NULL")
    k = k.join(t, F.col("k.typeId") == F.col("type"))
    line = lambda c: F.coalesce(*[F.try_element_at(c, F.lit(n)).try_cast("double") for n in ("total", "handicap", "hcp", "special")])
    o = k.select(*EVENT, "c.*", "labels", line(F.col("k.specifier")).alias("own"), F.explode("k.outcomes").alias("ot", "o")).withColumn("label", F.trim(F.try_element_at("labels", F.col("ot"))))
    side = F.try_element_at(F.create_map(*[F.lit(x) for x in ("1", "home", "X", "draw", "2", "away", "Over", "over", "Under", "under")]), F.col("label"))
    # the home side's own line goes before that of the market; it is the market's for all sides
    home = F.max(F.when(F.col("label") == "1", line(F.col("o.specifier")))).over(Window.partitionBy("raw_event_id", "market_type", "n_way", "own"))
    o = o.withColumns({"side": side, "line": F.when(F.col("market_type") == "moneyline", None).when(F.col("market_type") == "spread", F.coalesce(home, F.col("own"))).otherwise(F.col("own")), "price": F.col("o.value").try_cast("double")})
    return assemble(o.withColumns({"period": F.lit("FT"), "team_side": F.lit(None).cast("string")}))


def feed_c(games: DataFrame, *, source: str) -> DataFrame:
    """games: EVENT without source, game_id, game_type, argument, outcome (name), price: rows of outcomes. Codes that are not in the table are left out."""
    codes = _dimension(games.sparkSession, [(s, c, *v) for s, t in GAME_TYPES.items() for c, v in t.items()], "sport string, game_type int, market_type string, period string, n_way int, team_side string")
    names = F.create_map(*[F.lit(x) for x in chain(*OUTCOME_NAMES.items())])
    rows = games.join(codes, ["sport", "game_type"]).withColumns({"source": F.lit(source), "side": F.try_element_at(names, F.col("outcome")), "line": F.when(F.col("market_type") != "moneyline", F.col("argument"))})
    return assemble(rows, [*EVENT, "game_id"]).drop("game_id")


def feed_d(entries: DataFrame, *, source: str) -> DataFrame:
    """entries: EVENT without source, part (name of the part of the game, null for the whole), tag (of a part; tagged ones are statistics and left out), g, t, p, c
    (group, type, line, price). Fixtures whose names stand for none are left out.

    Handicaps of the away side are written with the sign of their own side or with that of home; which of the two pairs more lines of
    an event and part holds (ties: its own)."""
    spark = entries.sparkSession
    codes = _dimension(spark, GROUP_TYPES, "sport string, g int, t int, market_type string, side string, team_side string, whole boolean")
    parts = F.create_map(*[F.lit(x) for (s, n), p in PARTS.items() for x in (f"{s}|{n}", p)])
    named = lambda c: (F.length(F.trim(c)) > 0) & ~F.lower(F.trim(c)).isin(*PLACEHOLDERS)
    e = entries.where(named(F.col("home")) & named(F.col("away")) & F.col("tag").isNull())
    e = e.withColumns({"source": F.lit(source), "period": F.when(F.col("part").isNull(), "FT").otherwise(F.try_element_at(parts, F.concat_ws("|", "sport", "part")))}).where("period IS NOT NULL")
    e = e.join(codes, ["sport", "g", "t"]).where("(NOT whole OR period = 'FT') AND (market_type = 'moneyline') = (p IS NULL)")
    e = e.withColumns({"price": valid(F.col("c")), "n_way": F.when((F.col("market_type") == "moneyline") & (F.col("sport") == "soccer"), 3).otherwise(2)}).where("price IS NOT NULL")
    w = Window.partitionBy("source", "sport", "raw_event_id", "period", "market_type")
    lines = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("p"))).over(w)
    spread = F.col("market_type") == "spread"
    e = e.withColumns({"_h": lines("home"), "_a": lines("away")})
    own = F.size(F.array_intersect("_h", F.transform("_a", lambda x: -x + F.lit(0.0)))) >= F.size(F.array_intersect("_h", "_a"))
    line = F.when(spread & (F.col("side") == "away") & own, -F.col("p") + F.lit(0.0)).otherwise(F.col("p"))
    return assemble(e.withColumn("line", line).drop("_h", "_a"))


def feed_e(markets: DataFrame, events: DataFrame, *, source: str) -> DataFrame:
    """markets: sport_code, event_id, result_kind, sub_period, market_code, period_code, items (array of parameters, removed, outcomes of code, odd, removed, frozen).
    events: event_id, sport, stage, status, names (array), league, start_time. Only results of kind 1 over whole periods, events before
    their start (stage 1) that are open (status 1), no simulated leagues; odds are whole hundredths."""
    spark = markets.sparkSession
    types = _dimension(spark, [(s, c, *v) for s, t in MARKET_CODES.items() for c, v in t.items()], "sport_code string, market_code int, market_type string, n_way int")
    periods = _dimension(spark, [(s, c, v) for s, t in PERIOD_CODES.items() for c, v in t.items()], "sport_code string, period_code int, period string")
    sides = _dimension(spark, [(m, c, v) for m, t in OUTCOME_CODES.items() for c, v in t.items()], "market_type string, code int, side string")
    virtual = F.lower("league").rlike("virtual|esportsbattle|e-basketball") | simulated(F.col("league"))
    ev = events.where("stage = 1 AND status = 1 AND size(names) >= 2").where(~F.coalesce(virtual, F.lit(False)))
    ev = ev.select("event_id", "sport", F.trim(F.col("names")[0]).alias("home"), F.trim(F.col("names")[1]).alias("away"), "league", "start_time").where((F.length("home") > 0) & (F.length("away") > 0))
    m = markets.where("result_kind = 1 AND coalesce(sub_period, 0) = 0").join(types, ["sport_code", "market_code"]).join(periods, ["sport_code", "period_code"]).join(ev, "event_id")
    i = m.withColumn("i", F.explode("items")).where("NOT coalesce(i.removed, false)")
    team = F.when(F.col("market_type") == "team_total", F.when(F.col("i.parameters")[0] == 1, "home").when(F.col("i.parameters")[0] == 2, "away"))
    line = F.when(F.col("market_type") == "team_total", F.get("i.parameters", F.lit(1))).when(F.col("market_type") != "moneyline", F.get("i.parameters", F.lit(0)))
    o = i.withColumns({"team_side": team, "line": line}).where("market_type <> 'team_total' OR team_side IS NOT NULL").withColumn("o", F.explode("i.outcomes")).where("NOT coalesce(o.removed, false) AND NOT coalesce(o.frozen, false)").withColumn("code", F.col("o.code"))
    o = o.join(sides, ["market_type", "code"]).withColumns({"price": F.col("o.odd") / 100.0, "source": F.lit(source), "raw_event_id": F.col("event_id"), "sr_match_id": F.lit(None).cast("string")})
    return assemble(o)


def split_fixture(name: Column) -> tuple[Column, Column]:
    """Home and away of 'home - away'; null if the text has no such form."""
    parts = F.split(name, r"\s+-\s+", 2)
    return F.when(F.size(parts) == 2, F.trim(parts[0])), F.when(F.size(parts) == 2, F.trim(parts[1]))


def list_view(rows: DataFrame, *, page: str, position: str, text: str, day: str, clock: str, league: str, hours: int = 4) -> DataFrame:
    """Rows of a list page in order, of which some only give the day of those below: page, position, home, away, league, start_time. The day is carried
    forward; local clock times are `hours` ahead of UTC. Rows that name no two sides, outrights and simulated leagues are left out."""
    w = Window.partitionBy(page).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_day", F.last(day, ignorenulls=True).over(w)).where(F.col(text).isNotNull())
    home, away = split_fixture(F.col(text))
    start = F.try_to_timestamp(F.concat_ws(" ", F.col("_day"), F.col(clock)), F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    r = r.select(page, position, home.alias("home"), away.alias("away"), F.trim(league).alias("league"), start.alias("start_time"))
    return r.where("home <> '' AND away <> ''").where(~simulated(F.col("league")) & ~F.coalesce(F.lower("league").contains("outright"), F.lit(False)))


def within(start: Column, now: Column, hours: float | None = None, grace_seconds: int = 120) -> Column:
    """Whether an event has not begun (but for the grace) and begins within the horizon; an unknown start is inside."""
    ahead = start >= now - F.expr(f"INTERVAL {grace_seconds} SECONDS")
    return F.coalesce(ahead if hours is None else ahead & (start <= now + F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")), F.lit(True))


def kickoff_bucket(start: Column, seconds: int = 900) -> Column:
    return F.floor(F.unix_seconds(start.cast("timestamp")) / seconds)
