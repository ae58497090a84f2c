"""Raw JSON feeds as relations: nested markets to canonical rows with native functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.odds import american_to_decimal, valid

#: Codes of the reference feed's periods.
PERIODS = {0: "FT", 1: "H1", 2: "H2", 3: "Q1", 4: "Q2", 5: "Q3", 6: "Q4"}
MATCHUP = "struct<id:long,type:string,parentId:long,units:string,startTime:string,league:string,special:boolean,isLive:boolean,participants:array<struct<alignment:string,name:string>>>"
MARKET = "struct<matchupId:long,type:string,period:int,side:string,prices:array<struct<designation:string,points:double,price:long>>,limits:array<struct<type:string,amount:double>>>"


def lenient_json(text: Column) -> Column:
    """Control characters out, commas before a closing bracket out."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]+", " "), r",\s*([\]}])", "$1")


def matchups(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(parents, children): fixtures with both names, neither special nor running; and child id -> parent id with its submarket."""
    m = raw.select(F.explode(F.from_json(lenient_json(F.col(body)), f"array<{MATCHUP}>")).alias("m")).select("m.*")
    name = lambda side: F.get(F.filter("participants", lambda p: p["alignment"] == side), F.lit(0))["name"]
    named = m.withColumns({"home": name("home"), "away": name("away")})
    parents = named.where("parentId IS NULL AND type = 'matchup' AND NOT coalesce(special, false) AND NOT coalesce(isLive, false) AND home IS NOT NULL AND away IS NOT NULL")
    children = m.where("parentId IS NOT NULL").select("id", "parentId", F.when(F.lower("units") == "corners", "corners").when(F.lower("units").isin("bookings", "cards"), "bookings").alias("submarket"), F.lower("units").alias("units"))
    return parents.select("id", "home", "away", "league", F.to_timestamp("startTime").alias("start_time"), F.lower("units").alias("units")), children


def reference_odds(raw_matchups: DataFrame, raw_markets: DataFrame, sport: str, body: str = "body") -> DataFrame:
    """Canonical rows of the reference feed: American to decimal, the line of the home side, children joined to their parents.

    A market in which any side has no valid price gives no row; neither has one without a known parent or period."""
    parents, children = matchups(raw_matchups, body)
    k = raw_markets.select(F.explode(F.from_json(lenient_json(F.col(body)), f"array<{MARKET}>")).alias("k")).select("k.*")
    period = F.try_element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), F.col("period"))
    price = lambda p: american_to_decimal(p["price"])
    k = k.where(F.col("type").isin("moneyline", "spread", "total", "team_total") & (F.size("prices") >= 2) & F.forall("prices", lambda p: F.coalesce(price(p) > 1, F.lit(False)) & p["designation"].isNotNull()))
    k = k.withColumns({"period": period, "selections": F.map_from_entries(F.transform("prices", lambda p: F.struct(p["designation"], price(p)))), "line": F.when(F.col("type") == "moneyline", F.lit(None).cast("double")).otherwise(F.coalesce(F.get(F.filter("prices", lambda p: p["designation"] == "home"), F.lit(0))["points"], F.col("prices")[0]["points"]))})
    k = k.withColumn("max_stake", F.array_max(F.transform(F.filter("limits", lambda x: x["type"] == "maxRiskStake"), lambda x: x["amount"])))
    j = k.where("period IS NOT NULL").join(children.withColumnRenamed("id", "matchupId").withColumnRenamed("units", "child_units"), "matchupId", "left").withColumn("id", F.coalesce("parentId", "matchupId")).join(parents, "id")
    j = j.where("NOT (coalesce(units, '') = 'sets' AND type IN ('spread', 'total') AND coalesce(child_units, '') <> 'games')")
    return j.select(F.lit(sport).alias("sport"), "home", "away", F.col("type").alias("market_type"), "period", "selections", "line", "start_time", "league", F.col("id").cast("string").alias("raw_event_id"), "submarket", F.col("side").alias("team_side"), "max_stake")


def list_view(rows: DataFrame, ident: str, body: str) -> DataFrame:
    """Rows of a list view's JSON, [{name, bet, handicap}]: a moneyline from the sides named 1, X, 2 and a spread or total around each
    landmark, the element that carries the line: (ident, market_type, line, selections). Both sides must be priced."""
    item = "array<struct<name:string,bet:string,handicap:string>>"
    x = rows.select(ident, F.from_json(lenient_json(F.col(body)), item).alias("l"))
    price = lambda e: valid(e["bet"].try_cast("double"))
    by_name = lambda n: price(F.get(F.filter("l", lambda e: F.trim(e["name"]) == n), F.lit(0)))
    ml = x.select(ident, F.lit("moneyline").alias("market_type"), F.lit(None).cast("double").alias("line"), F.map_filter(F.create_map(F.lit("home"), by_name("1"), F.lit("draw"), by_name("X"), F.lit("away"), by_name("2")), lambda _, v: v.isNotNull()).alias("selections"))
    e = x.select(ident, "l", F.posexplode("l").alias("_at", "_item")).where(F.col("_item.handicap").isin("handicap", "total"))
    side = lambda k: price(F.get(F.col("l"), F.col("_at") + k))
    total = F.col("_item.handicap") == "total"
    names = lambda a, b: F.create_map(F.lit(a), side(-1), F.lit(b), side(1))
    lined = e.where(side(-1).isNotNull() & side(1).isNotNull()).select(ident, F.when(total, "total").otherwise("spread").alias("market_type"), F.col("_item.bet").try_cast("double").alias("line"), F.when(total, names("under", "over")).otherwise(names("home", "away")).alias("selections"))
    return ml.where("map_contains_key(selections, 'home') AND map_contains_key(selections, 'away')").unionByName(lined.where("line IS NOT NULL"))


def classify(title: Column, rules: list[tuple[str, str, str]], skip: list[str] = ()) -> Column:
    """struct(market_type, period) of the first rule (pattern, market_type, period) whose pattern the title matches, null if it is to be
    skipped or none matches."""
    made = lambda m, p: F.struct(F.lit(m).alias("market_type"), F.lit(p).alias("period"))
    low = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    out = None
    for pattern, market, period in rules:
        out = F.when(low.rlike(pattern), made(market, period)) if out is None else out.when(low.rlike(pattern), made(market, period))
    dropped = F.lit(False)
    for s in skip:
        dropped = dropped | low.rlike(s)
    return F.when(~dropped, out)


def leaves(tree: DataFrame, ident: str, parent: str) -> DataFrame:
    """Nodes that are no other node's parent."""
    return tree.join(tree.select(F.col(parent).alias(ident)).where(f"{ident} IS NOT NULL").distinct(), ident, "left_anti")


def reprice(old: DataFrame, fresh: DataFrame, on: list[str], price: str = "price") -> DataFrame:
    """Old outcomes with the fresh price where there is one."""
    return old.join(fresh.select(*on, F.col(price).alias("_p")), on, "left").withColumn(price, F.coalesce("_p", price)).drop("_p")
