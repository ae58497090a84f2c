"""The board of quotes: lines, ladders, edges against the reference source, best prices across sources.

A board is the canonical odds row of one source. Operators take and return DataFrames; nothing here looks at single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.odds import edge_pct, kelly_stake, shin_three_way, shin_two_way, valid

#: Side that is opposite to a side in a two-way market.
OPPOSITE = {"home": "away", "away": "home", "over": "under", "under": "over"}
#: The sides whose price must not rise from one rung to the next higher one.
FALLING = ("home", "under")
LINE_TOLERANCE = 0.01
SPEC = ["market_type", "period", "submarket", "team_side"]
BOARD_KEY = ["source", "sport", "event", *SPEC, "line"]


def with_sides(odds: DataFrame) -> DataFrame:
    """Adds h, d, a, o, u: the valid prices of the sides, and three_way: whether a draw is priced."""
    side = lambda k: valid(F.try_element_at("selections", F.lit(k)))
    return odds.withColumns({"h": side("home"), "d": side("draw"), "a": side("away"), "o": side("over"), "u": side("under"), "three_way": F.coalesce(F.map_contains_key("selections", F.lit("draw")), F.lit(False))})


def long_quotes(odds: DataFrame, *keep: str) -> DataFrame:
    """One row a side with a valid price: side, price and the columns to keep."""
    return odds.select(*keep, F.explode(F.map_entries("selections")).alias("e")).select(*keep, F.col("e.key").alias("side"), valid(F.col("e.value")).alias("price")).where("price IS NOT NULL")


def _event() -> Column:
    return F.coalesce("raw_event_id", F.concat_ws("|", "home", "away"))


def newest_board(odds: DataFrame) -> DataFrame:
    """Of every source, event, market line the row fetched last (ties: the larger id). Rows without event id are their own event."""
    odds = odds.withColumn("event", _event())
    w = Window.partitionBy(*BOARD_KEY).orderBy(F.col("fetched_at").desc(), F.col("odds_id").desc())
    return odds.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def board_lines(odds: DataFrame) -> DataFrame:
    """The keys of newest_board(), where it does not matter what was fetched last."""
    return odds.withColumn("event", _event()).select(*BOARD_KEY).distinct()


def same_spec(a: str, b: str) -> Column:
    """Equal market specification; null equals null."""
    out = F.lit(True)
    for c in SPEC:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def flip_quotes(rows: DataFrame, flipped: str) -> DataFrame:
    """Rows seen with the sides changed where the column is true: prices of home and away (if there are prices), the sign of a spread's line, the team of a
    team total."""
    at = lambda k: F.try_element_at("selections", F.lit(k))
    swap = F.create_map(F.lit("home"), F.lit("away"), F.lit("away"), F.lit("home"))
    turned = F.map_filter(F.map_zip_with(F.transform_keys("selections", lambda k, _: F.coalesce(F.try_element_at(swap, k), k)), "selections", lambda k, v, _: v), lambda _, v: v.isNotNull())
    yes = F.coalesce(F.col(flipped), F.lit(False))
    out = {"selections": F.when(yes & (at("home").isNotNull() | at("away").isNotNull()), turned).otherwise(F.col("selections"))} if "selections" in rows.columns else {}
    out["line"] = F.when(yes & (F.col("market_type") == "spread"), -F.col("line")).otherwise(F.col("line"))
    out["team_side"] = F.when(yes, F.coalesce(F.try_element_at(swap, F.col("team_side")), F.col("team_side"))).otherwise(F.col("team_side"))
    return rows.withColumns(out)


def _near_lines(soft: DataFrame, ref: DataFrame, pairs: DataFrame, **kept: str) -> DataFrame:
    """Each soft row beside every reference row of the matched event with the same specification and a line within tolerance, with their gap. kept: further
    columns of the reference by the names they get.

    The join is on event, specification and hundredths of the line, the reference side put into its own and both neighbouring
    hundredths, so a tolerance is an equi-join. Where nothing is kept, rows are narrow and few a key, so they are met by hash, not sorted."""
    met = lambda df: df if kept else df.hint("shuffle_hash")
    cents = lambda c: F.coalesce(F.round(c * 100).cast("long"), F.lit(-(10**9)))
    text = lambda c: F.coalesce(F.col(c), F.lit("~"))
    on = ["source", "event"] + (["sport"] if "sport" in pairs.columns else [])
    pairs = pairs if "flipped" in pairs.columns else pairs.withColumn("flipped", F.lit(False))
    left = soft.join(met(pairs), on).withColumns({"_c": cents(F.col("line")), **{f"_{c}": text(c) for c in SPEC}})
    right = ref.withColumnRenamed("event", "ref_event").join(met(pairs.select("ref_event", "flipped", *on[2:]).distinct()), ["ref_event", *on[2:]])
    right = flip_quotes(right, "flipped").select("ref_event", "flipped", *on[2:], F.col("line").alias("ref_line"), *[F.col(c).alias(n) for n, c in kept.items()], *[text(c).alias(f"_{c}") for c in SPEC], F.explode(F.array(cents(F.col("line")) - 1, cents(F.col("line")), cents(F.col("line")) + 1)).alias("_c"))
    near = left.join(met(right), ["ref_event", "flipped", *on[2:], "_c", *[f"_{c}" for c in SPEC]]).withColumn("gap", F.coalesce(F.abs(F.col("line") - F.col("ref_line")), F.lit(0.0)))
    return near.where((F.col("gap") <= LINE_TOLERANCE + 1e-9) & F.col("line").isNull().eqNullSafe(F.col("ref_line").isNull())).drop("_c", *[f"_{c}" for c in SPEC])


def closest_line(soft: DataFrame, ref: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each soft row the reference row of the matched event with the same specification and the nearest line within tolerance
    (moneylines need none); ties keep the smaller id. pairs: source, event (of soft), ref_event and, if events are matched with their sides
    changed, flipped; the reference's row is then seen with its sides changed, too. If pairs have a sport, events are of that sport."""
    w = Window.partitionBy("odds_id").orderBy("gap", "ref_id")
    return _near_lines(soft, ref, pairs, ref_id="odds_id", ref_selections="selections").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def met_lines(soft: DataFrame, ref: DataFrame, pairs: DataFrame) -> DataFrame:
    """The keys of the soft rows of closest_line(), from board_lines() of both."""
    return _near_lines(soft, ref, pairs).select(*BOARD_KEY).distinct()


def fair_sides(df: DataFrame, selections: str) -> DataFrame:
    """Adds fair: map of side to fair probability, by the number of sides; null where a side is missing or bad."""
    at = lambda k: valid(F.try_element_at(selections, F.lit(k)))
    h, d, a, o, u = (at(k) for k in ("home", "draw", "away", "over", "under"))
    three = shin_three_way(h, d, a)
    ok = lambda *c: F.array_min(F.array(*[x.isNotNull() for x in c]))
    has_draw = F.map_contains_key(selections, F.lit("draw"))
    two = lambda p, q, x, y: F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), x.alias("x"), y.alias("y"))
    # the prices are bound to a name by the lambda, else the solver's formula would repeat their lookup dozens of times
    pair = F.transform(F.array(F.when(ok(h, a), two("home", "away", h, a)).when(ok(o, u), two("over", "under", o, u))), lambda s: F.when(s.isNotNull(), F.create_map(s["p"], shin_two_way(s["x"], s["y"]), s["q"], shin_two_way(s["y"], s["x"]))))[0]
    return df.withColumn("_t", F.when(has_draw & ok(h, d, a), three)).withColumn(
        "fair", F.when(has_draw, F.when(F.col("_t").isNotNull(), F.create_map(F.lit("home"), F.col("_t")[0], F.lit("draw"), F.col("_t")[1], F.lit("away"), F.col("_t")[2]))).otherwise(pair)
    ).drop("_t")


def value_edges(joined: DataFrame, least: float = 1.0) -> DataFrame:
    """Sides whose soft price beats the reference's fair probability by at least `least` percent, with the Kelly stake."""
    f = fair_sides(joined, "ref_selections")
    rows = long_quotes(f.where("fair IS NOT NULL"), "odds_id", "ref_id", "source", "sport", "event", "fair").withColumn("p", F.try_element_at("fair", F.col("side")))
    rows = rows.withColumns({"edge": edge_pct(F.col("price"), F.col("p")), "stake": kelly_stake(F.col("price"), F.col("p"))})
    return rows.where(F.col("edge") >= least).select("odds_id", "ref_id", "source", "sport", "event", "side", "price", "p", "edge", "stake")


def arb_edges(joined: DataFrame) -> DataFrame:
    """Two-way arbitrage of a soft side with the opposite side of the reference at its own price: 1 - (1/soft + 1/ref) > 0."""
    opposite = F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair])
    rows = long_quotes(joined.where(~F.map_contains_key("selections", F.lit("draw"))), "odds_id", "ref_id", "source", "event", "ref_selections")
    rows = rows.withColumn("ref_price", valid(F.try_element_at("ref_selections", F.try_element_at(opposite, F.col("side")))))
    return rows.withColumn("margin", (1.0 - (1.0 / F.col("price") + 1.0 / F.col("ref_price"))) * 100.0).where("margin > 0").select("odds_id", "ref_id", "source", "event", "side", "price", "ref_price", "margin")


def match_confidence(kind: Column, score: Column, gap: Column, edge: Column) -> Column:
    """strong, medium or weak from the match's score, the kickoff gap (seconds) and the size of the edge; null scores are neither low nor high."""
    huge = F.when(kind == "EV", 25.0).otherwise(12.0)
    big = F.when(kind == "EV", 10.0).otherwise(5.0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    weak = yes(edge >= huge) | yes(gap > 2400) | yes(score < 78) | (yes(edge >= big) & (score.isNull() | yes(score < 88)))
    strong = yes(score >= 88) & yes(edge < big) & (gap.isNull() | yes(gap <= 1500))
    return F.when(weak, "weak").when(strong, "strong").otherwise("medium")


LADDER = ["source", "event", "market_type", "period", "submarket", "team_side", "section", "side"]


def ladder_rungs(board: DataFrame) -> DataFrame:
    """Rungs of all ladders, one row a line (of repeated lines the one with the smaller id)."""
    rungs = long_quotes(board.where("line IS NOT NULL AND market_type IN ('spread', 'total', 'team_total')"), "odds_id", "source", "event", *SPEC, "section", "line")
    w = Window.partitionBy(*LADDER, "line").orderBy("odds_id")
    return rungs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ladder_anomalies(board: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """Neighbouring rungs in the wrong order: with a rising line home and under must not rise, away and over must not fall.

    delta is the violation, pct its share of the smaller price, inflated the line whose price is too high."""
    w = Window.partitionBy(*LADDER).orderBy("line")
    r = ladder_rungs(board).withColumns({"hi_line": F.lead("line").over(w), "hi_price": F.lead("price").over(w)}).where("hi_line IS NOT NULL")
    falling = F.col("side").isin(*FALLING)
    delta = F.when(falling, F.col("hi_price") - F.col("price")).otherwise(F.col("price") - F.col("hi_price"))
    r = r.withColumn("delta", delta).where("delta > 1e-9").withColumn("pct", F.col("delta") / F.least("price", "hi_price") * 100.0)
    return r.where(F.col("pct") >= least_pct).select(*LADDER, F.col("line").alias("lo_line"), "hi_line", F.col("price").alias("lo_price"), "hi_price", "delta", "pct", F.when(falling, F.col("hi_line")).otherwise(F.col("line")).alias("inflated"))


def coverage(board: DataFrame) -> DataFrame:
    """By source and sport: rows, events, ladders (two rungs or more), rungs in them, moneylines, events without a ladder."""
    rungs = board.where("line IS NOT NULL AND market_type IN ('spread', 'total', 'team_total')").groupBy("source", "sport", "event", *SPEC, "section").agg(F.countDistinct("line").alias("n")).where("n >= 2")
    per_event = board.groupBy("source", "sport", "event").agg(F.count("*").alias("rows"), F.sum((F.col("market_type") == "moneyline").cast("long")).alias("moneylines"))
    ladders = rungs.groupBy("source", "sport", "event").agg(F.count("*").alias("ladders"), F.sum("n").alias("rungs"))
    both = per_event.join(ladders, ["source", "sport", "event"], "left")
    return both.groupBy("source", "sport").agg(F.sum("rows").alias("rows"), F.count("*").alias("events"), F.sum(F.coalesce("ladders", F.lit(0))).alias("ladders"), F.sum(F.coalesce("rungs", F.lit(0))).alias("rungs"), F.sum("moneylines").alias("moneylines"), F.sum(F.col("ladders").isNull().cast("long")).alias("bare_events"))


def main_section(board: DataFrame) -> DataFrame:
    """The section with the most rungs of every event, period and market; ties go to the one seen first."""
    n = board.where("line IS NOT NULL").groupBy("source", "event", "period", "market_type", "section").agg(F.count("*").alias("rungs"), F.min("odds_id").alias("first_id"))
    w = Window.partitionBy("source", "event", "period", "market_type").orderBy(F.col("rungs").desc(), "first_id")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_variants(rows: DataFrame, rank: str) -> DataFrame:
    """Lowest rank of every line (ties: smaller id); then, in a market that has a row of rank 0, only rows of rank 0."""
    key = ["source", "event", *SPEC]
    first = Window.partitionBy(*key, "line").orderBy(rank, "odds_id")
    best = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.withColumn("_least", F.min(rank).over(Window.partitionBy(*key))).where((F.col("_least") > 0) | (F.col(rank) == 0)).drop("_least")


def best_prices(quotes: DataFrame, key: list[str]) -> DataFrame:
    """Of every key and side the best price and its source (ties: the source that sorts first) and the number of sources."""
    w = Window.partitionBy(*key, "side").orderBy(F.col("price").desc(), "source")
    counted = quotes.groupBy(*key, "side", "source").agg(F.max("price").alias("price"))
    n = F.count("*").over(Window.partitionBy(*key, "side"))
    return counted.withColumns({"_n": F.row_number().over(w), "sources": n}).where("_n = 1").drop("_n")


def cross_source_arbs(best: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose best prices of two or three sides, from at least two sources, imply less than 1 together; with the sum and the margin."""
    by = best.groupBy(*key).agg(F.count("*").alias("sides"), F.max((F.col("side") == "draw").cast("int")).alias("draw"), F.size(F.collect_set("source")).alias("books"), F.sum(1.0 / F.col("price")).alias("implied"))
    return by.where((F.col("sides") == F.when(F.col("draw") == 1, 3).otherwise(2)) & (F.col("books") >= 2) & (F.col("implied") < 1)).withColumn("margin", (1.0 - F.col("implied")) * 100.0).drop("draw")
