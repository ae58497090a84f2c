"""Cross-market checks inside one source's event: win chances and totals that different markets imply must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions.odds import shin_three_way, shin_two_way, valid
from oddsloom.operators import models
from oddsloom.operators.board import with_sides
from oddsloom.plans.materialize import table as stored

#: The sports whose markets hang together in these ways.
SPORTS = ("basketball", "soccer")
EVENT = ["source", "sport", "event"]
#: Thresholds, in percentage points, points of a total, and ratios.
ML_SPREAD_PP, TOTAL_POINTS, DECISIVE, EXTREME_PP, HALF_FULL_PP, COMBO_PCT, FAVOURITE_PP, OVERTIME_PP = 5.0, 5.0, 0.06, 6.0, 13.0, 2.0, 10.0, 1.5
#: Half/full prices outside these bounds are not looked at; a fair price above the third is no edge.
COMBO_LEAST, COMBO_MOST, FAIR_MOST = 1.15, 4.5, 20.0
#: Half/full against the model: edge in percent, quotient of the shapes and least chance by the model, priced outcomes of nine and of six.
FAIR_PCT, SHAPE_RATIO, SHAPE_LEAST, PRICED_NINE, PRICED_SIX = 3.0, 1.5, 0.05, 7, 5
#: A side below the first price is a heavy favourite; its half/full price is generous from these multiples of its first half and of its moneyline on.
HEAVY, HALF_MULTIPLE, LINE_MULTIPLE = 1.30, 1.2, 1.35
#: Parts of the names of leagues that are not swept.
TOP_LEAGUES = ["world cup", "champions league", "europa", "conference", "uefa", "premier league", "la liga", "serie a", "bundesliga", "ligue 1", "nations league", "copa america", "euro 20"]
#: Periods that add up to another.
SUMS = {"FT": [("H1", "H2"), ("Q1", "Q2", "Q3", "Q4")], "H1": [("Q1", "Q2")], "H2": [("Q3", "Q4")]}


def _crossing(board: DataFrame, market: str, side: str, other: str, name: str) -> DataFrame:
    """The line at which the devigged chance of `side` crosses one half: linear between the first two neighbouring rungs around it.
    Only the section with the most rows counts (ties: the one with the smaller id)."""
    at = lambda k: valid(F.try_element_at("selections", F.lit(k)))
    group = [*EVENT, "period"]
    own = board.where((F.col("market_type") == market) & F.col("submarket").isNull())
    sections = own.groupBy(*group, "section").agg(F.struct(F.count("*").alias("n"), (-F.min("odds_id")).alias("i")).alias("rank"))
    main = sections.groupBy(*group).agg(F.max_by(F.struct("section"), "rank").alias("main"))
    own = own.join(main, group).where(F.col("section").eqNullSafe(F.col("main.section")) & F.col("line").isNotNull())
    rungs = own.select(*group, "line", "odds_id", shin_two_way(at(side), at(other)).alias("p")).where("p IS NOT NULL")
    rungs = rungs.groupBy(*group, "line").agg(F.min_by("p", "odds_id").alias("p"))
    w = Window.partitionBy(*group).orderBy("line")
    r = rungs.withColumns({"l2": F.lead("line").over(w), "p2": F.lead("p").over(w)}).where("(p - 0.5) * (p2 - 0.5) <= 0 AND p2 <> p")
    r = r.withColumn("x", F.col("line") + (0.5 - F.col("p")) * (F.col("l2") - F.col("line")) / (F.col("p2") - F.col("p")))
    return r.groupBy(*group).agg(F.min_by("x", "line").alias(name))


def period_view(board: DataFrame) -> DataFrame:
    """One row an event and period: ml2 and ml3 (chance of the home side by the two- and three-way moneyline), pick (by the spread at
    line 0), spread_center and total_center (lines at which the chances are even); null where a market is missing. ml3_away is the
    away side's chance by the three-way moneyline. Other sports than SPORTS are left out."""
    board = board.where(F.col("sport").isin(*SPORTS))
    s = with_sides(board).where("submarket IS NULL")
    ml = s.where("market_type = 'moneyline'")
    two = ml.where("NOT three_way AND h IS NOT NULL AND a IS NOT NULL").groupBy(*EVENT, "period").agg(F.min_by(shin_two_way(F.col("h"), F.col("a")), "odds_id").alias("ml2"))
    three = ml.where("three_way AND h IS NOT NULL AND d IS NOT NULL AND a IS NOT NULL").groupBy(*EVENT, "period").agg(F.min_by(F.struct("h", "d", "a"), "odds_id").alias("x")).withColumn("y", shin_three_way("x.h", "x.d", "x.a")).select(*EVENT, "period", F.col("y")[0].alias("ml3"), F.col("y")[2].alias("ml3_away"))
    pick = s.where("market_type = 'spread' AND line = 0 AND h IS NOT NULL AND a IS NOT NULL").groupBy(*EVENT, "period").agg(F.min_by(shin_two_way(F.col("h"), F.col("a")), "odds_id").alias("pick"))
    on = [*EVENT, "period"]
    out = two.join(three, on, "full").join(pick, on, "full")
    return out.join(_crossing(board, "spread", "home", "away", "spread_center"), on, "full").join(_crossing(board, "total", "over", "under", "total_center"), on, "full")


def _flag(df: DataFrame, kind: str, periods: Column, size: Column, outcome: Column | None = None) -> DataFrame:
    return df.select(*EVENT, F.lit(kind).alias("kind"), periods.alias("periods"), (F.lit(None).cast("string") if outcome is None else outcome).alias("outcome"), size.alias("severity"))


def moneyline_against_spread(view: DataFrame) -> DataFrame:
    gap = F.abs(F.col("ml2") - F.col("pick")) * 100
    return _flag(view.where(gap >= ML_SPREAD_PP), "ml_vs_spread", F.col("period"), gap)


def _with_full(view: DataFrame) -> DataFrame:
    full = view.where("period = 'FT'").select(*EVENT, F.col("ml2").alias("f2"), F.coalesce("ml2", "ml3").alias("fw"))
    return view.where("period <> 'FT'").join(full, EVENT)


def favourite_flip(view: DataFrame) -> DataFrame:
    """Decisive favourites of the whole game and of a period on opposite sides."""
    v = _with_full(view)
    a, b = F.col("f2") - 0.5, F.col("ml2") - 0.5
    return _flag(v.where((a * b < 0) & (F.abs(a) >= DECISIVE) & (F.abs(b) >= DECISIVE)), "favourite_flip", F.concat("period", F.lit(" vs FT")), F.abs(a - b) * 100)


def quarter_extreme(view: DataFrame) -> DataFrame:
    """A quarter more one-sided than the whole game."""
    v = _with_full(view).where("period LIKE 'Q%'")
    more = (F.abs(F.col("ml2") - 0.5) - F.abs(F.col("f2") - 0.5)) * 100
    return _flag(v.where(more >= EXTREME_PP), "quarter_ml_extreme", F.concat("period", F.lit(" vs FT")), more)


def half_against_full(view: DataFrame) -> DataFrame:
    v = _with_full(view).where("period = 'H1'")
    gap = F.abs(F.col("fw") - F.coalesce("ml2", "ml3")) * 100
    return _flag(v.where(gap >= HALF_FULL_PP), "ht_vs_ft_divergence", F.lit("H1 vs FT"), gap)


def total_additivity(view: DataFrame) -> DataFrame:
    """Centres of the parts' totals that do not add up to the whole's."""
    wide = view.groupBy(*EVENT).agg(*[F.max(F.when(F.col("period") == p, F.col("total_center"))).alias(p) for p in ("FT", "H1", "H2", "Q1", "Q2", "Q3", "Q4")])
    out = None
    for whole, sums in SUMS.items():
        for parts in sums:
            total = F.lit(0.0)
            for p in parts:
                total = total + F.col(p)
            gap = F.abs(total - F.col(whole))
            f = _flag(wide.where(gap >= TOTAL_POINTS), "total_additivity", F.lit(f"{'+'.join(parts)} vs {whole}"), gap)
            out = f if out is None else out.unionByName(f)
    return out


def overtime_fold(view: DataFrame) -> DataFrame:
    """A side that wins more often in regulation (three-way) than with overtime (two-way): outcome is the side, with '*' if the favourite differs, too."""
    flip = (F.col("ml3") > F.col("ml3_away")) != (F.col("ml2") > 1 - F.col("ml2"))
    side = lambda name, three, two: F.struct(F.lit(name).alias("side"), ((F.col(three) - two) * 100).alias("gap"))
    rows = view.where("ml2 IS NOT NULL AND ml3 IS NOT NULL").withColumn("r", F.explode(F.array(side("home", "ml3", F.col("ml2")), side("away", "ml3_away", 1 - F.col("ml2")))))
    return _flag(rows.where(F.col("r.gap") >= OVERTIME_PP), "overtime_fold", F.col("period"), F.col("r.gap"), F.concat("r.side", F.when(flip, "*").otherwise("")))


def _first_combo(s: DataFrame) -> DataFrame:
    return s.where("market_type = 'htft' AND period = 'FT'").groupBy(*EVENT).agg(F.min_by("selections", "odds_id").alias("c"))


def half_full_combos(board: DataFrame) -> DataFrame:
    """Half-time/full-time prices of 1/1 and 2/2 outside what their legs allow: shorter than the longer leg, or longer than the price
    under correlated legs, by two percent at least. Only prices from COMBO_LEAST to COMBO_MOST."""
    s = with_sides(board).where("submarket IS NULL")
    leg = lambda p: s.where((F.col("market_type") == "moneyline") & (F.col("period") == p) & F.col("three_way")).groupBy(*EVENT).agg(F.min_by(F.struct("h", "a"), "odds_id").alias(p))
    j = _first_combo(s).join(leg("H1"), EVENT).join(leg("FT"), EVENT)
    rows = j.select(*EVENT, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), valid(F.try_element_at("c", F.lit(o))).alias("posted"), F.col(f"H1.{x}").alias("h1"), F.col(f"FT.{x}").alias("ft")) for o, x in (("1/1", "h"), ("2/2", "a"))])).alias("r")).select(*EVENT, "r.*")
    longest = F.greatest("h1", "ft")
    upper = F.greatest(F.col("h1") * (1 + (F.col("ft") - 1) / 2), F.col("h1"), F.col("ft"))
    short, long = (longest / F.col("posted") - 1) * 100, (F.col("posted") / upper - 1) * 100
    ok = F.col("h1").isNotNull() & F.col("ft").isNotNull() & F.col("posted").between(COMBO_LEAST, COMBO_MOST)
    return _flag(rows.where(ok & ((short >= COMBO_PCT) | (long >= COMBO_PCT))), "htft_combo", F.lit("H1+FT"), F.when(short >= COMBO_PCT, short).otherwise(long), F.col("outcome"))


def half_full_against_model(board: DataFrame, view: DataFrame, leagues: DataFrame) -> DataFrame:
    """Basketball's half/full prices against the model of both margins: above the fair price (edge), else, where enough outcomes are priced, a
    chance without margin that is far from the model's (shape). leagues: source, sport, event, league."""
    s = board.where("sport = 'basketball' AND submarket IS NULL")
    part = lambda p, *c: view.where((F.col("period") == p) & (F.col("sport") == "basketball")).select(*EVENT, *c)
    full = part("FT", (-F.col("spread_center")).alias("mu"), F.col("ml2").alias("win")).join(part("H1", (-F.col("spread_center")).alias("mu1")), EVENT, "left")
    j = full.join(_first_combo(s), EVENT).join(leagues, EVENT, "left").where("mu IS NOT NULL OR win IS NOT NULL")
    fair = models.half_full_sheet(j, EVENT, combo="c", win="win").withColumnRenamed("prob", "p")
    priced = j.select(*EVENT, F.explode(F.map_entries("c")).alias("e")).select(*EVENT, F.col("e.key").alias("outcome"), valid(F.col("e.value")).alias("posted")).where("posted IS NOT NULL")
    total = priced.groupBy(*EVENT).agg(F.sum(1 / F.col("posted")).alias("over"), F.count("*").alias("n"), F.max(F.col("outcome").endswith("/X").cast("int")).alias("nine"))
    r = priced.join(fair, [*EVENT, "outcome"]).join(total, EVENT).where((F.col("p") > 0) & F.col("posted").between(COMBO_LEAST, COMBO_MOST) & (F.col("p") >= 1 / FAIR_MOST))
    edge = (F.col("posted") * F.col("p") - 1) * 100
    ratio = (1 / F.col("posted")) / F.col("over") / F.col("p")
    shape = (F.col("n") >= F.when(F.col("nine") == 1, PRICED_NINE).otherwise(PRICED_SIX)) & (F.col("p") >= SHAPE_LEAST) & ((ratio >= SHAPE_RATIO) | (ratio <= 1 / SHAPE_RATIO))
    return _flag(r.where((edge >= FAIR_PCT) | shape), "htft_fair", F.lit("HT/FT"), F.when(edge >= FAIR_PCT, edge).otherwise(F.abs(ratio - 1) * 100), F.col("outcome"))


def top_league(league: Column) -> Column:
    out = F.lit(False)
    for word in TOP_LEAGUES:
        out = out | F.coalesce(F.lower(league).contains(word), F.lit(False))
    return out


def favourite_side(home: Column, away: Column) -> Column:
    """home or away, whichever is below HEAVY, or whose price alone is missing; else null."""
    return F.when(home < HEAVY, "home").when(away < HEAVY, "away").when(home.isNull() & away.isNotNull(), "home").when(away.isNull() & home.isNotNull(), "away")


def worth_opening(sport: Column, home: Column, away: Column, league: Column, soccer_most: float = 1.5) -> Column:
    """Whether a listing is looked into: no top league, and a heavy favourite (soccer: a side below soccer_most, or one price alone missing)."""
    soccer = F.coalesce(home < soccer_most, F.lit(False)) | F.coalesce(away < soccer_most, F.lit(False)) | (home.isNull() != away.isNull())
    return ~top_league(league) & F.when(sport == "soccer", soccer).otherwise(favourite_side(home, away).isNotNull())


def favourite_combo(board: DataFrame) -> DataFrame:
    """Soccer: the heavy favourite's half/full price at HALF_MULTIPLE of its first-half price at least, else at LINE_MULTIPLE of its moneyline."""
    s = with_sides(board).where("submarket IS NULL AND sport = 'soccer'")
    leg = lambda p: s.where((F.col("market_type") == "moneyline") & (F.col("period") == p)).groupBy(*EVENT).agg(F.min_by(F.struct("h", "a"), "odds_id").alias(p))
    j = _first_combo(s).join(leg("FT"), EVENT).join(leg("H1"), EVENT, "left").withColumn("side", favourite_side(F.col("FT.h"), F.col("FT.a"))).where("side IS NOT NULL")
    own = lambda c: F.when(F.col("side") == "home", F.col(f"{c}.h")).otherwise(F.col(f"{c}.a"))
    at = lambda k: valid(F.try_element_at("c", F.lit(k)))
    outcome = F.when(F.col("side") == "home", "1/1").otherwise("2/2")
    j = j.withColumns({"h1": own("H1"), "ft": own("FT"), "posted": F.when(F.col("side") == "home", at("1/1")).otherwise(at("2/2"))})
    ratio = F.when(F.col("posted") >= HALF_MULTIPLE * F.col("h1"), F.col("posted") / F.col("h1")).when(F.col("posted") >= LINE_MULTIPLE * F.col("ft"), F.col("posted") / F.col("ft"))
    return _flag(j.where(ratio.isNotNull()), "soccer_htft", F.lit("HT/FT"), (F.round(ratio, 2) - 1) * 100, outcome)


def favourite_disagreement(board: DataFrame) -> DataFrame:
    """Basketball: chances of the home side (draw left out) by two-way, three-way and first-half moneyline and by the half/full combos: a favourite that
    flips, or a spread of ten points at least. Severity is the spread."""
    s = with_sides(board).where("submarket IS NULL AND sport = 'basketball'")
    two = lambda h, a: F.when(h.isNotNull() & a.isNotNull(), (1 / h) / (1 / h + 1 / a))
    ml = s.where("market_type = 'moneyline'")
    pick = lambda cond, n: ml.where(cond).groupBy(*EVENT).agg(F.min_by(two(F.col("h"), F.col("a")), "odds_id").alias(n))
    at = lambda k: 1 / valid(F.try_element_at("c", F.lit(k)))
    some = lambda *k: F.aggregate(F.array_compact(F.array(*[at(x) for x in k])), F.lit(0.0), lambda x, y: x + y)
    combo = _first_combo(s)
    home, away = some("1/1", "X/1", "2/1"), some("1/2", "X/2", "2/2")
    combo = combo.select(*EVENT, F.when((home > 0) & (away > 0), home / (home + away)).alias("c"))
    j = pick("period = 'FT' AND NOT three_way", "m2").join(pick("period = 'FT' AND three_way", "m3"), EVENT, "full").join(pick("period = 'H1'", "ht"), EVENT, "full").join(combo, EVENT, "full")
    ps = F.array_compact(F.array("m2", "m3", "ht", "c"))
    j = j.withColumns({"n": F.size(ps), "lo": F.array_min(ps), "hi": F.array_max(ps)})
    return _flag(j.where("n >= 2 AND (lo < 0.5 AND hi > 0.5 OR (hi - lo) * 100 >= 10)"), "basketball_fav", F.lit("2W/3W/HT"), (F.col("hi") - F.col("lo")) * 100)


def leagues_of(board: DataFrame) -> DataFrame:
    return board.groupBy(*EVENT).agg(F.min_by("league", "odds_id").alias("league"))


def consistency_flags(board: DataFrame) -> DataFrame:
    """All detectors on one board, for SPORTS."""
    board = board.where(F.col("sport").isin(*SPORTS))
    view = stored(period_view(board))  # every detector reads it
    out = moneyline_against_spread(view)
    for more in (favourite_flip(view), quarter_extreme(view), half_against_full(view), total_additivity(view), overtime_fold(view), half_full_combos(board), half_full_against_model(board, view, leagues_of(board))):
        out = out.unionByName(more)
    return out


def sweep_flags(board: DataFrame) -> DataFrame:
    """What a sweep over all sources flags: of the events worth opening, the favourites' half/full prices (soccer) and the favourites that markets
    do not agree on (basketball)."""
    s = with_sides(board).where("submarket IS NULL AND market_type = 'moneyline' AND period = 'FT'")
    ml = s.groupBy(*EVENT).agg(F.min_by(F.struct("h", "a"), "odds_id").alias("x")).join(leagues_of(board), EVENT)
    open_ = ml.where(worth_opening(F.col("sport"), F.col("x.h"), F.col("x.a"), F.col("league"))).select(*EVENT)
    return favourite_combo(board).unionByName(favourite_disagreement(board)).join(open_, EVENT, "left_semi")


#: Parts of market names that speak of less than the whole game, that name its result, and that name its winner with overtime.
NOT_WHOLE = [
    "half", "quarter", " set", "period", " map", "1st", "2nd", "3rd", "4th", "5th", "inning", "frame", " leg", "which", "scores", "race", "odd", "even", "exact", "correct", "range", "player", "both teams", "margin", "highest", "method", "first", "last", "to score",
    "double chance",
]
RESULT_WORDS, OVERTIME_WORDS = ["result", "1x2", "main", "regular"], ["ot", "overtime", "incl", "winner", "money", "12"]
#: Ids of the feed's markets that stay the same.
RESULT_IDS, WINNER_IDS = [1, 409], [396]


def moneyline_markets(outcomes: DataFrame) -> DataFrame:
    """event, reg_market, reg (map of 1, X, 2 to price), ot_market, ot (map of 1, 2): of every event the three-way result of the regular game and the
    two-way winner, if it has both. Outcomes in; a market is left out if it has a line or its name speaks of less than the whole game;
    of several the one with a stable id (of winners first one whose name speaks of overtime), then the one listed first.

    outcomes: event, seq (place of the market), market_id, market, outcome, price, lined, open. Outcomes that are closed or have no valid price do not count."""
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    name = F.lower(F.trim("market"))
    priced = outcomes.where(F.coalesce("open", F.lit(True))).withColumn("price", valid(F.col("price"))).where("price IS NOT NULL")
    m = priced.groupBy("event", "seq").agg(F.min("market_id").alias("market_id"), F.min("market").alias("market"), F.max(F.coalesce("lined", F.lit(False))).alias("lined"), F.collect_list(F.struct(F.trim("outcome").alias("k"), "price")).alias("o"))
    m = m.where(~F.col("lined") & ~has(F.concat(F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" ")), NOT_WHOLE)).withColumn("labels", F.array_sort(F.array_distinct(F.transform("o", lambda x: x["k"]))))
    price = lambda k: F.element_at(F.filter("o", lambda x: x["k"] == k), -1)["price"]
    three, two = F.array(*map(F.lit, ("1", "2", "X"))), F.array(F.lit("1"), F.lit("2"))
    pick = lambda rows, order, *sides: rows.groupBy("event").agg(F.min_by(F.struct("market", *[price(k).alias(n) for k, n in sides]), F.struct(*order, "seq")).alias("x"))
    reg = pick(m.where((F.size(F.array_intersect("labels", three)) == 3) & has(name, RESULT_WORDS)), [~F.coalesce(F.col("market_id").isin(*RESULT_IDS), F.lit(False))], ("1", "h"), ("X", "d"), ("2", "a"))
    win = pick(m.where(F.col("labels") == two), [~F.coalesce(has(name, OVERTIME_WORDS), F.lit(False)), ~F.coalesce(F.col("market_id").isin(*WINNER_IDS), F.lit(False))], ("1", "h"), ("2", "a"))
    return reg.select("event", F.col("x").alias("reg")).join(win.select("event", F.col("x").alias("ot")), "event")


def overtime_flags(outcomes: DataFrame, *, least: float = OVERTIME_PP) -> DataFrame:
    """event, kind (overtime_flip if the favourite differs, else overtime_fold), outcome (the side that lost chance), severity (points), reg_market, ot_market."""
    m = moneyline_markets(outcomes).withColumn("three", shin_three_way("reg.h", "reg.d", "reg.a")).withColumn("two", shin_two_way(F.col("ot.h"), F.col("ot.a")))
    flip = (F.col("three")[0] > F.col("three")[2]) != (F.col("two") > 1 - F.col("two"))
    side = lambda n, p, q: F.struct(F.lit(n).alias("outcome"), ((p - q) * 100).alias("severity"))
    rows = m.select("event", F.when(flip, "overtime_flip").otherwise("overtime_fold").alias("kind"), F.explode(F.array(side("home", F.col("three")[0], F.col("two")), side("away", F.col("three")[2], 1 - F.col("two")))).alias("r"), F.col("reg.market").alias("reg_market"), F.col("ot.market").alias("ot_market"))
    return rows.select("event", "kind", "r.*", "reg_market", "ot_market").where(F.col("severity") >= least)
