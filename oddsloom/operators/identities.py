"""Model-free identities on a posted sheet: raw implied chances of one event's keys that must add up or be equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.odds import line_text, valid
from oddsloom.operators.board import with_sides

EPSILON = 0.005
_LABELS = ("1", "X", "2")
#: Fixed values: (name, whole, parts) of outcomes that are split up without overlap.
PARTITIONS = (
    [(f"HT/FT to FT {x}", f"ft_1x2:{x}", [f"htft:{h}/{x}" for h in _LABELS]) for x in _LABELS]
    + [(f"HT/FT to HT {x}", f"ht_1x2:{x}", [f"htft:{x}/{f}" for f in _LABELS]) for x in _LABELS]
    + [("DC 1X", "dc:1X", ["ft_1x2:1", "ft_1x2:X"]), ("DC 12", "dc:12", ["ft_1x2:1", "ft_1x2:2"]), ("DC X2", "dc:X2", ["ft_1x2:X", "ft_1x2:2"])]
    + [(f"Under {n}.5", f"ft_total:under_{n}.5", [f"exact:{g}" for g in range(n + 1)]) for n in range(4)]
    + [(f"Multigoal {a}-{b}", f"multigoal:{a}-{b}", [f"exact:{g}" for g in range(a, b + 1)]) for a, b in ((0, 1), (1, 2), (2, 3))]
)
_SCORES = [(i, j) for i in range(6) for j in range(6)]
#: The same by correct scores; those of the results only with the catch-all scores.
SCORE_PARTITIONS = [(f"Scores to Under {n}.5", f"ft_total:under_{n}.5", [f"cs:{i}-{j}" for i, j in _SCORES if i + j <= n]) for n in range(3)] + [
    (f"Scores to FT {x}", f"ft_1x2:{x}", [f"cs:{i}-{j}" for i, j in _SCORES if (i > j, i == j, i < j)["1X2".index(x)]] + [f"cs:other:{x}"]) for x in _LABELS
]
#: Keys that price the same bet.
EQUIVALENCES = [("ah:home_0", "dnb:1"), ("ah:away_0", "dnb:2"), ("ah:home_-0.5", "ft_1x2:1"), ("ah:away_-0.5", "ft_1x2:2"), ("ah:home_0.5", "dc:1X"), ("ah:away_0.5", "dc:X2")]
#: A quarter line and the two lines of which it is the mean.
QUARTERS = [("ah:home_-0.25", "ah:home_0", "ah:home_-0.5"), ("ah:home_0.25", "ah:home_0", "ah:home_0.5"), ("ah:home_-0.75", "ah:home_-0.5", "ah:home_-1"), ("ah:home_0.75", "ah:home_0.5", "ah:home_1")]
#: Keys of which one always wins or is returned.
COVERS = [("ah:home_0", "dnb:2"), ("ah:away_0", "dnb:1"), ("ah:home_-0.5", "dc:X2")]
#: Markets whose sides are named as in the keys, and their prefixes.
TOLD = {"htft": "htft:", "dc": "dc:", "exact": "exact:", "multigoal": "multigoal:", "correct_score": "cs:"}
EVENT = ["source", "event"]


def posted_sheet(board: DataFrame) -> DataFrame:
    """(source, event, key, posted) of soccer's results, totals, handicaps, half/full combos, double chances, no-draw bets, exact goals, bands of
    goals and correct scores; of repeated keys the smaller id's."""
    s = with_sides(board).where("sport = 'soccer' AND submarket IS NULL AND team_side IS NULL")
    plain = F.regexp_replace(line_text(F.col("line")), r"^\+", "")
    away = F.regexp_replace(line_text(-F.col("line")), r"^\+", "")
    row = lambda key, price: F.struct(key.alias("key"), price.alias("posted"))
    lit = F.lit
    ml = (F.col("market_type") == "moneyline") & F.col("three_way")
    tag = F.when(F.col("period") == "FT", "ft_1x2:").when(F.col("period") == "H1", "ht_1x2:")
    as_told = F.create_map(*[lit(x) for kv in TOLD.items() for x in kv])
    named = lambda prefix: F.transform(F.map_entries("selections"), lambda e: row(F.concat(prefix, e["key"]), valid(e["value"])))
    full = F.col("period") == "FT"
    made = (
        F.when(ml, F.array(*[row(F.concat(tag, lit(x)), F.col(c)) for x, c in (("1", "h"), ("X", "d"), ("2", "a"))]))
        .when((F.col("market_type") == "total") & full, F.array(row(F.concat(lit("ft_total:over_"), plain), F.col("o")), row(F.concat(lit("ft_total:under_"), plain), F.col("u"))))
        .when((F.col("market_type") == "spread") & full, F.array(row(F.concat(lit("ah:home_"), plain), F.col("h")), row(F.concat(lit("ah:away_"), away), F.col("a"))))
        .when((F.col("market_type") == "dnb") & full, F.array(row(lit("dnb:1"), F.col("h")), row(lit("dnb:2"), F.col("a"))))
        .when(full & F.map_contains_key(as_told, F.col("market_type")), named(as_told[F.col("market_type")]))
    )
    rows = s.select(*EVENT, "odds_id", F.explode(made).alias("r")).select(*EVENT, "odds_id", "r.*").where("key IS NOT NULL AND posted IS NOT NULL")
    return rows.groupBy(*EVENT, "key").agg(F.min_by("posted", "odds_id").alias("posted"))


def _dimension(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a fixed list


def partitions(sheet: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Wholes priced more likely than the sum of their parts: name, whole, excess (points), suspect (the part with the longest price)."""
    parts = _dimension(sheet, [(n, w, p, len(ps)) for n, w, ps in [*PARTITIONS, *SCORE_PARTITIONS] for p in ps], "name string, whole string, key string, size int")
    by = sheet.join(parts, "key").groupBy(*EVENT, "name", "whole", "size").agg(F.count("*").alias("n"), F.sum(1 / F.col("posted")).alias("total"), F.max_by("key", F.struct("posted", "key")).alias("suspect")).where("n = size")
    whole = sheet.select(*EVENT, F.col("key").alias("whole"), (1 / F.col("posted")).alias("p"))
    return by.join(whole, [*EVENT, "whole"]).withColumn("excess", (F.col("p") - F.col("total")) * 100).where(F.col("excess") > epsilon * 100).select(*EVENT, "name", "whole", "excess", "suspect")


def equivalences(sheet: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Pairs of keys for the same bet priced apart: gap in points, back = the one with the longer price."""
    pairs = _dimension(sheet, EQUIVALENCES, "key string, other string")
    b = sheet.select(*EVENT, F.col("key").alias("other"), F.col("posted").alias("posted_b"))
    j = sheet.join(pairs, "key").join(b, [*EVENT, "other"]).withColumn("gap", F.abs(1 / F.col("posted") - 1 / F.col("posted_b")) * 100)
    return j.where(F.col("gap") > epsilon * 100).select(*EVENT, "key", "other", "gap", F.when(F.col("posted") > F.col("posted_b"), F.col("key")).otherwise(F.col("other")).alias("back"))


def quarter_lines(sheet: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Quarter lines off the mean of their neighbours' implied chances, in points."""
    dim = _dimension(sheet, QUARTERS, "key string, lo string, hi string")
    near = lambda n: sheet.select(*EVENT, F.col("key").alias(n), (1 / F.col("posted")).alias(f"p_{n}"))
    j = sheet.join(dim, "key").join(near("lo"), [*EVENT, "lo"]).join(near("hi"), [*EVENT, "hi"])
    j = j.withColumn("gap", F.abs(1 / F.col("posted") - (F.col("p_lo") + F.col("p_hi")) / 2) * 100)
    return j.where(F.col("gap") > epsilon * 100).select(*EVENT, "key", "gap")


def covers(sheet: DataFrame) -> DataFrame:
    """Pairs of keys of one source that together imply less than 1, with the gain in percent."""
    dim = _dimension(sheet, COVERS, "key string, other string")
    b = sheet.select(*EVENT, F.col("key").alias("other"), F.col("posted").alias("posted_b"))
    j = sheet.join(dim, "key").join(b, [*EVENT, "other"]).withColumn("gain", (1 / (1 / F.col("posted") + 1 / F.col("posted_b")) - 1) * 100)
    return j.where("gain > 0").select(*EVENT, "key", "other", "gain")


def identity_flags(sheet: DataFrame) -> DataFrame:
    """All identities as one relation: source, event, kind, name, severity (points, for covers percent), suspect (what to look at)."""
    name = F.concat_ws(" = ", "key", "other")
    return (
        partitions(sheet).select(*EVENT, F.lit("partition").alias("kind"), "name", F.col("excess").alias("severity"), "suspect")
        .unionByName(equivalences(sheet).select(*EVENT, F.lit("equivalence").alias("kind"), name.alias("name"), F.col("gap").alias("severity"), F.col("back").alias("suspect")))
        .unionByName(quarter_lines(sheet).select(*EVENT, F.lit("quarter").alias("kind"), F.col("key").alias("name"), F.col("gap").alias("severity"), F.col("key").alias("suspect")))
        .unionByName(covers(sheet).select(*EVENT, F.lit("arb").alias("kind"), F.concat_ws(" + ", "key", "other").alias("name"), F.col("gain").alias("severity"), F.col("key").alias("suspect")))
    )
