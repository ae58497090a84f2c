"""Fuzzy join of two sources' fixtures: band join on kickoff, likeness of both sides in both orientations, one-to-one by likeness."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.functions import text as tx
from oddsloom.operators import fixture_blocks as fb
from oddsloom.plans.materialize import table as stored

#: Least scores and windows (seconds) of acceptance, by tier; the strong tier's window is wider for some sports.
STRONG, MEDIUM, WINDOW, WINDOWS = 80.0, 65.0, 3600, {"tennis": 6 * 3600}
LEAST_SIDE, CONTRADICTION, FLIP_MEAN, FLIP_BY, FLIP_SIDE = 50.0, 88.0, 85.0, 15.0, 70.0


#: Fixed value: acceptable pairs of a sport (and book) that are matched in one task.
IN_ORDER = 500_000
#: MinHash of unknown kickoffs: so many bands of two hashes find names of q-gram similarity 0.4 with probability 0.999.
BANDS = 40
_RNG = np.random.default_rng(7)
_MUL = (_RNG.integers(1, 2**31 - 1, 2 * BANDS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**31 - 1, 2 * BANDS).astype(np.uint64)
_MIX = _RNG.integers(1, 2**62, (BANDS, 2)).astype(np.uint64) | np.uint64(1)


@lru_cache(100_000)
def name_bands(norm: str) -> np.ndarray:
    """64-bit hashes of the MinHash bands of a name's padded 3-grams by word, each with the number of its band in it."""
    h = np.fromiter({zlib.crc32(f"##{w}##"[i : i + 3].encode()) for w in norm.split() for i in range(len(w) + 2)}, dtype=np.uint64)
    low = ((h[:, None] * _MUL + _ADD) >> np.uint64(7) & np.uint64(0xFFFFFFFF)).min(axis=0).reshape(BANDS, 2)
    return ((low * _MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def side_bands(fixtures: DataFrame, ident: str, home: str, away: str) -> DataFrame:
    """(sport, ident, h): the bands of both sides' names, so that a join on h meets both orientations."""

    def run(batches):
        for b in batches:
            rows = [(s, i, n) for s, i, x, y in zip(b["sport"], b[ident], b[home], b[away]) for n in {x, y} if n]
            if rows:
                yield pd.DataFrame({"sport": np.repeat([r[0] for r in rows], BANDS), ident: np.repeat([r[1] for r in rows], BANDS), "h": np.concatenate([name_bands(r[2]) for r in rows])})

    kind = dict(fixtures.dtypes)[ident]
    return fixtures.select("sport", ident, home, away).mapInPandas(run, f"sport string, {ident} {kind}, h long").distinct()


def prepared(events: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, sport, home, away, league, start (seconds or null) with normalised names and the marks of youth and women. aliases: alias, canonical."""
    distinct = events.select("sport", F.explode(F.array("home", "away")).alias("name")).where("name IS NOT NULL").distinct().withColumn("_said", F.col("name"))
    called = distinct if aliases is None else tx.with_aliases(distinct, aliases, "_said")
    norm = F.when(F.col("sport") == "tennis", tx.normal_player_name("_said")).otherwise(tx.normal_team("_said"))
    marks = stored(called.select("sport", "name", norm.alias("n"), tx.youth(F.col("name")).alias("y"), tx.women(F.col("name")).alias("w")))
    out = events
    for side in ("home", "away"):
        out = out.join(marks.select("sport", F.col("name").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "y", "w")]), ["sport", side], "left")
    marked = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = tx.women(F.col("league")) | marked("w_home") | marked("w_away") | tx.women_suffix_pair(F.col("home"), F.col("away"))
    return out.withColumns({"w": w, "y_home": marked("y_home"), "y_away": marked("y_away")}).drop("w_home", "w_away")


@lru_cache(500_000)
def likeness(ah: str, aa: str, bh: str, ba: str) -> tuple[float, float, bool, bool]:
    """(mean, weaker side, flipped, clash) of two fixtures by their normalised names. A weak side beside a strong one is lifted to MEDIUM if one
    name is the other's initialism. A clash is looked for only where it decides."""
    h, w = tx.token_set(ah, bh), tx.token_set(aa, ba)
    if h >= STRONG and w < MEDIUM and tx.initialism(aa, ba):
        w = MEDIUM
    elif w >= STRONG and h < MEDIUM and tx.initialism(ah, bh):
        h = MEDIUM
    hs, ws = tx.token_set(ah, ba), tx.token_set(aa, bh)
    flip = (hs + ws) / 2 >= FLIP_MEAN and (hs + ws) / 2 >= (h + w) / 2 + FLIP_BY and min(hs, ws) >= FLIP_SIDE
    one, two = (hs, ws) if flip else (h, w)
    mean = (one + two) / 2
    pair = (ah, ba, aa, bh) if flip else (ah, bh, aa, ba)
    return mean, min(one, two), flip, MEDIUM <= mean < CONTRADICTION and (tx.contradict(*pair[:2]) or tx.contradict(*pair[2:]))


def scored_pairs(soft: DataFrame, ref: DataFrame, by: tuple = (), aliases: DataFrame | None = None) -> DataFrame:
    """Pairs of one sport whose kickoffs are compatible, with mean, low (the weaker side), flipped, gap and the reject reason, or null
    where the pair is acceptable. by: further columns of soft that are kept.

    Kickoffs are bucketed by the sport's window; the reference side goes into its own and both neighbouring buckets. An unknown
    kickoff is compatible with any: such pairs are joined on MinHash bands of either side's name with either side's, so no cross
    product arises; they need the strong tier."""
    window = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv]), F.col("sport")), F.lit(WINDOW))
    p, q = prepared(soft, aliases).withColumn("win", window), prepared(ref, aliases).withColumn("win", window)
    p, q = stored(p), stored(q)
    names = ["id", "home", "away", "n_home", "n_away", "start", "w", "y_home", "y_away"]
    a = p.select("sport", "win", *by, *[F.col(c).alias(f"a_{c}") for c in names])
    b = q.select("sport", *[F.col(c).alias(f"b_{c}") for c in names], F.col("win").alias("_win"))
    timed = a.where("a_start IS NOT NULL").withColumn("bk", F.floor(F.col("a_start") / F.col("win"))).join(
        b.where("b_start IS NOT NULL").withColumn("bk", F.explode(F.array(*[F.floor(F.col("b_start") / F.col("_win")) + k for k in (-1, 0, 1)]))), ["sport", "bk"]
    ).where(F.abs(F.col("a_start") - F.col("b_start")) <= F.col("win")).drop("bk")
    a_h, b_h = side_bands(a, "a_id", "a_n_home", "a_n_away"), side_bands(b, "b_id", "b_n_home", "b_n_away")
    none_a, none_b = a.where("a_start IS NULL").select("a_id"), b.where("b_start IS NULL").select("b_id")
    met = a_h.join(none_a, "a_id", "left_semi").join(b_h, ["sport", "h"]).select("a_id", "b_id").unionByName(a_h.join(b_h.join(none_b, "b_id", "left_semi"), ["sport", "h"]).select("a_id", "b_id")).distinct()
    untimed = met.join(a, "a_id").join(b.drop("sport"), "b_id").select(*timed.columns)
    pairs = timed.unionByName(untimed)
    kinds = dict(pairs.dtypes)

    def score(batches):
        for x in batches:
            rows = [likeness(*n) for n in zip(*(x[c].fillna("") for c in ("a_n_home", "a_n_away", "b_n_home", "b_n_away")))]
            s = pd.DataFrame(rows, columns=["mean", "low", "flipped", "clash"], index=x.index)
            yield pd.concat([x[keep], s], axis=1)

    keep = ["sport", "win", *by, "a_id", "b_id", "a_start", "b_start", "a_w", "b_w", "a_y_home", "a_y_away", "b_y_home", "b_y_away"]
    # the join's partitions are few where the input is small, and scoring is dear
    s = pairs.repartition(F.xxhash64("a_id", "b_id")).mapInPandas(score, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", mean double, low double, flipped boolean, clash boolean")
    return _judged(s, by)


def _judged(s: DataFrame, by: tuple) -> DataFrame:
    gap = F.abs(F.col("a_start") - F.col("b_start"))
    same_youth = F.when(F.col("flipped"), (F.col("a_y_home") == F.col("b_y_away")) & (F.col("a_y_away") == F.col("b_y_home"))).otherwise((F.col("a_y_home") == F.col("b_y_home")) & (F.col("a_y_away") == F.col("b_y_away")))
    reason = (
        F.when(F.col("mean") < MEDIUM, "name").when(F.col("a_w") != F.col("b_w"), "gender").when(~same_youth, "youth").when((F.col("low") < LEAST_SIDE) | (F.col("clash") & (F.col("mean") < CONTRADICTION)), "wrong_fixture_guard")
        .when(gap.isNull() & (F.col("mean") < STRONG), "no_kickoff").when((F.col("mean") < STRONG) & (gap > WINDOW), "time")
    )
    return s.withColumns({"gap": gap, "reason": reason}).select("sport", *by, "a_id", "b_id", "mean", "low", "flipped", "gap", "reason")


def likenesses(names: fb.Names, ah: np.ndarray, aa: np.ndarray, bh: np.ndarray, ba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, weaker side, flipped) of likeness() of many fixtures at once, by the numbers of their names."""
    h, w, hs, ws = (names.likeness(i, j) for i, j in ((ah, bh), (aa, ba), (ah, ba), (aa, bh)))
    for strong, weak, i, j in ((h.copy(), w, aa, ba), (w.copy(), h, ah, bh)):
        for k in np.flatnonzero((strong >= STRONG) & (weak < MEDIUM) & (names.short[i] | names.short[j])):
            if tx.initialism(names.norms[i[k]], names.norms[j[k]]):
                weak[k] = MEDIUM
    flip = ((hs + ws) / 2 >= FLIP_MEAN) & ((hs + ws) / 2 >= (h + w) / 2 + FLIP_BY) & (np.minimum(hs, ws) >= FLIP_SIDE)
    one, two = np.where(flip, hs, h), np.where(flip, ws, w)
    return (one + two) / 2, np.minimum(one, two), flip


def _may_be_accepted(names: fb.Names, sides: tuple, untimed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the pairs (home, away of both) whose names allow that they are accepted, by bounds on the likeness of their sides, then by the likeness of those
    left; with their mean, weaker side and whether they are flipped."""
    ah, aa, bh, ba = sides
    h, w, hs, ws = (names.bound(i, j) + 1e-6 for i, j in ((ah, bh), (aa, ba), (ah, ba), (aa, bh)))
    straight = ((h + w) / 2 >= np.where(untimed, STRONG, MEDIUM)) & (np.minimum(h, w) >= LEAST_SIDE)
    flip = ((hs + ws) / 2 >= FLIP_MEAN) & (np.minimum(hs, ws) >= FLIP_SIDE)
    lifted = ((h >= STRONG) & (names.short[aa] | names.short[ba])) | ((w >= STRONG) & (names.short[ah] | names.short[bh]))
    left = np.flatnonzero(straight | flip | lifted)
    mean, low, flipped = likenesses(names, *(x[left] for x in sides))
    ok = (mean >= np.where(untimed[left], STRONG, MEDIUM)) & (low >= LEAST_SIDE)
    return left[ok], mean[ok], low[ok], flipped[ok]


def _clash(pairs: pd.DataFrame) -> list[bool]:
    """The clash of likeness() of pairs (n_home and n_away of both, mean, flipped), looked for only where nothing else rejects them."""
    near = (pairs["mean"] >= STRONG) | ((pairs["a_start"] - pairs["b_start"]).abs() <= WINDOW)
    open_ = (pairs["mean"] < CONTRADICTION) & (pairs["a_w"] == pairs["b_w"]) & near
    rows = zip(open_, pairs["flipped"], *(pairs[f"{s}_n_{c}"].fillna("") for s in "ab" for c in ("home", "away")))
    return [bool(o) and (_contradict(ah, ba if f else bh) or _contradict(aa, bh if f else ba)) for o, f, ah, aa, bh, ba in rows]


_contradict = lru_cache(500_000)(tx.contradict)


_GIVEN = ["id", "sport", "home", "away", "league", "start"]


def acceptable_pairs(soft: DataFrame, ref: DataFrame, by: tuple = (), aliases: DataFrame | None = None) -> DataFrame:
    """The pairs of scored_pairs() without a reject reason. They are found in blocks of compatible kickoffs by bounds, so no row is made of the others;
    where a kickoff is unknown, all of the sport are compared."""
    window = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv]), F.col("sport")), F.lit(WINDOW))
    names = ["id", "sport", "n_home", "n_away", "start", "w", "y_home", "y_away", "win"]
    both = soft.select(*_GIVEN, *by, F.lit(0).alias("_side")).unionByName(ref.select(*_GIVEN, *[F.lit(None).cast(dict(soft.dtypes)[c]).alias(c) for c in by], F.lit(1).alias("_side")))
    both = stored(prepared(both, aliases).withColumn("win", window).select(*names, *by, "_side"))
    p, q = (both.where(F.col("_side") == side).drop("_side") for side in (0, 1))
    kinds = dict(p.dtypes)
    told = {"sport": "sport", "win": "win", **{c: c for c in by}}
    sides, said = ["id", "start", "w", "y_home", "y_away"], ["n_home", "n_away"]

    def run(batches):
        for f in fb.whole_blocks(batches):
            i, j, mean, low, flipped = fb.candidates(f, _may_be_accepted, (STRONG, FLIP_MEAN, MEDIUM))
            a, b = f.iloc[i].reset_index(drop=True), f.iloc[j].reset_index(drop=True)
            out = pd.concat([a[list(told)], a[[*sides, *said]].add_prefix("a_"), b[[*sides, *said]].add_prefix("b_")], axis=1).assign(mean=mean, low=low, flipped=flipped)
            yield out.assign(clash=_clash(out)).drop(columns=[f"{s}_{c}" for s in "ab" for c in said])

    n = 4 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([f"{c} {kinds[c]}" for c in told] + [f"{s}_{c} {kinds[c]}" for s in "ab" for c in sides]) + ", mean double, low double, flipped boolean, clash boolean"
    s = fb.blocks(p, q).repartition(n, *fb.BLOCK).sortWithinPartitions(*fb.BLOCK, "_side").mapInPandas(run, schema)
    return _judged(s, by).where("reason IS NULL").drop("reason")


def _in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs that going through all by falling mean, ties by a_id and b_id, takes."""
    pairs = pairs.sort_values(["mean", "a_id", "b_id"], ascending=[False, True, True], ignore_index=True)
    gone_a, gone_b, took = set(), set(), []
    for k, (a, b) in enumerate(zip(pairs["a_id"].tolist(), pairs["b_id"].tolist())):
        if a not in gone_a and b not in gone_b:
            gone_a.add(a)
            gone_b.add(b)
            took.append(k)
    return pairs.iloc[took]


def one_to_one(pairs: DataFrame, by: tuple = ()) -> DataFrame:
    """Greedy matching by falling mean, ties by a_id and b_id. A b_id is taken once for each value of `by`, so sports and values of `by` are independent:
    each is gone through in one task. While one of them has over IN_ORDER pairs, there are rounds before it: the pairs that are best for both sides are
    taken and their rows retired, which with a total order gives the same."""
    order = [F.col("mean").desc(), "a_id", "b_id"]
    left, taken = stored(pairs), None
    while (left.groupBy("sport", *by).count().agg(F.max("count")).first()[0] or 0) > IN_ORDER:
        best = left.withColumns({"_a": F.row_number().over(Window.partitionBy("a_id").orderBy(*order)), "_b": F.row_number().over(Window.partitionBy(*by, "b_id").orderBy(*order))})
        now = stored(best.where("_a = 1 AND _b = 1").drop("_a", "_b"))
        taken = now if taken is None else taken.unionByName(now)
        left = stored(left.join(now.select("a_id"), "a_id", "left_anti").join(now.select(*by, "b_id"), [*by, "b_id"], "left_anti"))
    rest = left.groupBy("sport", *by).applyInPandas(_in_order, left.schema)
    return rest if taken is None else taken.unionByName(rest)


def match_fixtures(soft: DataFrame, ref: DataFrame, by: tuple = (), aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, unmatched): matches a_id, b_id, mean, flipped, gap; of every other soft row its best candidate, of those left over if there is
    one, and the reason why it was not taken ('taken' if the candidate went elsewhere, 'no_candidate' if there is none).

    soft, ref: id, sport, home, away, league, start. by: columns of soft, not null, such as its book, within which the matching is one-to-one. Empty tables give empty results; null names never match."""
    pairs = stored(scored_pairs(soft, ref, by, aliases))
    matched = stored(one_to_one(pairs.where("reason IS NULL").drop("reason"), by))
    gone = matched.select(*by, "b_id", F.lit(True).alias("_gone"))
    open_ = pairs.join(matched.select("a_id"), "a_id", "left_anti").join(gone, [*by, "b_id"], "left")
    best = open_.groupBy("a_id").agg(F.max_by(F.struct("b_id", "mean", "reason"), F.struct(F.col("_gone").isNull(), F.col("mean"), -F.col("b_id"))).alias("x")).select("a_id", "x.*", F.lit(True).alias("_some"))
    rest = soft.select(F.col("id").alias("a_id")).join(matched.select("a_id"), "a_id", "left_anti").join(best, "a_id", "left")
    reason = F.when(F.col("_some").isNull(), "no_candidate").otherwise(F.coalesce("reason", F.lit("taken")))
    return matched.select("a_id", "b_id", "mean", "flipped", "gap"), rest.select("a_id", "b_id", "mean", reason.alias("reason"))


def matches(soft: DataFrame, ref: DataFrame, by: tuple = (), aliases: DataFrame | None = None) -> DataFrame:
    """The matches of match_fixtures() alone, without the scores of the rejected pairs."""
    return stored(one_to_one(acceptable_pairs(soft, ref, by, aliases), by)).select("a_id", "b_id", "mean", "flipped", "gap")
