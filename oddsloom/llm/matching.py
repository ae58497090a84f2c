"""Matching records of several sources without keys (problem 6).

Candidates share a MinHash band over the q-grams of both parties' names and a block of time. Each pair is described by the
likeness of the names in the better orientation, of the league and of the times; a logistic model is fitted to weak labels
(rules that are sure of some pairs and silent on the rest) on a bounded sample, and its scores are calibrated by isotonic
regression on held-out labels. A second round labels the pairs on which the rules were silent by what the first one
found: a third record that matches both speaks for a pair, other partners in each other's source speak against it; and the
final confidence joins the model's probability with that of the best third record. Marks of women's, youth and reserve sides, in the names or the league, must agree."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.times import micros
from oddsloom.llm.logistic import fit_logistic
from oddsloom.llm.minhash import Bands, bands_for, meet
from oddsloom.llm.names import common_words
from oddsloom.llm.nametext import fold, monge_elkan, parse, side_marks
from oddsloom.plans.materialize import table as stored

TUNE_AT, RECALL = 0.45, 0.98
#: Records whose times are at most this far apart are compared (seconds); blocks are one day wide.
REACH, BLOCK = 14 * 3600, 86400
#: The model is fitted to at most about this many weakly labelled pairs, drawn by a hash of the pair.
LABELLED = 20_000
FEATURES = ["me_low", "me_high", "dice_low", "dice_high", "left", "gap", "gap_unknown", "seen", "league", "league_unknown", "initials"]
_WORDS = re.compile(r"[^\W_]+")


@lru_cache(200_000)
def _pairs_of(words: tuple[str, ...]) -> frozenset:
    return frozenset(f"#{w}#"[i : i + 2] for w in words for i in range(len(w) + 1))


@lru_cache(500_000)
def _dice(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    x, y = _pairs_of(a), _pairs_of(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


@lru_cache(500_000)
def _me(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int]:
    return monge_elkan(a, b)


@lru_cache(100_000)
def league_likeness(a: str, b: str) -> float:
    """Share of the words of the shorter league name that the longer one has, also abbreviated."""
    x, y = (sorted(set(_WORDS.findall(fold(s)))) for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 0.5
    initials = "".join(w[0] for w in y)
    hit = sum(any(w == v or (len(w) >= 2 and len(v) >= 2 and (v.startswith(w) or w.startswith(v))) or (len(w) <= 3 and w[0] == v[0] and all(c in v for c in w)) for v in y) or (len(w) > 1 and w in initials) for w in x)
    return hit / len(x)


def describe(p: pd.DataFrame, people: list[str]) -> pd.DataFrame:
    """The features of pairs: columns domain, ha, aa, hb, ab (names), la, lb (leagues), ta, tb (times, seconds, NaN unknown), sa, sb (last seen)."""
    rows = []
    for d, ha, aa, hb, ab, la, lb in zip(p["domain"], p["ha"], p["aa"], p["hb"], p["ab"], p["la"], p["lb"]):
        person = d in people
        x, y, u, v = (parse(n, person)[1] for n in (ha, aa, hb, ab))
        best = None
        for first, second in (((x, u), (y, v)), ((x, v), (y, u))):
            m1, m2, d1, d2 = _me(*first), _me(*second), _dice(*first), _dice(*second)
            got = (min(m1[0], m2[0]) + min(d1, d2), m1, m2, d1, d2, sum(len(w) == 1 for pair in (first, second) for side in pair for w in side))
            best = got if best is None or got[0] > best[0] else best
        _, m1, m2, d1, d2, ini = best
        lk = league_likeness(la, lb) if la and lb else np.nan
        rows.append((min(m1[0], m2[0]), max(m1[0], m2[0]), min(d1, d2), max(d1, d2), m1[1] + m2[1], lk, ini))
    f = pd.DataFrame(rows, columns=["me_low", "me_high", "dice_low", "dice_high", "left", "league", "initials"], index=p.index)
    gap = (p["ta"] - p["tb"]).abs() / 3600
    f["hours"] = gap
    f["gap_unknown"] = gap.isna().astype(float)
    f["gap"] = np.log1p(gap).fillna(0.0)
    f["seen"] = np.log1p((p["sa"] - p["sb"]).abs() / 3600).fillna(1.0)
    f["league_unknown"] = f["league"].isna().astype(float)
    f["league"] = f["league"].fillna(0.5)
    return f


def weak_label(f: pd.DataFrame) -> np.ndarray:
    """1, 0, or -1 where no rule speaks."""
    out = np.full(len(f), -1)
    h = f["hours"]
    out[(f["dice_low"] < 0.3) & (f["me_low"] == 0)] = 0
    out[(h > 13) | ((f["gap_unknown"] > 0) & (f["seen"] > np.log1p(20)))] = 0
    out[(f["dice_low"] > 0.9) & (h <= 3)] = 1
    out[(f["dice_high"] > 0.95) & (f["dice_low"] > 0.4) & (f["me_low"] > 0.8) & (h <= 0.25)] = 1
    out[(f["dice_low"] > 0.9) & (f["gap_unknown"] > 0) & (f["seen"] < np.log1p(6))] = 1
    out[(f["dice_high"] > 0.95) & (f["dice_low"] > 0.9) & (h <= 6)] = 1
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a rising step function from score to probability, smoothed by one virtual case of each class a pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v, n, s = pools.pop()
            pools[-1] = [pools[-1][0] + v, pools[-1][1] + n, s]
    return np.array([p[2] for p in pools]), np.maximum.accumulate(np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools]))


def prepared(records: DataFrame, people: list[str]) -> DataFrame:
    """The records that take part, with mark (of the side), hk and ak (keys of the names), t, s and at (seconds)."""
    r = records.where("id IS NOT NULL AND source IS NOT NULL AND domain IS NOT NULL AND home IS NOT NULL AND away IS NOT NULL")
    r = r.select("id", "source", "domain", "home", "away", "league", (micros(records, "start_time") / 1e6).alias("t"), (micros(records, "last_seen") / 1e6).alias("s")).withColumn("at", F.coalesce("t", F.col("s") + 3600)).where("at IS NOT NULL")

    def parsed(batches):
        for b in batches:
            rows = [(parse(h, d in people), parse(a, d in people), "" if d in people else side_marks(lg)) for d, h, a, lg in zip(b["domain"], b["home"], b["away"], b["league"])]
            tags = [sorted(set(re.findall("w|r|u..", h[0] + a[0] + m))) for h, a, m in rows]
            yield b.assign(mark=["".join(t) for t in tags], hk=[" ".join(x[0][1]) for x in rows], ak=[" ".join(x[1][1]) for x in rows])

    schema = ", ".join(f"{c} {t}" for c, t in r.dtypes)
    return stored(r.repartition("id").mapInPandas(parsed, f"{schema}, mark string, hk string, ak string").where("hk <> '' AND ak <> ''"))


def candidates(r: DataFrame) -> DataFrame:
    """(id_a, id_b, src_a, src_b): pairs of prepared records of two sources, id_a < id_b, that share a band and a mark and are within REACH.

    Cells are a band's hash, mark and day; hot ones (a cup's name on a full day) are spread over tasks."""
    common = common_words(r.select("domain", F.explode(F.array("hk", "ak")).alias("key")).distinct())
    shared = r.sparkSession.sparkContext.broadcast(common)
    bands = Bands(*bands_for(TUNE_AT, RECALL))

    def signed(batches):
        for b in batches:
            split = [(f"{h} {a}".split(" "), shared.value.get(d, frozenset())) for d, h, a in zip(b["domain"], b["hk"], b["ak"])]
            yield bands.rows(b.drop(columns=["hk", "ak"]), [[w for w in words if len(w) > 1 and w not in usual] or words for words, usual in split])

    kind = dict(r.dtypes)["id"]
    sig = r.select("id", "source", "domain", "mark", "hk", "ak", "at").mapInPandas(signed, f"id {kind}, source string, domain string, mark string, at double, band int, h long")
    sig = stored(sig.select("id", "source", "at", F.xxhash64("domain", "mark", "band", "h").alias("bucket"), F.xxhash64("domain", "mark").alias("kind")))
    block = lambda c: F.floor(c / BLOCK)
    side = lambda x: [F.col("id").alias(f"id_{x}"), F.col("source").alias(f"src_{x}"), F.col("at").alias(f"at_{x}"), F.col("kind").alias(f"kind_{x}")]
    cell = lambda day: F.xxhash64("bucket", day).alias("cell")
    left = sig.select(*side("a"), cell(block(F.col("at"))))
    right = sig.select(*side("b"), F.explode(F.array_distinct(F.array(block(F.col("at") - REACH), block(F.col("at")), block(F.col("at") + REACH)))).alias("day"), "bucket").withColumn("cell", cell(F.col("day"))).drop("bucket", "day")
    near = (F.col("id_a") < F.col("id_b")) & (F.col("src_a") != F.col("src_b")) & (F.col("kind_a") == F.col("kind_b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= REACH)
    return meet(left, right, ["cell"], "id_a").where(near).select("id_a", "id_b", "src_a", "src_b").distinct()


def match(records: DataFrame, *, people: list[str]) -> DataFrame:
    """(id_a, id_b, confidence): pairs of records of two different sources that describe the same meeting, id_a < id_b, with the
    calibrated probability; all candidates are given, so keep those above the confidence wanted.

    records: id, source, domain, home, away, league, start_time, last_seen. A missing start_time is stood in for by last_seen
    in the blocking; records without either, without both names (null or without a letter) or without source or domain take
    no part. With no labelled pair of both classes, the plain mean of the likeness features stands for the confidence."""
    r = prepared(records, people)
    pairs, kinds = candidates(r), dict(r.dtypes)
    side = lambda x: r.select(F.col("id").alias(f"id_{x}"), *(["domain"] if x == "a" else []), F.col("home").alias(f"h{x}"), F.col("away").alias(f"a{x}"), F.col("league").alias(f"l{x}"), F.col("t").alias(f"t{x}"), F.col("s").alias(f"s{x}"))
    wide = pairs.join(side("a"), "id_a").join(side("b"), "id_b")

    def features(batches):
        for b in batches:
            f = describe(b, people)
            yield pd.concat([b[["id_a", "id_b", "src_a", "src_b"]], f[FEATURES], pd.Series(weak_label(f), index=b.index, name="label")], axis=1)

    kind = kinds["id"]
    told = stored(wide.mapInPandas(features, f"id_a {kind}, id_b {kind}, src_a string, src_b string, " + ", ".join(f"{c} double" for c in FEATURES) + ", label int"))
    strong = stored(scores(told, fitted(labelled_sample(told))).where("confidence >= 0.5"))
    both = strong.select(F.col("id_a").alias("c"), F.col("id_b").alias("x"), F.col("src_b").alias("src"), "confidence").unionByName(strong.select(F.col("id_b").alias("c"), F.col("id_a").alias("x"), F.col("src_a").alias("src"), "confidence"))
    one, two = (both.select("c", F.col("x").alias(f"id_{x}"), F.col("src").alias(f"src_{x}"), F.col("confidence").alias(f"c{x}")) for x in "ab")
    third = stored(one.join(two, "c").where("id_a < id_b AND src_a <> src_b").groupBy("id_a", "id_b").agg(F.max(F.col("ca") * F.col("cb")).alias("third")))
    taken = both.select(F.col("c").alias("id"), "src").distinct().withColumn("taken", F.lit(True))
    again = told.join(third, ["id_a", "id_b"], "left")
    for x, y in ("ab", "ba"):
        again = again.join(taken.select(F.col("id").alias(f"id_{x}"), F.col("src").alias(f"src_{y}"), F.col("taken").alias(f"taken_{x}")), [f"id_{x}", f"src_{y}"], "left")
    silent = F.col("label") < 0
    again = stored(again.withColumn("label", F.when(silent & F.col("third").isNotNull(), 1).when(silent & F.col("taken_a") & F.col("taken_b"), 0).otherwise(F.col("label"))))
    final = scores(again, fitted(labelled_sample(again))).join(third, ["id_a", "id_b"], "full")
    return final.select("id_a", "id_b", (1 - (1 - F.coalesce("confidence", F.lit(0.0))) * (1 - F.coalesce("third", F.lit(0.0)))).alias("confidence"))


def labelled_sample(told: DataFrame) -> pd.DataFrame:
    """At most about LABELLED rows, both classes alike if there are enough, drawn by a hash of the pair."""
    n = {row["label"]: row["count"] for row in told.groupBy("label").count().collect()}
    some = [told.where((F.col("label") == label) & (F.pmod(F.xxhash64("id_a", "id_b"), F.lit(max(1, 2 * n.get(label, 0) // LABELLED))) == 0)) for label in (0, 1)]
    return some[0].unionByName(some[1]).select("id_a", "id_b", "label", *FEATURES).toPandas().sort_values(["id_a", "id_b"], ignore_index=True)


def scores(told: DataFrame, model) -> DataFrame:
    kind = dict(told.dtypes)["id_a"]

    def run(batches):
        for b in batches:
            yield b[["id_a", "id_b", "src_a", "src_b"]].assign(confidence=model(b[FEATURES].to_numpy(np.float64)))

    return told.select("id_a", "id_b", "src_a", "src_b", *FEATURES).mapInPandas(run, f"id_a {kind}, id_b {kind}, src_a string, src_b string, confidence double")


def fitted(known: pd.DataFrame):
    """The calibrated model of a labelled sample: half of the rows fit the weights, the other half the calibration."""
    x, y = known[FEATURES].to_numpy(np.float64), known["label"].to_numpy()
    if len(set(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return lambda z: z[:, :4].mean(axis=1) * (z[:, 5] < np.log1p(6))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    half = np.arange(len(x)) % 2 == 0
    w = fit_logistic((x[half] - mean) / scale, y[half])
    score = lambda z: np.column_stack([(z - mean) / scale, np.ones(len(z))]) @ w
    knots, values = isotonic(score(x[~half]), y[~half])
    return lambda z: np.interp(score(z), knots, values)
