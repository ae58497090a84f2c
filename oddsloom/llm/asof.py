"""Pairing by nearest time: learned indexes over entity-time shards (problem 5).

Recordings are cut into shards by key ranges of (entity, time) taken from a sample of a few keys a shard; a hot entity simply owns many
shards. Per shard a piecewise-linear model predicts the position of a time among the entity's sorted recordings with an
error of at most EPSILON positions, a local search over that window finds the exact neighbours. A query whose tolerance
reaches over a shard's edge is also put to the neighbouring shard, so edges overlap; the best of at most three answers wins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.times import micros

EPSILON = 16
ROWS_PER_SHARD = 200_000
#: Rows sampled for the shard bounds, by a hash of the id: about this many, or so many a shard where that is more.
SAMPLE, A_SHARD = 100_000, 4


def piecewise_linear(times: np.ndarray, starts: np.ndarray, epsilon: int = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Segments [start, end) of sorted positions, refined from entity runs until the chord's error is within epsilon."""
    n = len(times)
    bounds = np.append(starts, n)
    todo_s, todo_e = bounds[:-1], bounds[1:]
    done = []
    while len(todo_s):
        fits = todo_e - todo_s <= epsilon + 1
        done.append((todo_s[fits], todo_e[fits]))
        s, e = todo_s[~fits], todo_e[~fits]
        if not len(s):
            break
        lengths = e - s
        which = np.repeat(np.arange(len(s)), lengths)
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = s[which] + offset
        span = np.maximum(times[e - 1] - times[s], 1)
        error = np.abs((times[at] - times[s][which]) / span[which] * (lengths - 1)[which] - offset)
        worst = np.maximum.reduceat(error, np.cumsum(lengths) - lengths)
        ok = worst <= epsilon
        done.append((s[ok], e[ok]))
        s, e = s[~ok], e[~ok]
        mid = (s + e) // 2
        todo_s, todo_e = np.concatenate([s, mid]), np.concatenate([mid, e])
    s, e = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def nearest(entity: np.ndarray, time: np.ndarray, ident: np.ndarray, q_entity: np.ndarray, q_time: np.ndarray) -> np.ndarray:
    """Position of the recording of the same entity that is nearest to each query, -1 without one.

    Recordings come sorted by entity, time, id. Equal distances: the earlier time, then the smaller id."""
    out = np.full(len(q_entity), -1, dtype=np.int64)
    if not len(entity) or not len(q_entity):
        return out
    names, first = np.unique(entity, return_index=True)
    ends = np.append(first[1:], len(entity))
    code = np.searchsorted(names, q_entity)
    known = np.flatnonzero((code < len(names)) & (names[np.minimum(code, len(names) - 1)] == q_entity))
    if not len(known):
        return out
    code, t = code[known], q_time[known]
    s, e = piecewise_linear(time, first)
    # the model: the last segment of the entity that starts at or before the time
    of_seg = np.searchsorted(first, s, side="right") - 1
    seg = np.searchsorted(of_seg + 1j * time[s].astype(np.float64), code + 1j * t.astype(np.float64), side="right") - 1
    lo_e, hi_e = first[code], ends[code]
    inside = (seg >= 0) & (of_seg[np.maximum(seg, 0)] == code)
    seg = np.maximum(seg, 0)
    span = np.maximum(time[e[seg] - 1] - time[s[seg]], 1)
    guess = np.floor((t - time[s[seg]]) / span * (e[seg] - 1 - s[seg])).astype(np.int64) + s[seg]
    # local search: the last position with time <= t within the error bound
    lo = np.clip(guess - EPSILON - 2, s[seg], e[seg] - 1)
    hi = np.clip(guess + EPSILON + 2, s[seg], e[seg] - 1)
    while (todo := hi > lo).any():
        mid = (lo + hi + 1) // 2
        before = time[mid] <= t
        lo, hi = np.where(todo & before, mid, lo), np.where(todo & ~before, mid - 1, hi)
    left = np.where(inside, lo, -1)
    right = np.where(inside, lo + 1, lo_e)
    right = np.where(right < hi_e, right, -1)
    run = np.flatnonzero(np.append(True, (entity[1:] != entity[:-1]) | (time[1:] != time[:-1])))
    left = np.where(left >= 0, run[np.searchsorted(run, np.maximum(left, 0), side="right") - 1], -1)
    far = np.iinfo(np.int64).max
    d_left = np.where(left >= 0, t - time[left], far)
    d_right = np.where(right >= 0, time[right] - t, far)
    out[known] = np.where(d_left <= d_right, left, right)
    return out


def nearest_recordings(recordings: DataFrame, queries: DataFrame, *, entity: str, time: str, ident: str, anchor: str, q_time: str, tolerance: str) -> DataFrame:
    """For each query (entity, anchor, q_time, tolerance in microseconds) the nearest recording of its entity.

    Result: entity, anchor and the recording's id, all named as in the input; no row where nothing lies within the
    tolerance (limits included). Rows without entity or time take no part. Ties go to the earlier recording, then to the
    smaller id. Other columns of either table, whatever their names, are ignored. Entity ids are whole numbers below 2**53.
    Queries must be unique in (entity, anchor)."""
    spark = recordings.sparkSession
    rec = recordings.select(F.col(entity).cast("long").alias("e"), micros(recordings, time).alias("t"), F.col(ident).alias("i")).where("e IS NOT NULL AND t IS NOT NULL AND i IS NOT NULL")
    ask = queries.select(F.col(entity).cast("long").alias("e"), F.col(anchor).alias("a"), micros(queries, q_time).alias("t"), F.col(tolerance).cast("long").alias("tol")).where("e IS NOT NULL AND t IS NOT NULL")
    rows = recordings.count()
    n = min(max(rows // ROWS_PER_SHARD + 1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), max(1, rows // 1000))
    every = max(1, rows // max(SAMPLE, A_SHARD * n))
    keys = rec.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0).select("e", "t").toPandas()
    keys = np.unique(keys["e"].to_numpy(np.float64) + 1j * keys["t"].to_numpy(np.float64))
    step = max(1, len(keys) // n)
    bounds = spark.sparkContext.broadcast(keys[step::step])

    def place(batches):
        for b in batches:
            yield b.assign(p=np.searchsorted(bounds.value, b["e"].to_numpy(np.float64) + 1j * b["t"].to_numpy(np.float64), side="right"))

    def put(batches):
        for b in batches:
            e, t, tol = (b[c].to_numpy(np.float64) for c in ("e", "t", "tol"))
            at, lo, hi = (np.searchsorted(bounds.value, e + 1j * x, side="right") for x in (t, t - tol, t + tol))
            for shift, reach in ((-1, lo < at), (0, at == at), (1, hi > at)):
                if reach.any():
                    yield b[reach].assign(p=at[reach] + shift)

    def answer(key, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        r = r.iloc[np.lexsort((r["i"], r["t"], r["e"]))]
        re, rt, ri = r["e"].to_numpy(), r["t"].to_numpy(), r["i"].to_numpy()
        at = nearest(re, rt, ri, q["e"].to_numpy(), q["t"].to_numpy())
        q = q.assign(at=at)[at >= 0]
        q["rt"], q["i"] = rt[q["at"]], ri[q["at"]]
        q["d"] = (q["rt"] - q["t"]).abs()
        return q.loc[q["d"] <= q["tol"], ["e", "a", "d", "rt", "i"]]

    kinds = dict(ask.dtypes)["a"], dict(rec.dtypes)["i"]
    placed = rec.mapInPandas(place, f"e long, t long, i {kinds[1]}, p long").groupBy("p")
    put_to = ask.mapInPandas(put, f"e long, a {kinds[0]}, t long, tol long, p long").groupBy("p")
    found = placed.cogroup(put_to).applyInPandas(answer, f"e long, a {kinds[0]}, d long, rt long, i {kinds[1]}")
    best = found.groupBy("e", "a").agg(F.min(F.struct("d", "rt", "i")).alias("b"))
    return best.select(F.col("e").alias(entity), F.col("a").alias(anchor), F.col("b.i").alias(ident))
