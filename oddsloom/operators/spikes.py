"""Implausible readings in price series: a Kalman filter per source (problem 1).

Each series follows a local-level model in log price whose variances belong to its source. A reading whose standardised
innovation is beyond the threshold is withheld from the filter; if the series is back within a few readings the withheld
ones were a spike, otherwise the level has moved and the filter starts anew there. Where the variance of the innovations
vanishes for far longer than is usual for the source, the price is stuck: that variance is nil over a stretch if and only if its readings
that are not withheld are equal, so the test is the length of the run of equal ones. Readings that cannot be prices are flagged outright.

The readings are sorted by series and time over range shards, so one hot series spans many shards. The filter runs in lock-step over all
series of a shard. What a shard has to know of the others is of fixed size: the last few readings before it and the first few after it, if
they belong to its own first and last series, from which the filter's state follows (it forgets a start in far fewer readings), and
the value and length of the runs at the shards' edges, which are added up over any number of shards, so that a run is
measured exactly however long it is."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.plans.materialize import table as stored
from oddsloom.plans.ranges import per_shard, shards

#: Width of the bins, in ln(size of a move), of the per-source histograms; the statistics are exact up to this width.
BIN = 0.05
#: Longest block of one series that is filtered in one lane of the lock-step.
BLOCK = 2048


@dataclass(frozen=True)
class SpikeParams:
    """threshold: of the standardised innovation. longest: readings a spike may last. back: share of the mean height
    of a spike within which the series counts as returned; back_far: the same where that return is itself far from the old
    level, so that the level moved meanwhile. noise: measurement noise as a share of the source's usual move.
    stuck_tail: chance, by the source's own habit of repeating a price, below which a still stretch is stuck, and
    least_stuck the readings it must have in any case. window, after: readings known of the shards before and after; the filter's
    state forgets its start by the factor 1 - gain a reading, which is about noise squared."""

    threshold: float = 6.3
    longest: int = 3
    back: float = 0.5
    back_far: float = 0.3
    noise: float = 0.1
    stuck_tail: float = 1e-7
    least_stuck: int = 8
    window: int = 64
    after: int = 8


def _lockstep(x: np.ndarray, sigma: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: SpikeParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags per step, and per series (start, end) its final level and the last reading where a run was left open."""
    flags = np.zeros(len(x), dtype=bool)
    level = np.full(len(starts), np.nan)
    other = np.full(len(starts), np.nan)
    lengths = ends - starts
    for size in np.unique(np.ceil(np.log2(np.maximum(lengths, 1)))):
        lane = np.flatnonzero(np.ceil(np.log2(np.maximum(lengths, 1))) == size)
        s, n = starts[lane], lengths[lane]
        sd1 = sigma[s]
        q, r = sd1**2, (p.noise * sd1) ** 2
        m, var = x[s].copy(), r.copy()
        run, height = np.zeros(len(lane), dtype=np.int64), np.zeros(len(lane))
        for t in range(1, int(n.max())):
            on = t < n
            at = np.where(on, s + t, s)
            v = x[at]
            ahead = var + q
            spread = np.sqrt(ahead + r)
            innovation = v - m
            size_of = np.abs(innovation)
            far = on & (size_of > p.threshold * spread)
            near = on & ~far
            mean = height / np.maximum(run, 1)
            ended = (run > 0) & ((near & on) | (far & (size_of <= p.back_far * mean)))
            far, near = far & ~ended, near | ended
            if ended.any():
                back = ended & (size_of <= p.back * mean)
                for j in range(1, p.longest + 1):
                    hit = back & (run >= j)
                    flags[at[hit] - j] = True
                moved = ended & (~back | (size_of > p.threshold * spread))
            else:
                moved = ended
            gain = np.where(near, ahead / (ahead + r), 0.0)
            m = np.where(moved, v, m + gain * innovation)
            var = np.where(moved, r, np.where(near, (1 - gain) * ahead, var))
            run = np.where(far, run + 1, np.where(near, 0, run))
            height = np.where(far, height + size_of, np.where(near, 0.0, height))
            lasting = far & (run > p.longest)
            if lasting.any():
                m, var = np.where(lasting, v, m), np.where(lasting, r, var)
                run, height = np.where(lasting, 0, run), np.where(lasting, 0.0, height)
        level[lane] = m
        other[lane] = np.where(run > 0, x[s + n - 1], np.nan)
    return flags, level, other


@dataclass
class _Edge:
    """Readings of one series (times and values) that lie in other shards."""

    t: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _readings(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Impossible rows; rows that are usable; those of them that are readings of a series; values."""
    v, null = pdf["v"].to_numpy(np.float64), pdf["null"].to_numpy(bool)
    with np.errstate(invalid="ignore"):
        impossible = ~null & ~(np.isfinite(v) & (v > 1))
    usable = ~null & ~impossible
    return impossible, usable, np.flatnonzero(usable & (pdf["probe"].to_numpy() == 0)), v


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    if not len(columns[0]):
        return np.zeros(0, dtype=bool)
    out = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        out |= c[1:] != c[:-1]
    return np.append(True, out)


def edge_readings(pdf: pd.DataFrame, p: SpikeParams) -> pd.DataFrame:
    """One row: the shard's first and last series, its first readings of the former and last of the latter, repeats left out."""
    rows, v = _readings(pdf)[2:]
    key, t = pdf["k"].to_numpy(), pdf["t"].to_numpy()
    rows = rows[_fresh(key[rows], t[rows], v[rows])]
    head = rows[: np.searchsorted(key[rows], key[0], side="right")][: p.after]
    tail = rows[np.searchsorted(key[rows], key[-1], side="left") :][-p.window :]
    return pd.DataFrame({"pid": [pdf["_pid"].iloc[0]], "first_k": [key[0]], "last_k": [key[-1]], "ht": [t[head]], "hv": [v[head]], "tt": [t[tail]], "tv": [v[tail]]})


def neighbours(meta: pd.DataFrame, p: SpikeParams) -> dict[int, tuple[_Edge, _Edge]]:
    """By shard what is known before its first series and after its last one."""
    known = list(meta.sort_values("pid").itertuples())
    out = {}
    for pos, own in enumerate(known):
        sides = []
        for step, want, near, far, t, v, most in ((-1, own.first_k, "last_k", "first_k", "tt", "tv", p.window), (1, own.last_k, "first_k", "last_k", "ht", "hv", p.after)):
            times, values, j = [], [], pos + step
            while 0 <= j < len(known) and getattr(known[j], near) == want and sum(map(len, times)) < most:
                times.insert(0 if step < 0 else len(times), np.asarray(getattr(known[j], t), dtype=np.int64))
                values.insert(0 if step < 0 else len(values), np.asarray(getattr(known[j], v), dtype=np.float64))
                if getattr(known[j], far) != want:
                    break
                j += step
            cut = slice(-most, None) if step < 0 else slice(0, most)
            sides.append(_Edge(np.concatenate(times)[cut], np.concatenate(values)[cut]) if times else _Edge())
        if len(sides[0].t) or len(sides[1].t):
            out[int(own.pid)] = sides[0], sides[1]
    return out


def filter_shard(pdf: pd.DataFrame, edges: tuple[_Edge, _Edge], sigma: dict, least: dict, p: SpikeParams) -> pd.DataFrame:
    """Rows (kind, tab, row_id, wait, k, v, n) of a sorted shard. kind 'flag': a row that is implausible. 'wait': a row of a run at the
    shard's edge that is implausible if the whole run, named by wait, has n readings. 'run': the runs at the shard's edges with
    their value v and number n of readings; H the first, T the last (H, too, if there is only one)."""
    impossible, usable, rows, v = _readings(pdf)
    before, after = edges
    key, t = pdf["k"].to_numpy(), pdf["t"].to_numpy()
    src = pdf["src"].fillna("").to_numpy()
    sig_of = pd.Series(src).map(sigma).to_numpy(np.float64)
    least_of = pd.Series(src).map(least).to_numpy(np.float64)
    flag, wait = impossible.copy(), np.full(len(pdf), "", dtype=object)
    runs: list[tuple] = []
    nb, na = len(before.t), len(after.t)
    if len(rows) or nb or na:
        k = np.concatenate([np.full(nb, key[0]), key[rows], np.full(na, key[-1])])
        val = np.concatenate([before.v, v[rows], after.v])
        sg = np.concatenate([np.full(nb, sig_of[0]), sig_of[rows], np.full(na, sig_of[-1])])
        fresh = _fresh(k, np.concatenate([before.t, t[rows], after.t]), val)
        step_of = (np.cumsum(fresh) - 1)[nb : nb + len(rows)]
        first = np.flatnonzero(fresh)
        k, val, sg, mine = k[first], val[first], sg[first], (first >= nb) & (first < nb + len(rows))
        x = np.log(val)
        starts = np.flatnonzero(_fresh(k))
        ends = np.append(starts[1:], len(k))
        # long series run as blocks that overlap by the window
        b_start, b_end, b_from, b_to = [], [], [], []
        long = ends - starts > BLOCK
        b_start.append(starts[~long]), b_end.append(ends[~long]), b_from.append(starts[~long]), b_to.append(ends[~long])
        for s, e in zip(starts[long], ends[long]):
            cut = np.arange(s, e, BLOCK)
            to = np.append(cut[1:], e)
            b_start.append(np.maximum(cut - p.window, s)), b_end.append(np.minimum(to + p.after, e)), b_from.append(cut), b_to.append(to)
        bs, be, bf, bt = (np.concatenate(y) for y in (b_start, b_end, b_from, b_to))
        # blocks overlap, so each runs on its own copy
        lengths = be - bs
        at = np.cumsum(lengths) - lengths
        flat = np.repeat(bs - at, lengths) + np.arange(lengths.sum())
        spiky, level, other = _lockstep(x[flat], sg[flat], at, at + lengths, p)
        own = (flat >= np.repeat(bf, lengths)) & (flat < np.repeat(bt, lengths))
        spikes = np.zeros(len(x), dtype=bool)
        spikes[flat[own]] = spiky[own]
        # newest prices against the end of their series
        probes = np.flatnonzero(usable & (pdf["probe"].to_numpy() == 1))
        last = np.flatnonzero(be == ends[np.searchsorted(starts, bs, side="right") - 1])
        last = last[np.argsort(bs[last])]
        of = np.searchsorted(k[bs[last]], key[probes])
        there = (of < len(last)) & (k[bs[last]][np.minimum(of, len(last) - 1)] == key[probes])
        probes, of = probes[there], last[of[there]]
        now = np.log(v[probes])
        gap = np.fmin(np.abs(now - level[of]), np.abs(now - other[of]))
        flag[probes] = gap > p.threshold * sig_of[probes] * np.sqrt(1 + 2 * p.noise**2)
        # vanished variance: runs of equal prices among the readings that are not spikes
        flag[rows] |= spikes[step_of]
        kept = np.flatnonzero(~spikes & mine)
        waits = np.full(len(x), "", dtype=object)
        if nb:
            waits[~mine] = "R"  # repeats of a reading in the shard before
        if len(kept):
            run = np.cumsum(_fresh(k[kept], val[kept])) - 1
            count = np.bincount(run)
            long_enough = np.zeros(len(x))
            long_enough[kept] = count[run]
            flag[rows] |= (long_enough[step_of] >= least_of[rows]) & ~spikes[step_of] & mine[step_of]
            if na and k[kept[-1]] == key[-1]:
                waits[kept[run == run[-1]]] = "T" if run[-1] else "H"
            if nb and k[kept[0]] == key[0]:
                waits[kept[run == 0]] = "H"
            runs = [("H", k[kept[0]], val[kept[0]], count[0])] + ([("T", k[kept[-1]], val[kept[-1]], count[-1])] if run[-1] else [])
        wait[rows] = np.where(spikes[step_of], "", waits[step_of])
    flags, waiting = np.flatnonzero(flag), np.flatnonzero(~flag & (wait != "") & np.isfinite(least_of))
    tab, ids = pdf["tab"].to_numpy(), pdf["id"].to_numpy()
    return pd.DataFrame({
        "kind": ["flag"] * len(flags) + ["wait"] * len(waiting) + ["run"] * len(runs), "pid": pdf["_pid"].iloc[0],
        "tab": [*tab[flags], *tab[waiting], *[None] * len(runs)], "row_id": pd.array([*ids[flags], *ids[waiting], *[None] * len(runs)], dtype="Int64"),
        "wait": [*[None] * len(flags), *wait[waiting], *[r[0] for r in runs]], "k": pd.array([*[None] * len(flags), *key[waiting], *[r[1] for r in runs]], dtype="Int64"),
        "v": [*[None] * (len(flags) + len(waiting)), *[r[2] for r in runs]], "n": [*[None] * len(flags), *least_of[waiting], *[float(r[3]) for r in runs]],
    }).astype({"v": "float64", "n": "float64"})


def whole_runs(runs: list[tuple[int, str, int, float, float]]) -> list[tuple[int, str, int, float]]:
    """Runs at the shards' edges (pid, H or T, series, value, readings) to (pid, H, T or R, series, readings of the whole run); R is the run
    that ends before the shard."""
    totals: list[list] = []
    named: list[tuple[int, str, int]] = []
    seen = None
    for pid, mark, k, v, n in sorted(runs, key=lambda r: (r[0], r[1])):
        other = pid != seen  # within a shard, first and last run are two
        if other and totals:
            named.append((pid, "R", len(totals) - 1))
        seen = pid
        if other and totals and totals[-1][:2] == [k, v]:
            totals[-1][2] += n
        else:
            totals.append([k, v, n])
        named.append((pid, mark, len(totals) - 1))
    return [(pid, mark, totals[i][0], totals[i][2]) for pid, mark, i in named]


def implausible(readings: DataFrame, *, params: SpikeParams = SpikeParams(), rows: int | None = None) -> DataFrame:
    """Rows of `readings` that are impossible, belong to a spike or to a stuck stretch.

    Input columns: tab (string), row_id (long), series (long), source (string), t (microseconds), v (double), probe (0 for
    a reading of the series, 1 for a newest price that is only held against the end of its series). Output: tab, row_id.

    A null value never counts and interrupts nothing; a reading without time sorts first; one without source is judged as
    the source ''. Repeated deliveries (same series, time and value) are one step and share their flag. A spike needs
    readings on both sides; a far reading at either end of a series is not one. A series of which there are no readings
    flags only impossible probes. A source that has never moved a price has no habit by which one could be stuck. An empty table gives
    an empty result."""
    work = readings.select(
        F.col("series").alias("k"), F.col("source").alias("src"), F.coalesce("t", F.lit(-(2**62))).alias("t"),
        F.col("v").isNull().alias("null"), F.coalesce("v", F.lit(0.0)).alias("v"), "probe", F.col("row_id").alias("id"), "tab",
    )
    sorted_ = shards(work, ["k", "probe", "t", "v", "id"], rows=rows)
    meta = per_shard(sorted_, lambda pdf: edge_readings(pdf, params), "pid int, first_k long, last_k long, ht array<long>, hv array<double>, tt array<long>, tv array<double>").toPandas()
    context = readings.sparkSession.sparkContext.broadcast(neighbours(meta, params))  # at most window + after readings a shard
    nothing = _Edge(), _Edge()

    def moves(pdf: pd.DataFrame) -> pd.DataFrame:
        """Histogram of the sizes of moves by source, each move counted where its later reading lies."""
        rows, v = _readings(pdf)[2:]
        before = context.value.get(int(pdf["_pid"].iloc[0]), nothing)[0]
        lead = min(1, len(before.t))
        k, t = (np.append(b, pdf[c].to_numpy()[rows]) for b, c in ((np.full(lead, pdf["k"].iloc[0]), "k"), (before.t[-1:], "t")))
        x = np.log(np.append(before.v[-1:], v[rows]))
        src = np.append(np.full(lead, "", dtype=object), pdf["src"].fillna("").to_numpy()[rows])
        pair = (k[1:] == k[:-1]) & ~((t[1:] == t[:-1]) & (x[1:] == x[:-1]))
        size = np.abs(np.diff(x))[pair]
        with np.errstate(divide="ignore"):
            bins = np.where(size > 0, np.floor(np.log(size) / BIN), -10_000).astype(int)
        return pd.DataFrame({"src": src[1:][pair], "b": bins, "n": 1}).groupby(["src", "b"], as_index=False)["n"].sum()

    hist = per_shard(sorted_, moves, "src string, b int, n long").groupBy("src", "b").agg(F.sum("n").alias("n")).toPandas()
    sigma, least = source_habits(hist, params)

    def flagged(pdf: pd.DataFrame) -> pd.DataFrame:
        return filter_shard(pdf, context.value.get(int(pdf["_pid"].iloc[0]), nothing), sigma, least, params)

    told = stored(per_shard(sorted_, flagged, "kind string, pid int, tab string, row_id long, wait string, k long, v double, n double"))
    runs = [tuple(r) for r in told.where("kind = 'run'").select("pid", "wait", "k", "v", "n").collect()]  # two rows a shard
    out = told.where("kind = 'flag'").select("tab", "row_id")
    if not runs:
        return out
    whole = readings.sparkSession.createDataFrame(whole_runs(runs), "pid int, wait string, k long, whole double")
    return out.unionByName(told.where("kind = 'wait'").join(whole, ["pid", "wait", "k"]).where("whole >= n").select("tab", "row_id"))


class _Default(dict):
    def __missing__(self, key):
        return self[None]


def source_habits(hist: pd.DataFrame, p: SpikeParams) -> tuple[dict, dict]:
    """Per source the usual move (from the median of the moves that are not nil) and the least length of a stuck stretch.
    A source of which no move is known gets the figures of all sources together."""
    sigma, least = _Default(), _Default()
    for source, g in [(None, hist), *hist.groupby("src")]:
        g = g.groupby("b", as_index=False)["n"].sum().sort_values("b")
        moved = g[g["b"] > -10_000]
        total, still = int(g["n"].sum()), int(g["n"].sum() - moved["n"].sum())
        if len(moved):
            c = moved["n"].cumsum().to_numpy()
            half = c[-1] / 2
            i = int(np.searchsorted(c, half))
            share = (half - (c[i - 1] if i else 0)) / moved["n"].iloc[i]
            sigma[source] = float(np.exp((moved["b"].iloc[i] + share) * BIN) / 0.6745)
        stay = max(still / total if total else 0.0, 1e-9)
        least[source] = max(p.least_stuck, 1 + np.log(p.stuck_tail) / np.log(stay)) if stay < 1 else float("inf")
    sigma.setdefault(None, 0.02)
    least.setdefault(None, float(p.least_stuck))
    for source in least:
        sigma.setdefault(source, sigma[None])
    return sigma, least
