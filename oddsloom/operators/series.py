"""Price histories: change-only ticks, gaps, step series, moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["market_id", "selection"]


def with_previous(rows: DataFrame, keys: list[str], at: str, ident: str, columns: list[str], *, slice_: str = "day") -> DataFrame:
    """rows with _first, whether the row is the first of its key by `at` and `ident`, and _<c> for each of the columns, its value in the row before.

    A key's rows are windowed in slices of time, so a hot key is spread over as many tasks as it has slices. The last row of every slice,
    which a map-side combine finds, is carried into the key's next slice as a row of its own. Null keys and times are values like others."""
    cut = rows.withColumn("_slice", F.date_trunc(slice_, F.col(at)))
    last = cut.groupBy(*keys, "_slice").agg(F.max_by(F.struct(*columns), F.struct(at, ident)).alias("_x"))
    carried = last.withColumn("_x", F.lag("_x").over(Window.partitionBy(*keys).orderBy("_slice"))).where("_x IS NOT NULL").select(*keys, "_slice", *[F.col("_x")[c].alias(f"_v_{c}") for c in columns], F.lit(True).alias("_carried"))
    both = cut.withColumns({**{f"_v_{c}": F.col(c) for c in columns}, "_carried": F.lit(False)}).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(F.col("_carried").desc(), at, ident)
    out = both.withColumns({**{f"_{c}": F.lag(f"_v_{c}").over(w) for c in columns}, "_first": F.lag("_carried").over(w).isNull()}).where("NOT _carried")
    return out.drop("_slice", "_carried", *[f"_v_{c}" for c in columns])


def change_ticks(ticks: DataFrame) -> DataFrame:
    """Readings that differ from the one before in their series, null-safe; the first of a series always counts. Order: ts, tick_id."""
    out = with_previous(ticks, SERIES, "ts", "tick_id", ["odds"])
    return out.where(F.col("_first") | ~F.col("odds").eqNullSafe(F.col("_odds"))).drop("_odds", "_first")


def vanished(ticks: DataFrame) -> DataFrame:
    """Series whose last reading is a null, with the time of that reading and the last price before it. Two combinable aggregates, no sort."""
    order = F.struct("ts", "tick_id")
    by = ticks.groupBy(*SERIES).agg(F.max_by(F.struct("ts", "odds"), order).alias("l"), F.max_by("odds", F.when(F.col("odds").isNotNull(), order)).alias("last_odds"))
    return by.where("l.odds IS NULL").select(*SERIES, F.col("l.ts").alias("gone_at"), "last_odds")


def disappearances(cycles: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key that was seen in a source's healthy, non-empty cycle and is missing from its next one.

    cycles: source, cycle, ok. seen: source, cycle and the keys. Failed or empty cycles are as if they had not been; the first
    healthy cycle of a source ends nothing."""
    healthy = cycles.where("ok").join(seen.select("source", "cycle").distinct(), ["source", "cycle"], "left_semi")
    nxt = healthy.select("source", "cycle", F.lead("cycle").over(Window.partitionBy("source").orderBy("cycle")).alias("next"))
    gone = seen.join(nxt.where("next IS NOT NULL"), ["source", "cycle"]).drop("cycle").withColumnRenamed("next", "cycle")
    return gone.select("source", *keys, "cycle").join(seen, ["source", *keys, "cycle"], "left_anti").distinct()


def latest_of(ticks: DataFrame) -> DataFrame:
    """The newest reading of every series."""
    return ticks.groupBy(*SERIES).agg(F.max_by(F.struct("odds", "ts", "tick_id"), F.struct("ts", "tick_id")).alias("x")).select(*SERIES, "x.odds", "x.ts", "x.tick_id")


def step_series(ticks: DataFrame, since: str) -> DataFrame:
    """Readings from `since` on, and for every series with older ones a point at `since` with the last price before it."""
    edge = F.lit(since).cast("timestamp_ntz")
    inside = ticks.where(F.col("ts") >= edge).select(*SERIES, "ts", "odds", F.lit(False).alias("seed"))
    seed = ticks.where(F.col("ts") < edge).groupBy(*SERIES).agg(F.max_by("odds", F.struct("ts", "tick_id")).alias("odds")).select(*SERIES, edge.alias("ts"), "odds", F.lit(True).alias("seed"))
    return inside.unionByName(seed)


def nearest_market(wanted: DataFrame, markets: DataFrame, on: list[str], null_safe: list[str] = (), tolerance: float = 0.26) -> DataFrame:
    """wanted (on, null_safe, line) with the market_id of the same market whose line is nearest, within the tolerance, and the gap; ties go to the
    smaller id. A line of null asks for a market without line. Lines are met in buckets of the tolerance's width, so the join is on equal keys."""
    cell = lambda c: F.coalesce(F.floor(c / tolerance), F.lit(-(10**9)))
    safe = {c: F.coalesce(F.col(c), F.lit("~")) for c in null_safe}
    left = wanted.select("*", *[e.alias(f"_{c}") for c, e in safe.items()], F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.when(F.col("line").isNull(), cell(F.col("line"))).otherwise(cell(F.col("line")) + k)))).alias("_cell"))
    right = markets.select(*on, *[e.alias(f"_{c}") for c, e in safe.items()], "market_id", F.col("line").alias("_line"), cell(F.col("line")).alias("_cell"))
    j = left.join(right, [*on, *[f"_{c}" for c in null_safe], "_cell"]).withColumn("gap", F.coalesce(F.abs(F.col("line") - F.col("_line")), F.lit(0.0))).where(F.col("gap") <= tolerance + 1e-9)
    return j.groupBy(*wanted.columns).agg(F.min_by(F.struct("market_id", "gap"), F.struct("gap", "market_id")).alias("x")).select(*wanted.columns, "x.*")


def sessions(ticks: DataFrame, hours: int, *, slice_hours: int = 24) -> DataFrame:
    """market_id, start, last, n of each market's sessions: readings less than `hours` apart.

    Sessions are first made within slices of time, so a hot market is spread over as many tasks as it has slices; the slices' sessions,
    a few rows a market, are then merged where the gap between them is short. session_window joins a gap of its exact width, hence the
    microsecond less."""
    gap = F.expr(f"INTERVAL {hours} HOURS")
    parts = ticks.withColumn("_slice", F.window("ts", f"{slice_hours} hours")["start"]).groupBy("market_id", "_slice", F.session_window("ts", f"{hours * 3_600_000_000 - 1} microseconds")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy("market_id").orderBy("start")
    new = F.coalesce(F.col("start") >= F.lag("last").over(w) + gap, F.lit(True)).cast("long")
    merged = parts.withColumn("_new", new).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("market_id", "_k").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_k")


def steam_moves(points: DataFrame, key: list[str], *, fair: str = "fair", side: str = "side", ts: str = "ts", least: float = 0.02) -> DataFrame:
    """Rises of a side's fair probability by at least `least` since the market's anchor. The anchor moves only when a side fires,
    then for all sides of the market together; a plain lag would miss slow drift.

    points: one row a market, time and side. Result: key, ts, side, was, now, window_sec. The fold runs per market in time order; a
    market is what one event's line is, so its size does not grow with the number of markets."""
    kinds = dict(points.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, anchor, since = [], {}, None
        for t, now in pdf.sort_values([ts, side]).groupby(ts, sort=True):
            current = dict(zip(now[side], now[fair]))
            risen = [(s, anchor[s], p) for s, p in current.items() if s in anchor and p - anchor[s] >= least]
            for s, was, p in risen:
                out.append((*(pdf[k].iloc[0] for k in key), t, s, was, p, int((t - since).total_seconds())))
            if risen or since is None:
                anchor, since = {**anchor, **current}, t
            else:
                anchor = {**current, **anchor}
        return pd.DataFrame(out, columns=[*key, ts, side, "was", "now", "window_sec"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + f", {ts} {kinds[ts]}, {side} string, was double, now double, window_sec long"
    return points.groupBy(*key).applyInPandas(fold, schema)


def net_moves(points: DataFrame, key: list[str], *, hours: float = 1.0) -> DataFrame:
    """Net change of every side's fair probability over the last hours before its market's newest point (first to last in the window,
    two points at least), and of each market the side with the largest change; ties go to the side that sorts first."""
    newest = F.max("ts").over(Window.partitionBy(*key))
    inside = points.withColumn("_new", newest).where(F.col("ts") >= F.col("_new") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    by = inside.groupBy(*key, "side").agg(F.min_by("fair", "ts").alias("first"), F.max_by("fair", "ts").alias("last"), F.count("*").alias("n")).where("n >= 2")
    by = by.withColumn("change", F.col("last") - F.col("first"))
    w = Window.partitionBy(*key).orderBy(F.round(F.abs("change"), 9).desc(), "side")
    return by.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
