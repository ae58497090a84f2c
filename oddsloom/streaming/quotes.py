"""Structured Streaming forms of the history operators. Each is a DataFrame in, a DataFrame out; start() runs one into a table.

State is keyed and small: the last value of a series, a market's anchor, and the time of either. A row older than what its key has reported is left
out, since what came after it is out already; with a watermark, rows behind it are left out, too, and with `forget` a key's state is dropped when
the watermark is that far beyond its last row (the key's next row then counts as its first)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oddsloom.plans.materialize import run_dir


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table as a stream; timestamps without zone become instants (UTC), as watermarks need them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


ROWS_A_FILE = 5_000_000


def replay(df: DataFrame, at: str, parts: int = 4) -> DataFrame:
    """A table as a stream in the order of its times: cut at quantiles of the time into as many files, one a micro-batch, written one after the
    other, as a stream takes files by age. Rows without time come first. For tests and for tables of moderate size, as it reads the table once a part; a
    part has at most about ROWS_A_FILE rows."""
    spark = df.sparkSession
    parts = max(parts, df.count() // ROWS_A_FILE)
    place = f"{run_dir(spark)}/replay-{uuid.uuid4().hex}"
    typed = df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})
    when = F.coalesce(F.unix_micros(F.col(at)), F.lit(-(2**62))).cast("double")
    bounds = sorted(set(typed.select(when.alias("w")).approxQuantile("w", [i / parts for i in range(1, parts)], 0.01)))
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        own = typed.where((F.lit(True) if lo is None else when > lo) & (F.lit(True) if hi is None else when <= hi))
        own.coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).parquet(place)


def _marked(rows: DataFrame, at: str, late: str | None, forget: int | None) -> tuple[DataFrame, str]:
    if forget is not None and late is None:
        raise ValueError("state can be dropped only by a watermark: give late, too")
    return rows.withWatermark(at, late) if late else rows, GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout


def _keep_until(state: GroupState, last: pd.Timestamp, forget: int | None) -> None:
    if forget is not None:
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + forget * 1000)


def change_only(ticks: DataFrame, keys: list[str], *, at: str, value: str, ident: str, late: str | None = None, forget: int | None = None) -> DataFrame:
    """Rows whose value differs from the last one of their key, across micro-batches; inside one, rows go by time and id. late: the
    watermark's delay; forget: seconds after which a silent key's state is dropped."""
    kinds = dict(ticks.dtypes)
    columns = [*keys, at, value, ident]
    ticks, timeout = _marked(ticks.select(*columns), at, late, forget)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, old, since = (state.get if state.exists else (False, None, None))
        pdf = pd.concat(list(pdfs)).sort_values([at, ident])
        if held:
            pdf = pdf[pdf[at] >= pd.Timestamp(since)]
        if not len(pdf):
            _keep_until(state, pd.Timestamp(since), forget)
            return
        v = pdf[value].astype("float64")
        before = v.shift()
        changed = ~((v == before) | (v.isna() & before.isna()))
        changed.iloc[0] = not held or not (v.iloc[0] == old or (pd.isna(v.iloc[0]) and pd.isna(old)))
        last = v.iloc[-1]
        state.update((True, None if pd.isna(last) else float(last), pdf[at].iloc[-1].isoformat()))
        _keep_until(state, pdf[at].iloc[-1], forget)
        yield pdf.loc[changed, columns]

    out = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return ticks.groupBy(*keys).applyInPandasWithState(step, out, "held boolean, last double, since string", "append", timeout)


def steam(points: DataFrame, keys: list[str], *, at: str, side: str, fair: str, least: float = 0.02, late: str | None = None, forget: int | None = None) -> DataFrame:
    """The fold of operators.series.steam_moves with its anchor kept as state across micro-batches (JSON of side to chance). late, forget: as above."""
    kinds = dict(points.dtypes)
    points, timeout = _marked(points, at, late, forget)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        anchor, since, newest = (json.loads(state.get[0]), pd.Timestamp(state.get[1]), pd.Timestamp(state.get[2])) if state.exists else ({}, None, None)
        rows = pd.concat(list(pdfs)).sort_values([at, side])
        rows = rows if newest is None else rows[rows[at] > newest]
        out = []
        for t, now in rows.groupby(at, sort=True):
            current = {s: float(p) for s, p in zip(now[side], now[fair])}
            risen = [(*key, t, s, anchor[s], p, int((t - since).total_seconds())) for s, p in current.items() if s in anchor and p - anchor[s] >= least]
            out += risen
            newest = t
            if risen or since is None:
                anchor, since = {**anchor, **current}, t
            else:
                anchor = {**current, **anchor}
        state.update((json.dumps(anchor), since.isoformat(), newest.isoformat()))
        _keep_until(state, newest, forget)
        yield pd.DataFrame(out, columns=[*keys, at, side, "was", "now", "window_sec"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {at} {kinds[at]}, {side} string, was double, now double, window_sec long"
    return points.groupBy(*keys).applyInPandasWithState(step, schema, "anchor string, since string, newest string", "append", timeout)


def tumbling(ticks: DataFrame, keys: list[str], *, at: str, value: str, width: str, late: str) -> DataFrame:
    """Count, mean, least and largest value by key and window; a window closes when the watermark passes it."""
    w = ticks.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "lo", "hi")


def sessions(ticks: DataFrame, keys: list[str], *, at: str, gap: str, late: str) -> DataFrame:
    w = ticks.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    return w.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(ticks: DataFrame, keys: list[str], *, at: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """tumbling() over windows that overlap: a row counts in each that holds it."""
    w = ticks.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "lo", "hi")


def without_repeats(events: DataFrame, keys: list[str], *, at: str, late: str) -> DataFrame:
    """Each key once within the watermark's delay."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None]):
    """Runs all that is there through f(batch, epoch), to a checkpointed end."""
    place = f"{run_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(f).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def start(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs all that is there into a Parquet table in the shared folder and returns the table."""
    spark = stream.sparkSession
    place = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
