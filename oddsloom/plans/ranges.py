"""Range shards: a globally sorted table in balanced, numbered partitions, and what a shard has to know of the others.

A hot key is simply spread over several neighbouring shards. Anything order-dependent runs per shard; the few rows next to
a shard's edge (their number depends on the number of shards, not of rows) go through the driver."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.plans.materialize import checkpoint

ROWS_PER_SHARD = 1_000_000


def shards(df: DataFrame, by: list[str | Column], *, rows: int | None = None, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Globally sorted and checkpointed; column _pid numbers the shards in the order of the keys.

    `rows`, if given, only raises the number of shards above spark.sql.shuffle.partitions for large inputs."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows:
        n = max(n, -(-rows // rows_per_shard))
    return checkpoint(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()))


def per_shard(sharded: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """f over each non-empty shard as one frame, in shard order within."""

    def run(batches):
        if own := [b for b in batches if len(b)]:
            out = f(own[0] if len(own) == 1 else pd.concat(own, ignore_index=True))
            if out is not None and len(out):
                yield out

    return sharded.mapInPandas(run, schema)


def ranks(df: DataFrame, group: str, value: str, ident: str, *, rows: int | None = None) -> DataFrame:
    """Exact ranks within groups, for groups of any size: adds lower (rows of the group with a smaller value), upto (rows with a
    smaller or equal value), nth (its place, from 0, by value and ident) and total. group: one string column; value: double, neither null nor NaN; ident orders ties for the sort only.

    Rows are range-sorted by group, value and ident, so a hot group or a hot value spans shards; each shard learns how many rows of
    its first and last group, and of the values at its edges, lie in other shards (two rows a shard through the driver)."""
    sorted_ = shards(df.select(group, value, ident), [group, value, ident], rows=rows)

    def edge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in (0, -1):
            own = pdf.loc[pdf[group] == pdf[group].iloc[at], value]
            first, last = own.iloc[0], own.iloc[-1]
            out.append((int(pdf["_pid"].iloc[0]), at, pdf[group].iloc[at], len(own), first, int((own == first).sum()), last, int((own == last).sum())))
        return pd.DataFrame(out, columns=["pid", "at", "g", "n", "fv", "fn", "lv", "ln"])

    meta = per_shard(sorted_, edge, "pid int, at int, g string, n long, fv double, fn long, lv double, ln long").toPandas()
    firsts, lasts = ({r.pid: r for r in meta[meta["at"] == at].itertuples()} for at in (0, -1))
    before: dict[int, tuple[int, int]] = {}
    after: dict[int, tuple[int, int]] = {}
    order = sorted(firsts)
    for seq, near, far, told in ((order, firsts, lasts, before), (order[::-1], lasts, firsts, after)):
        held = None  # group, rows, value at the edge, rows of that value
        for i in seq:
            a, b = near[i], far[i]
            nv, nn, bv, bn = (a.fv, a.fn, b.lv, b.ln) if told is before else (a.lv, a.ln, b.fv, b.fn)
            count, tie = (held[1], held[3] if held[2] == nv else 0) if held and held[0] == a.g else (0, 0)
            told[i] = count, tie
            if a.g == b.g:
                held = b.g, count + b.n, bv, bn + (tie if a.fv == a.lv else 0)
            else:
                held = b.g, b.n, bv, bn
    context = df.sparkSession.sparkContext.broadcast((before, after))

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        (b_n, b_tie), (a_n, a_tie) = (c[int(pdf["_pid"].iloc[0])] for c in context.value)
        by = pdf.groupby(group, sort=False)
        first, last = pdf[group] == pdf[group].iloc[0], pdf[group] == pdf[group].iloc[-1]
        rank = by[value].rank(method="min").astype("int64") - 1
        upto = by[value].rank(method="max").astype("int64")
        total = by[value].transform("size").astype("int64")
        nth = by.cumcount().astype("int64") + b_n * first
        head, tail = first & (pdf[value] == pdf[value].iloc[0]), last & (pdf[value] == pdf[value].iloc[-1])
        return pdf.assign(lower=rank + b_n * first - b_tie * head, upto=upto + b_n * first + a_tie * tail, nth=nth, total=total + b_n * first + a_n * last).drop(columns="_pid")

    kinds = dict(df.dtypes)
    return per_shard(sorted_, ranked, f"{group} string, {value} double, {ident} {kinds[ident]}, lower long, upto long, nth long, total long")


def running_total(df: DataFrame, order: list[str], value: str, *, rows: int | None = None) -> DataFrame:
    """df with running: the sum of value over all rows up to each, in the order of the columns (null values count as 0). A row a shard goes
    through the driver."""
    sorted_ = shards(df, list(order), rows=rows)
    v = F.coalesce(F.col(value), F.lit(0.0))
    sums = sorted_.groupBy("_pid").agg(F.sum(v).alias("n")).orderBy("_pid").collect()
    before, total = [], 0.0
    for r in sums:
        before.append((r["_pid"], total))
        total += r["n"]
    if not before:
        return sorted_.drop("_pid").withColumn("running", F.lit(0.0))
    lead = df.sparkSession.createDataFrame(before, "_pid int, _before double")
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sorted_.join(F.broadcast(lead), "_pid").withColumn("running", F.sum(v).over(w) + F.col("_before")).drop("_pid", "_before")
