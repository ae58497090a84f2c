"""Flags over repeated scans: when first seen, carried over, merged; logs written only on change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.operators.series import with_previous


def carry_first_seen(now: DataFrame, before: DataFrame, key: list[str], at: str) -> DataFrame:
    """now with first_seen: that of the previous scan for keys it held, else the scan's time `at`. An absence resets it. Null keys equal null."""
    old = before.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("first_seen").alias("_f"))
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return now.join(old, cond, "left").withColumn("first_seen", F.coalesce("_f", F.lit(at).cast("timestamp_ntz"))).drop("_f", *[f"_{k}" for k in key])


def carry_stale(fresh: DataFrame, before: DataFrame, failed: DataFrame, on: list[str], expired) -> DataFrame:
    """Fresh flags, and those of the previous scan of failed scanners that are not expired, marked stale."""
    kept = before.join(failed, on, "left_semi").where(~expired)
    return fresh.withColumn("stale", F.lit(False)).unionByName(kept.withColumn("stale", F.lit(True)))


def replace_slice(before: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    """Previous rows except those of the re-scanned keys in `fresh`, and the fresh ones."""
    return before.join(fresh.select(*on).distinct(), on, "left_anti").unionByName(fresh)


def log_on_change(events: DataFrame, key: list[str], state: list[str], at: str, ident: str, every_hours: int = 24) -> DataFrame:
    """Rows whose state differs from the previous row of their key, and those later than `every_hours` after the previous row."""
    out = with_previous(events, key, at, ident, [*state, at])
    changed = F.lit(False)
    for s in state:
        changed = changed | ~F.col(s).eqNullSafe(F.col(f"_{s}"))
    late = F.col(at) > F.col(f"_{at}") + F.expr(f"INTERVAL {every_hours} HOURS")
    return out.where(F.col("_first") | changed | F.coalesce(late, F.lit(False))).drop("_first", f"_{at}", *[f"_{s}" for s in state])


def needs_expansion(now: DataFrame, before: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of the new listing that are unseen or whose payload's hash differs; adds hash and reason."""
    hashed = now.withColumn("hash", F.sha2(F.coalesce(payload, F.lit("")), 256))
    old = before.select(F.col(key), F.sha2(F.coalesce(payload, F.lit("")), 256).alias("_old"))
    both = hashed.join(old, key, "left")
    return both.withColumn("reason", F.when(F.col("_old").isNull(), "unseen").when(F.col("_old") != F.col("hash"), "changed")).where("reason IS NOT NULL").drop("_old")


def compare_captures(first: DataFrame, second: DataFrame, again: DataFrame, key: list[str], value: str) -> DataFrame:
    """Three captures A, B, A': per key whether B agrees (exact), differs where A and A' differ too (drift) or differs on its own (structural).
    Keys must not be null."""
    a, b, c = (d.select(*key, F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for d, n in ((first, "a"), (second, "b"), (again, "c")))
    j = a.join(b, key, "full").join(c, key, "full")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("in_a").eqNullSafe(F.col("in_b"))
    drift = ~(F.col("a").eqNullSafe(F.col("c")) & F.col("in_a").eqNullSafe(F.col("in_c")))
    return j.select(*key, F.when(same, "exact").when(drift, "drift").otherwise("structural").alias("verdict"))


def alerts(edges: DataFrame, seen: DataFrame, key: list[str], *, threshold: float = 15.0, rise: float = 5.0, muted: list[str] = (), first: bool = False) -> DataFrame:
    """Edges worth an alert: at the threshold or above, not weak, no muted source, and new against `seen` (key, edge) or risen by `rise` points since.
    The first look only takes note: it alerts of nothing. Null keys equal null."""
    strong = edges.where((F.col("edge") >= threshold) & (F.col("confidence") != "weak") & ~F.col("source").isin(*muted) if muted else (F.col("edge") >= threshold) & (F.col("confidence") != "weak"))
    old = seen.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("edge").alias("_edge"))
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = strong.join(old, cond, "left").where(F.col("_edge").isNull() | (F.col("edge") - F.col("_edge") >= rise))
    return (j.limit(0) if first else j).drop("_edge", *[f"_{k}" for k in key])


def ranked(edges: DataFrame, by: list[str] = ()) -> DataFrame:
    """edges without weak ones and with place: strong before medium, then the larger edge; places count within `by`."""
    tier = F.when(F.col("confidence") == "strong", 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(tier, F.col("edge").desc(), "odds_id", "side")
    return edges.where("confidence <> 'weak'").withColumn("place", F.row_number().over(w))


def refresh_plan(listing: DataFrame, cache: DataFrame, key: str, payload: str, *, start: str, now: str, horizon_hours: float, fresh_hours: float = 6.0) -> DataFrame:
    """listing with what to do about each event: 'beyond_horizon' (it starts too late to be looked into), 'expand' (unseen, or changed since), 'failed'
    (its expansion failed and the listing has not changed since), 'cached' (unchanged and fresh enough) or 'list_fallback' (unchanged but
    stale). cache: key, hash, loaded_at, failed; of repeated keys the newest. An unknown start is inside the horizon."""
    at = F.lit(now).cast("timestamp_ntz")
    hashed = listing.withColumn("hash", F.sha2(F.coalesce(payload, F.lit("")), 256))
    old = cache.groupBy(key).agg(F.max_by(F.struct("hash", "loaded_at", "failed"), "loaded_at").alias("_c"))
    j = hashed.join(old, key, "left")
    far = F.coalesce(F.col(start) > at + F.expr(f"INTERVAL {int(horizon_hours * 3600)} SECONDS"), F.lit(False))
    fresh = F.coalesce(F.col("_c.loaded_at") >= at - F.expr(f"INTERVAL {int(fresh_hours * 3600)} SECONDS"), F.lit(False))
    same = F.coalesce(F.col("_c.hash") == F.col("hash"), F.lit(False))
    plan = F.when(far, "beyond_horizon").when(~same, "expand").when(F.coalesce("_c.failed", F.lit(False)), "failed").when(fresh, "cached").otherwise("list_fallback")
    return j.withColumn("plan", plan).drop("_c")
