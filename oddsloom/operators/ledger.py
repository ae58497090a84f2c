"""Positions and balances from rows of bets: payouts, sums by account, running curves, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payout(status: Column, stake: Column, price: Column, cash_out: Column | None = None) -> Column:
    """won: stake times price; lost: 0; pushed and void: the stake; cashout: what was paid; else null."""
    return F.when(status == "won", stake * price).when(status == "lost", F.lit(0.0)).when(status.isin("pushed", "push", "void"), stake).when(status.isin("cashout", "cashed_out"), cash_out if cash_out is not None else F.lit(None))


def deltas(bets: DataFrame) -> DataFrame:
    """Settled bets with their gain (payout less stake), in order of settlement."""
    return bets.where("status <> 'open' AND settled_at IS NOT NULL AND payout IS NOT NULL AND stake IS NOT NULL").withColumn("gain", F.col("payout") - F.col("stake"))


def by_account(bets: DataFrame) -> DataFrame:
    """By account (null is its own): bets, open stake, turnover without returned stakes, gain, yield in percent (null without turnover)."""
    settled = (F.col("status") != "open") & F.col("payout").isNotNull()
    counted = settled & ~F.col("status").isin("pushed", "push", "void")
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
    out = bets.groupBy("account_id").agg(
        F.count("*").alias("bets"), some(F.col("status") == "open", F.col("stake")).alias("open_stake"), some(counted, F.col("stake")).alias("turnover"), some(settled, F.col("payout") - F.col("stake")).alias("gain")
    )
    return out.withColumn("yield_pct", F.when(F.col("turnover") > 0, F.col("gain") / F.col("turnover") * 100))


def running_curve(daily: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Running total over pre-aggregated steps (a row a day and group, say), so the one window that spans all holds few rows."""
    w = Window.partitionBy("account_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("balance", F.sum(value).over(w))


def attribute(bets: DataFrame, accounts: DataFrame) -> DataFrame:
    """account: the bet's own, else the one tagged with its book (of several the largest id), else null."""
    tagged = accounts.groupBy("book").agg(F.max("account_id").alias("_tagged"))
    return bets.join(tagged, "book", "left").withColumn("account", F.coalesce("account_id", "_tagged")).drop("_tagged")


def closing_price(history: DataFrame, bets: DataFrame, price: str) -> DataFrame:
    """For every bet the first price recorded at or after its start, null prices aside."""
    j = history.where(F.col(price).isNotNull()).join(bets.where("start_time IS NOT NULL").select("bet_id", "start_time"), "bet_id").where("recorded_at >= start_time")
    return j.groupBy("bet_id").agg(F.min_by(price, F.struct("recorded_at", "history_id")).alias("closing"))


def snapshots(history: DataFrame) -> DataFrame:
    """One row a bet and time (the smaller id), without rows that hold no price."""
    kept = history.where("bet_id IS NOT NULL AND recorded_at IS NOT NULL AND (cb_decimal IS NOT NULL OR pin_fair_decimal IS NOT NULL)")
    return kept.groupBy("bet_id", "recorded_at").agg(F.min_by(F.struct("history_id", "cb_decimal", "pin_fair_decimal"), "history_id").alias("x")).select("bet_id", "recorded_at", "x.*")


def either_key(marks: DataFrame, asked: DataFrame, keys: tuple[str, str], ident: str) -> DataFrame:
    """Marks that agree with an asked row in either key: a union of two equi-joins, each pair once."""
    a, b = keys
    one = marks.join(asked.select(F.col(ident).alias("asked"), F.col(a)), a).select("asked", *[c for c in marks.columns])
    two = marks.join(asked.select(F.col(ident).alias("asked"), F.col(b)), b).select("asked", *[c for c in marks.columns])
    return one.unionByName(two).distinct()


def combined(legs: DataFrame, key: list[str]) -> DataFrame:
    """By key: legs, combined (product of the prices of legs that are not returned, as the exponential of a sum, so it is added up before the
    shuffle), won (all are) and lost (any is)."""
    price = F.when(F.col("status").isin("pushed", "push", "void"), F.lit(1.0)).otherwise(F.col("odds_taken"))
    return legs.groupBy(*key).agg(F.count("*").alias("legs"), F.exp(F.sum(F.ln(price))).alias("combined"), F.bool_and(F.col("status") == "won").alias("won"), F.bool_or(F.col("status") == "lost").alias("lost"))


def balance_entries(wanted: DataFrame, balances: DataFrame) -> DataFrame:
    """'pnl' entries that bring accounts to the balances wanted (id, balance, ts); a difference under half a cent makes none."""
    j = wanted.select("id", "ts", F.col("balance").alias("_wanted")).join(balances.select("id", "balance"), "id").withColumn("amount", F.round(F.col("_wanted") - F.col("balance"), 2))
    return j.where("abs(_wanted - balance) >= 0.005").select(F.col("id").alias("account_id"), "ts", F.lit("pnl").alias("kind"), "amount")
