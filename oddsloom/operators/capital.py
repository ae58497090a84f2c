"""Capital over accounts, a ledger of signed entries and bets: balances, totals in two window modes, the running curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.operators.ledger import attribute
from oddsloom.plans.ranges import running_total

#: Kinds of entries that move capital in or out.
FLOWS = ["opening", "deposit", "withdraw", "adjustment", "transfer", "commission"]
FEE_PCT = 6.0


def withdrawal_rate(fee_pct: float = FEE_PCT) -> float:
    """The fee is a share of what is taken off the account, so of what arrives it is more: f / (100 - f)."""
    return fee_pct / (100.0 - fee_pct) if 0 < fee_pct < 100 else 0.0


def in_window(ts: Column, since: str | None, until: str | None) -> Column:
    """Both bounds included; an unknown time is inside only if there is no lower bound."""
    out = F.lit(True)
    if since is not None:
        out = out & (ts >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out & (ts.isNull() | (ts <= F.lit(until).cast("timestamp_ntz")))
    return F.coalesce(out, F.lit(False))


def transfers(moves: DataFrame, accounts: DataFrame, fee_pct: float = FEE_PCT) -> DataFrame:
    """Ledger entries of moves (ts, source, target, amount): out of one account, into the other, and where the first has a book's tag and
    the second none, the fee. account_id, ts, kind, amount."""
    tagged = lambda n: accounts.select(F.col("id").alias(n), F.col("book_tag").isNotNull().alias(f"{n}_book"))
    j = moves.join(tagged("source"), "source").join(tagged("target"), "target")
    row = lambda account, kind, amount: F.struct(F.col(account).alias("account_id"), F.lit(kind).alias("kind"), amount.alias("amount"))
    fee = F.when(F.col("source_book") & ~F.col("target_book"), row("source", "commission", -F.round(F.col("amount") * withdrawal_rate(fee_pct), 2)))
    rows = F.array_compact(F.array(row("source", "transfer", -F.col("amount")), row("target", "transfer", F.col("amount")), fee))
    return j.select("ts", F.explode(rows).alias("r")).select("r.account_id", "ts", "r.kind", "r.amount")


def references(accounts: DataFrame, entries: DataFrame, bets: DataFrame) -> DataFrame:
    """By account the entries and bets that name it, and whether it may be deleted (nothing does) rather than archived."""
    n = lambda df, name: df.where("account_id IS NOT NULL").groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias(name))
    j = accounts.join(n(entries, "entries"), "id", "left").join(n(bets, "bets"), "id", "left").fillna(0, ["entries", "bets"])
    return j.select("id", "entries", "bets", ((F.col("entries") == 0) & (F.col("bets") == 0)).alias("deletable"))


def settled(bets: DataFrame) -> DataFrame:
    """Bets with a result: account, ts (of settlement, else of placing), id, pnl, stake, status."""
    return bets.where("status <> 'open' AND payout IS NOT NULL").select("account", F.coalesce("settled_at", "placed_at").alias("ts"), F.col("bet_id").alias("id"), (F.col("payout") - F.col("stake")).alias("pnl"), "stake", "status")


def _windowed(entries: DataFrame, bets: DataFrame, accounts: DataFrame, since, until, mode) -> tuple[DataFrame, DataFrame]:
    if mode not in ("pnl", "fresh"):
        raise ValueError(mode)
    if mode == "fresh":
        entries, bets = entries.where(in_window(F.col("ts"), since, until)), bets.where(in_window(F.col("placed_at"), since, until))
    tags = accounts.where("book_tag IS NOT NULL AND NOT archived").select(F.col("book_tag").alias("book"), F.col("id").alias("account_id"))
    return entries, attribute(bets, tags)


def balances(accounts: DataFrame, entries: DataFrame, bets: DataFrame, *, since: str | None = None, until: str | None = None, mode: str = "pnl", fee_pct: float = FEE_PCT) -> DataFrame:
    """A row an account, and one with a null id for bets and entries of none. Mode 'fresh' counts only entries and bets placed inside the window;
    'pnl' leaves balances as they are. Figures are rounded to cents.

    accounts: id, book_tag, archived, is_dividend, manual_open. entries: id, account_id, ts, kind, amount; 'pnl' entries are results, no capital. bets:
    bet_id, account_id, book, status, stake, payout, placed_at, settled_at."""
    entries, bets = _windowed(entries, bets, accounts, since, until, mode)
    some = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    kind, status = F.col("kind"), F.col("status")
    e = entries.groupBy(F.col("account_id").alias("id")).agg(some(kind == "opening", "amount").alias("opening"), some(kind != "pnl", "amount").alias("ledger_net"), some(kind == "pnl", "amount").alias("manual_pnl"))
    result = bets.withColumn("pnl", F.when((status != "open") & F.col("payout").isNotNull(), F.col("payout") - F.col("stake")))
    b = result.groupBy(F.col("account").alias("id")).agg(
        F.count("*").alias("n_bets"), F.sum((status == "open").cast("long")).alias("n_open"), some(F.lit(True), "stake").alias("total_stake"), some(status == "open", "stake").alias("open_stake"), some(F.lit(True), "pnl").alias("bet_pnl")
    )
    flows = e.join(b, e["id"].eqNullSafe(b["id"]), "full").select(F.coalesce(e["id"], b["id"]).alias("id"), *e.columns[1:], *b.columns[1:])
    known = accounts.select("id", "book_tag", "is_dividend", F.coalesce("manual_open", F.lit(0.0)).alias("manual_open"), F.lit(True).alias("_known"))
    r = known.join(flows.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "full").where("_known OR _id IS NULL")
    figures = ["opening", "ledger_net", "manual_pnl", "total_stake", "open_stake", "bet_pnl", "manual_open"]
    r = r.fillna(0.0, figures).fillna(0, ["n_bets", "n_open"]).fillna(False, ["is_dividend"]).where("_known OR n_bets > 0 OR ledger_net <> 0")
    cents = lambda c: F.round(c, 2)
    open_ = F.col("open_stake") + F.col("manual_open")
    r = r.withColumn("balance", cents(F.col("ledger_net") + F.col("bet_pnl") + F.col("manual_pnl") - open_)).withColumn("open_stake", cents(open_))
    gross = F.col("balance") + F.col("open_stake")
    r = r.withColumn("withdrawal_cost", F.when(F.col("book_tag").isNotNull() & (gross > 0), cents(gross * withdrawal_rate(fee_pct))).otherwise(F.lit(0.0)))
    return r.select(
        "id", "book_tag", "is_dividend", *[cents(F.col(c)).alias(c) for c in ("opening", "ledger_net", "bet_pnl", "manual_pnl")], cents(F.col("bet_pnl") + F.col("manual_pnl")).alias("pnl"),
        "open_stake", cents(F.col("total_stake")).alias("total_stake"), "n_bets", "n_open", "balance", "withdrawal_cost", cents(gross - F.col("withdrawal_cost")).alias("current_value"),
    )


def totals(accounts: DataFrame, entries: DataFrame, bets: DataFrame, *, since: str | None = None, until: str | None = None, mode: str = "pnl", fee_pct: float = FEE_PCT) -> DataFrame:
    """One row over all accounts but those for dividends, whose balance is given apart. With a lower bound, mode 'pnl' gives as
    starting_capital what there was at that time, reckoned back from now. Quotients without a denominator are null."""
    rows = balances(accounts, entries, bets, since=since, until=until, mode=mode, fee_pct=fee_pct)
    entries, bets = _windowed(entries, bets, accounts, since, until, mode)
    work, paid = ~F.col("is_dividend"), F.col("is_dividend")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0))
    a = rows.agg(
        total(work, "opening").alias("starting"), total(work, "balance").alias("equity"), total(work, "open_stake").alias("open_exposure"), total(work, "total_stake").alias("total_stake"), total(work, "current_value").alias("current_capital"),
        total(work, "withdrawal_cost").alias("withdrawal_cost"), total(paid, "balance").alias("dividend_all_time"), F.sum("n_bets").alias("n_bets"), F.sum("n_open").alias("n_open"),
    )
    late = lambda c: F.lit(True) if since is None else F.coalesce(F.col(c) >= F.lit(since).cast("timestamp_ntz"), F.lit(False))
    kinds = accounts.select(F.col("id").alias("account_id"), F.col("is_dividend").alias("_div"))
    e = entries.join(kinds, "account_id", "left").withColumn("_work", F.coalesce(~F.col("_div"), F.col("account_id").isNull()))
    kind = F.col("kind")
    inside = e.agg(
        total(late("ts") & F.col("_work") & kind.isin(*FLOWS), "amount").alias("flow"), total(late("ts") & ~F.col("_work") & kind.isin("opening", "deposit", "transfer"), "amount").alias("dividend_window"),
        total(late("ts") & (kind == "pnl"), "amount").alias("manual_pnl"), (-total(late("ts") & (kind == "commission"), "amount")).alias("commission_paid"),
    )
    s = settled(bets)
    counted = late("ts") & (F.col("status") != "pushed")
    won = s.agg(total(counted, "pnl").alias("win_pnl"), total(counted, "stake").alias("turnover"), total(late("ts"), "pnl").alias("pnl_window"))
    one = a.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(won))  # one row each
    cents = lambda c: F.round(c, 2)
    settled_pnl = F.col("win_pnl") + F.col("manual_pnl")
    back = F.col("equity") - F.col("flow") - F.col("pnl_window") - F.col("manual_pnl")
    rebased = since is not None and mode != "fresh"
    return one.select(
        cents(back if rebased else F.col("starting")).alias("starting_capital"), cents("starting").alias("starting_capital_all_time"), cents("equity").alias("equity"), cents(F.col("equity") + F.col("open_exposure")).alias("total_gross"),
        cents("current_capital").alias("current_capital"), cents("withdrawal_cost").alias("withdrawal_cost"), cents(settled_pnl).alias("settled_pnl"), cents("manual_pnl").alias("manual_pnl"), cents("commission_paid").alias("commission_paid"),
        cents(settled_pnl - F.col("commission_paid")).alias("net_pnl"), cents("dividend_window" if rebased else "dividend_all_time").alias("dividend_total"), cents("dividend_all_time").alias("dividend_total_all_time"),
        cents("open_exposure").alias("open_exposure"), cents("total_stake").alias("total_stake"), cents(F.when(F.col("turnover") != 0, F.col("win_pnl") / F.col("turnover") * 100)).alias("yield_pct"),
        cents(F.when(F.col("starting") != 0, settled_pnl / F.col("starting") * 100)).alias("roi_pct"), "n_bets", "n_open",
    )


def curve(accounts: DataFrame, entries: DataFrame, bets: DataFrame, *, since: str | None = None, until: str | None = None, mode: str = "pnl") -> DataFrame:
    """ts, id, origin ('bet' or 'entry'), balance: running sum of the results of settled bets and of 'pnl' entries by time and id, over range
    shards, so that no one task sees all of them."""
    entries, bets = _windowed(entries, bets, accounts, since, until, mode)
    points = settled(bets).select("ts", "id", F.lit("bet").alias("origin"), F.col("pnl").alias("delta")).unionByName(entries.where("kind = 'pnl'").select("ts", "id", F.lit("entry").alias("origin"), F.col("amount").alias("delta")))
    if since is not None:
        points = points.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return running_total(points, ["ts", "id", "origin"], "delta").select("ts", "id", "origin", F.round("running", 2).alias("balance"))
