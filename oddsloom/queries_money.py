"""Queries on capital, ledgers and charts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsloom.operators import capital as ca
from oddsloom.operators import series as se
from oddsloom.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}
SINCE, UNTIL = "2026-01-15 00:00:00", "2026-03-15 00:00:00"


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _money(spark, d):
    """Accounts, entries and bets. The bets name accounts, but there is no table of these nor of a ledger: accounts are those named, every
    third tagged with the book it bets at most and number 2 for dividends; entries stand for every bet whose id is a multiple of a number of their kind."""
    b = table(spark, d, "bets")
    tag = b.where("account_id IS NOT NULL").groupBy("account_id", "book").count().groupBy("account_id").agg(F.max_by("book", F.struct("count", "book")).alias("tag"))
    accounts = tag.select(F.col("account_id").alias("id"), F.when(F.col("account_id") % 3 == 0, F.col("tag")).alias("book_tag"), F.lit(False).alias("archived"), (F.col("account_id") == 2).alias("is_dividend"), (F.col("account_id") % 4 * 10.0).alias("manual_open"))
    row = lambda n, kind, amount: F.when(F.col("bet_id") % n == 0, F.struct(F.lit(kind).alias("kind"), F.lit(amount).alias("amount")))
    rows = F.array_compact(F.array(row(11, "opening", 500.0), row(13, "deposit", 120.0), row(17, "withdraw", -60.0), row(17, "commission", -3.83), row(19, "pnl", 7.5), row(23, "transfer", -15.0)))
    entries = b.select(F.col("bet_id").alias("id"), "account_id", F.col("placed_at").alias("ts"), F.explode(rows).alias("r")).select("id", "account_id", "ts", "r.*")
    return accounts, entries, b


_MONEY = """t AS (SELECT account_id, book, count(*) AS n FROM bets WHERE account_id IS NOT NULL GROUP BY ALL), tags AS (SELECT account_id, arg_max(book, (n, book)) AS tag FROM t GROUP BY ALL),
accounts AS (SELECT account_id AS id, CASE WHEN account_id % 3 = 0 THEN tag END AS book_tag, account_id = 2 AS is_dividend, account_id % 4 * 10.0 AS manual_open FROM tags),
entries AS (SELECT bet_id AS id, account_id, placed_at AS ts, kind, amount FROM bets, (VALUES (11, 'opening', 500.0::DOUBLE), (13, 'deposit', 120.0), (17, 'withdraw', -60.0), (17, 'commission', -3.83), (19, 'pnl', 7.5), (23, 'transfer', -15.0)) k(n, kind, amount) WHERE bet_id % n = 0 {we}),
own AS (SELECT book_tag AS book, max(id) AS tagged FROM accounts WHERE book_tag IS NOT NULL GROUP BY ALL), b AS (SELECT bets.*, coalesce(account_id, tagged) AS account FROM bets LEFT JOIN own USING (book) {wb}),
s AS (SELECT account, coalesce(settled_at, placed_at) AS ts, bet_id AS id, payout - stake AS pnl, stake, status FROM b WHERE status <> 'open' AND payout IS NOT NULL),
e1 AS (SELECT account_id AS id, sum(CASE WHEN kind = 'opening' THEN amount ELSE 0 END) AS opening, sum(CASE WHEN kind <> 'pnl' THEN amount ELSE 0 END) AS ledger_net, sum(CASE WHEN kind = 'pnl' THEN amount ELSE 0 END) AS manual_pnl FROM entries GROUP BY ALL),
b1 AS (SELECT account AS id, count(*) AS n_bets, sum((status = 'open')::INT) AS n_open, coalesce(sum(stake), 0) AS total_stake, coalesce(sum(CASE WHEN status = 'open' THEN stake END), 0) AS open_stake, coalesce(sum(CASE WHEN status <> 'open' AND payout IS NOT NULL THEN payout - stake END), 0) AS bet_pnl FROM b GROUP BY ALL),
ids AS (SELECT id FROM accounts UNION SELECT NULL WHERE EXISTS (SELECT 1 FROM b1 WHERE id IS NULL) OR EXISTS (SELECT 1 FROM e1 WHERE id IS NULL)),
j AS (SELECT ids.id, a.book_tag, coalesce(a.is_dividend, false) AS is_dividend, coalesce(opening, 0) AS opening, coalesce(ledger_net, 0) AS ledger_net, coalesce(manual_pnl, 0) AS manual_pnl, coalesce(total_stake, 0) AS total_stake, coalesce(open_stake, 0) + coalesce(manual_open, 0) AS open_stake, coalesce(bet_pnl, 0) AS bet_pnl,
  coalesce(n_bets, 0)::BIGINT AS n_bets, coalesce(n_open, 0)::BIGINT AS n_open FROM ids LEFT JOIN accounts a ON a.id = ids.id LEFT JOIN e1 ON e1.id IS NOT DISTINCT FROM ids.id LEFT JOIN b1 ON b1.id IS NOT DISTINCT FROM ids.id),
r AS (SELECT *, round(ledger_net + bet_pnl + manual_pnl - open_stake, 2) AS balance FROM j),
w AS (SELECT *, CASE WHEN book_tag IS NOT NULL AND balance + round(open_stake, 2) > 0 THEN round((balance + round(open_stake, 2)) * (6.0::DOUBLE / 94), 2) ELSE 0 END AS cost FROM r),
rows AS (SELECT id, book_tag, is_dividend, round(opening, 2) AS opening, round(ledger_net, 2) AS ledger_net, round(bet_pnl, 2) AS bet_pnl, round(manual_pnl, 2) AS manual_pnl, round(bet_pnl + manual_pnl, 2) AS pnl, round(open_stake, 2) AS open_stake, round(total_stake, 2) AS total_stake, n_bets, n_open, balance,
  cost AS withdrawal_cost, round(balance + round(open_stake, 2) - cost, 2) AS current_value FROM w)"""
_ALL = _MONEY.format(we="", wb="")
_FRESH = _MONEY.format(we=f"AND placed_at BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'", wb=f"WHERE placed_at BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}'")


def _totals_sql(money: str, late: str, start: str, dividend: str) -> str:
    return f"""WITH {money}, a AS (SELECT sum(opening) FILTER (NOT is_dividend) AS starting, sum(balance) FILTER (NOT is_dividend) AS equity, sum(open_stake) FILTER (NOT is_dividend) AS open_exposure, sum(total_stake) FILTER (NOT is_dividend) AS total_stake,
sum(current_value) FILTER (NOT is_dividend) AS current_capital, sum(withdrawal_cost) FILTER (NOT is_dividend) AS withdrawal_cost, coalesce(sum(balance) FILTER (is_dividend), 0) AS dividend, sum(n_bets)::BIGINT AS n_bets, sum(n_open)::BIGINT AS n_open FROM rows),
i AS (SELECT coalesce(sum(amount) FILTER (e.account_id IS DISTINCT FROM 2 AND kind <> 'pnl'), 0) AS flow, coalesce(sum(amount) FILTER (e.account_id = 2 AND kind IN ('opening', 'deposit', 'transfer')), 0) AS div_in, coalesce(sum(amount) FILTER (kind = 'pnl'), 0) AS manual, coalesce(-sum(amount) FILTER (kind = 'commission'), 0) AS paid FROM entries e WHERE {late}),
p AS (SELECT coalesce(sum(pnl) FILTER (status <> 'pushed'), 0) AS win, coalesce(sum(stake) FILTER (status <> 'pushed'), 0) AS turnover, coalesce(sum(pnl), 0) AS inside FROM s WHERE {late})
SELECT round({start}, 2) AS starting_capital, round(starting, 2) AS starting_capital_all_time, round(equity, 2) AS equity, round(equity + open_exposure, 2) AS total_gross, round(current_capital, 2) AS current_capital, round(withdrawal_cost, 2) AS withdrawal_cost, round(win + manual, 2) AS settled_pnl, round(manual, 2) AS manual_pnl,
round(paid, 2) AS commission_paid, round(win + manual - paid, 2) AS net_pnl, round({dividend}, 2) AS dividend_total, round(dividend, 2) AS dividend_total_all_time, round(open_exposure, 2) AS open_exposure, round(total_stake, 2) AS total_stake, round(win / nullif(turnover, 0) * 100, 2) AS yield_pct, round((win + manual) / nullif(starting, 0) * 100, 2) AS roi_pct, n_bets, n_open FROM a, i, p"""


@_query(f"WITH {_ALL} SELECT * FROM rows")
def capital_balances(spark, d):
    return ca.balances(*_money(spark, d))


@_query(f"WITH {_FRESH} SELECT * FROM rows")
def capital_balances_fresh(spark, d):
    """The same as if nothing had been before the window."""
    return ca.balances(*_money(spark, d), since=SINCE, until=UNTIL, mode="fresh")


@_query(_totals_sql(_ALL, "true", "starting", "dividend"))
def capital_totals(spark, d):
    return ca.totals(*_money(spark, d))


@_query(_totals_sql(_ALL, f"ts >= TIMESTAMP '{SINCE}'", "equity - flow - inside - manual", "div_in"))
def capital_totals_since(spark, d):
    return ca.totals(*_money(spark, d), since=SINCE)


@_query(_totals_sql(_FRESH, f"ts >= TIMESTAMP '{SINCE}'", "starting", "dividend"))
def capital_totals_fresh(spark, d):
    return ca.totals(*_money(spark, d), since=SINCE, until=UNTIL, mode="fresh")


@_query(f"WITH {_ALL}, p AS (SELECT ts, id, 'bet' AS origin, pnl AS v FROM s UNION ALL SELECT ts, id, 'entry', amount FROM entries WHERE kind = 'pnl') SELECT ts, id, origin, round(sum(v) OVER (ORDER BY ts, id, origin ROWS UNBOUNDED PRECEDING), 2) AS balance FROM p")
def capital_curve(spark, d):
    return ca.curve(*_money(spark, d))


@_query(f"WITH {_ALL} SELECT a.id, (SELECT count(*) FROM entries e WHERE e.account_id = a.id) AS entries, (SELECT count(*) FROM bets WHERE account_id = a.id) AS bets, (SELECT count(*) FROM entries e WHERE e.account_id = a.id) + (SELECT count(*) FROM bets WHERE account_id = a.id) = 0 AS deletable FROM accounts a")
def account_references(spark, d):
    return ca.references(*_money(spark, d))


@_query(f"WITH {_ALL} SELECT e.id, e.account_id, e.ts, e.kind, e.amount, a.book_tag, row_number() OVER (PARTITION BY e.account_id ORDER BY e.ts DESC, e.id DESC, e.kind) AS place FROM entries e JOIN accounts a ON a.id = e.account_id")
def ledger_entries(spark, d):
    """Entries with their accounts, the newest of each account first."""
    from pyspark.sql import Window

    accounts, entries, _ = _money(spark, d)
    w = Window.partitionBy("account_id").orderBy(F.col("ts").desc(), F.col("id").desc(), "kind")
    return entries.join(accounts.select(F.col("id").alias("account_id"), "book_tag"), "account_id").withColumn("place", F.row_number().over(w).cast("long")).select("id", "account_id", "ts", "kind", "amount", "book_tag", "place")


@_query(f"""WITH {_ALL}, m AS (SELECT bet_id, placed_at AS ts, account_id AS source, (SELECT min(id) FROM accounts) AS target, stake AS amount FROM bets WHERE account_id IS NOT NULL AND stake > 0 AND account_id <> (SELECT min(id) FROM accounts)),
x AS (SELECT m.*, s.book_tag IS NOT NULL AS sb, t.book_tag IS NOT NULL AS tb FROM m JOIN accounts s ON s.id = m.source JOIN accounts t ON t.id = m.target)
SELECT source AS account_id, ts, 'transfer' AS kind, -amount AS amount FROM x UNION ALL SELECT target, ts, 'transfer', amount FROM x UNION ALL SELECT source, ts, 'commission', -round(amount * (6.0::DOUBLE / 94), 2) FROM x WHERE sb AND NOT tb""")
def transfer_entries(spark, d):
    """Every stake moved to the first account: two entries each and, from a book's account to one of none, the fee."""
    accounts, _, bets = _money(spark, d)
    first = accounts.agg(F.min("id").alias("target"))  # one row
    moves = bets.where("account_id IS NOT NULL AND stake > 0").select(F.col("placed_at").alias("ts"), F.col("account_id").alias("source"), F.col("stake").alias("amount")).crossJoin(F.broadcast(first)).where("source <> target")
    return ca.transfers(moves, accounts)


@_query("""WITH w AS (SELECT DISTINCT b.book, b.cb_event_id, b.market_type, b.period, b.team_side, b.line FROM bets b WHERE b.book IS NOT NULL AND b.cb_event_id IS NOT NULL),
c AS (SELECT w.*, m.market_id, coalesce(abs(m.line - w.line), 0) AS gap FROM w JOIN book_events e ON e.book = w.book AND e.source_event_id = w.cb_event_id JOIN markets m ON m.event_id = e.event_id AND m.market_type = w.market_type AND m.period = w.period AND m.team_side IS NOT DISTINCT FROM w.team_side
AND (m.line IS NULL) = (w.line IS NULL) AND coalesce(abs(m.line - w.line), 0) <= 0.26 + 1e-9)
SELECT book, cb_event_id, market_type, period, team_side, line, arg_min(market_id, (gap, market_id)) AS market_id, round(min(gap), 6) AS gap FROM c GROUP BY ALL""")
def chart_markets(spark, d):
    """The tick store's market for every line bet on: the exact one or the nearest within 0.26."""
    want = table(spark, d, "bets").where("book IS NOT NULL AND cb_event_id IS NOT NULL").select("book", F.col("cb_event_id").alias("source_event_id"), "market_type", "period", "team_side", "line").distinct()
    stored = table(spark, d, "markets").join(table(spark, d, "book_events").select("event_id", "book", "source_event_id"), "event_id")
    got = se.nearest_market(want, stored, ["book", "source_event_id", "market_type", "period"], ["team_side"])
    return got.select("book", F.col("source_event_id").alias("cb_event_id"), "market_type", "period", "team_side", "line", "market_id", F.round("gap", 6).alias("gap"))
