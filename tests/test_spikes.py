import math
import random

from oddsloom.operators.spikes import SpikeParams, implausible

SCHEMA = "tab string, row_id long, series long, source string, t long, v double, probe int"


def series(rng, key, source, n, sigma, first_id, start=30.0):
    x, out = math.log(start), []
    for i in range(n):
        x += sigma * rng.choice([-2, -1, -0.6, 0.6, 1, 2]) if i else 0
        out.append(["ticks", first_id + i, key, source, i * 1000, math.exp(x), 0])
    return out


def flagged(spark, data, parts=3, **kw):
    df = spark.createDataFrame([tuple(r) for r in data], SCHEMA).repartition(parts)
    out = [(r.tab, r.row_id) for r in implausible(df, **kw).collect()]
    assert len(out) == len(set(out))
    return set(out)


def board(rng):
    rows = []
    for k in range(40):
        rows += series(rng, k, "quiet" if k % 2 else "wild", 60, 0.005 if k % 2 else 0.04, k * 1000, start=30.0)
    return rows


def test_a_spike_is_judged_by_its_source_and_a_lasting_move_is_none(spark):
    rows = board(random.Random(2))
    at = lambda k, i: rows[k * 60 + i]
    at(1, 30)[5] *= 1.12  # far for the quiet source
    at(2, 30)[5] *= 1.12  # usual for the wild one
    for i in range(20, 23):
        at(3, i)[5] *= 1.3  # three readings long
    for i in range(40, 60):
        at(5, i)[5] *= 1.3  # lasts
    assert flagged(spark, rows) == {("ticks", 1030), ("ticks", 3020), ("ticks", 3021), ("ticks", 3022)}


def test_impossible_stuck_repeated_null_and_late(spark):
    rows = board(random.Random(3))
    at = lambda k, i: rows[k * 60 + i]
    want = set()
    for i, bad in enumerate([0.0, 1.0, -3.0, float("nan"), float("inf")]):
        at(7, 10 + i * 3)[5] = bad
        want.add(("ticks", 7010 + i * 3))
    at(9, 12)[5] = None
    for i in range(20, 45):
        at(11, i)[5] = at(11, 20)[5]
        want.add(("ticks", 11000 + i))
    at(13, 30)[5] *= 1.2
    again = list(at(13, 30))
    again[1] = 99_999
    rows.append(again)
    want |= {("ticks", 13030), ("ticks", 99_999)}
    random.Random(4).shuffle(rows)
    assert flagged(spark, rows) == want


def test_newest_prices_are_held_against_the_end_of_their_series(spark):
    rows = board(random.Random(5))
    end = {k: rows[k * 60 + 59][5] for k in range(40)}
    rows += [["latest", 1, 1, "quiet", 10**6, end[1] * 1.004, 1], ["latest", 2, 3, "quiet", 10**6, end[3] * 1.5, 1], ["latest", 3, 5, "quiet", 10**6, 0.5, 1], ["latest", 4, 7, "quiet", 10**6, None, 1], ["latest", 5, 777, "quiet", 10**6, 3.0, 1]]
    assert flagged(spark, rows) == {("latest", 2), ("latest", 3)}


def test_a_hot_series_over_many_shards_is_judged_as_one(spark):
    rng = random.Random(6)
    rows = series(rng, 1, "quiet", 6000, 0.005, 0, start=50.0) + board(random.Random(7))
    for r in rows[6000:]:
        r[2] += 100
        r[1] += 10_000
    want = set()
    for i in range(100, 5900, 157):
        rows[i][5] *= 1.25
        want.add(("ticks", i))
    for i in range(3000, 3060):
        rows[i][5] = rows[3000][5] if i not in range(100, 5900, 157) else rows[i][5]
    want |= {("ticks", i) for i in range(3000, 3060)}
    assert flagged(spark, rows, rows=6000 * 1_000_000 // 400) == want


def test_empty_tables_unknown_sources_and_extra_columns(spark):
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("ticks", i, 1, None, None if i == 3 else i, 2.0 + i / 100, 0, "x", 5) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA + ", k string, _pid int")
    assert implausible(df, params=SpikeParams()).count() == 0


def test_a_source_that_mostly_stands_still_is_judged_by_its_own_habit(spark):
    """It repeats its price 99 times in 100, so runs of hundreds of readings are usual; only one of thousands, over many shards, is stuck."""
    rng = random.Random(8)
    rows, x = [], math.log(20.0)
    for i in range(24_000):
        if rng.random() < 0.01 and not 9_000 <= i < 13_000:
            x += 0.01 * rng.choice([-1, -0.5, 0.5, 1])
        rows.append(["ticks", i, 1, "still", i * 1000, math.exp(x), 0])
    start = max(i for i in range(9_001) if i == 0 or rows[i][5] != rows[i - 1][5])
    end = min(i for i in range(13_000, 24_000) if rows[i][5] != rows[i - 1][5])
    assert flagged(spark, rows, rows=24_000 * 1_000_000 // 1_500) == {("ticks", i) for i in range(start, end)}


def test_a_run_is_measured_over_shards_and_repeats_share_its_flag(spark):
    rows = series(random.Random(9), 1, "quiet", 400, 0.01, 0)
    for i in range(100, 300):
        rows[i][5] = rows[100][5]
    again = [["ticks", 1000 + i, *rows[i][2:]] for i in range(95, 305)]
    want = {("ticks", i) for i in range(100, 300)} | {("ticks", 1000 + i) for i in range(100, 300)}
    for per in (7, 50, 1000):
        assert flagged(spark, rows + again, rows=610 * 1_000_000 // per) == want


def test_a_source_that_never_moves_is_not_stuck(spark):
    assert flagged(spark, [["ticks", i, 1, "dead", i, 2.0, 0] for i in range(500)]) == set()
