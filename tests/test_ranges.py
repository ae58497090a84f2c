import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from oddsloom.plans.joins import lookup
from oddsloom.plans.ranges import ranks


def test_ranks_agree_with_counting_for_hot_groups_and_ties(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.6 else rng.choice("bcd"), float(rng.choice([0, 0, 0, 1, 2, rng.random()])), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(7)
    got = ranks(df, "g", "v", "i", rows=3000).collect()
    by = defaultdict(list)
    for g, v, i in rows:
        by[g].append((v, i))
    assert len(got) == len(rows)
    places = {g: {x: n for n, x in enumerate(sorted(l))} for g, l in by.items()}
    values = {g: [v for v, _ in l] for g, l in by.items()}
    counts = {g: Counter(v) for g, v in values.items()}
    below = {g: {v: sum(n for w, n in c.items() if w < v) for v in c} for g, c in counts.items()}
    for r in got:
        assert (r["lower"], r["upto"], r["total"]) == (below[r.g][r.v], below[r.g][r.v] + counts[r.g][r.v], len(values[r.g]))
        assert r["nth"] == places[r.g][(r.v, r.i)]


def test_ranks_of_one_value_and_of_nothing(spark):
    one = ranks(spark.range(500).select(F.lit("x").alias("g"), F.lit(1.0).alias("v"), F.col("id").alias("i")), "g", "v", "i").collect()
    assert {(r.lower, r.upto, r.total) for r in one} == {(0, 500, 500)} and sorted(r.nth for r in one) == list(range(500))
    assert ranks(spark.createDataFrame([], "g string, v double, i long"), "g", "v", "i").count() == 0


def test_lookup_is_the_same_broadcast_and_salted(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(1)).otherwise((F.col("id") % 9).cast("int")).alias("k"), F.col("id").alias("row"))
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(7)], "k int, name string")
    a, b = (sorted(map(tuple, lookup(big, dim, ["k"], salt_from="row", broadcast_rows=n).select("row", "k", "name").collect()), key=str) for n in (100, 0))
    assert a == b and len(a) == 1000
