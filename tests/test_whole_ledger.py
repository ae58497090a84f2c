import math
import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_combined_odds_of_every_book_by_brute_force(spark):
    legs = defaultdict(list)
    for r in spark.read.parquet(f"{D}/bets.parquet").where("account_id IS NOT NULL AND odds_taken > 1").collect():
        legs[r.account_id, r.placed_at.date()].append(1.0 if r.status in ("pushed", "push", "void") else r.odds_taken)
    got = {(r.account_id, r.day.date()): r for r in entry.queries()["combined_odds_all"](spark, D).collect()}
    assert got.keys() == legs.keys()
    assert all(r.legs == len(legs[k]) and math.isclose(r.combined, math.prod(legs[k]), rel_tol=1e-9) for k, r in got.items())
