"""Grids shuffle their rows once a step, whatever the keys."""

import re

from oddsloom.operators import grid as gr

Q = "sport string, meeting string, market_type string, period string, line double, submarket string, team_side string, side string"


def test_best_lines_shuffle_once_and_join_nothing(spark):
    row = lambda line, side, *v: ("soccer", "m", "spread", "FT", line, None, None, side, *v)
    priced = spark.createDataFrame([row(0.0, "home", "a", 2.2), row(-0.0, "home", "b", 2.3), row(0.0, "away", "a", 2.0), row(1.5, "home", "a", 2.0), row(None, "home", "a", 2.0), row(None, "home", "b", 1.9)], Q + ", source string, price double")
    fair = spark.createDataFrame([row(-0.0, "home", 2.0), row(None, "home", 2.0), row(9.0, "home", 2.0)], Q + ", fair double")
    lines = gr.best_lines(priced, fair, least=-1000.0)
    got = {(r.line, r.side): (r.prices, r.sources, r.best_source, r.fair, None if r.edge_pct is None else round(r.edge_pct, 6)) for r in lines.collect()}
    assert got == {(0.0, "home"): ({"a": 2.2, "b": 2.3}, 2, "b", 2.0, 15.0), (0.0, "away"): ({"a": 2.0}, 1, "a", None, None), (None, "home"): ({"a": 2.0, "b": 1.9}, 2, "a", 2.0, 0.0)}
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan.split("Initial Plan")[-1])) == 1
