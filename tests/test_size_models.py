import numpy as np

from oddsloom.operators import models as mo


def test_one_hard_event_does_not_hold_up_its_batch(monkeypatch):
    p_home, p_draw = np.linspace(0.2, 0.6, 200), np.full(200, 0.26)
    line, over = np.full(200, np.nan), np.full(200, np.nan)
    p_home[7], line[7], over[7] = 0.9, 2.5, 0.02  # no rates give both
    made, real = [], mo.score_matrices
    monkeypatch.setattr(mo, "score_matrices", lambda h, *a, **k: made.append(len(h)) or real(h, *a, **k))
    lh, la, residual = mo.fit_rates(p_home, p_draw, line, over)
    assert residual[7] > 1e-3 and np.delete(residual, 7).max() < 1e-9
    assert sum(made) < 200 * 60  # matrices: some dozens an event, thousands for the hard one


def test_posted_prices_meet_the_sheet_without_a_join_on_it(spark):
    fitted = spark.createDataFrame([("a", f"e{i}", 0.8 + i / 10, 1.1) for i in range(12)], "source string, event string, lh double, la double")
    keys = ["ft_1x2:1", "ht_1x2:X", "htft:1/1", "ft_total:over_2.5", "ah:home_-0.5", "dc:1X", "cs:1-0", "unknown:1"]
    posted = spark.createDataFrame([("a", f"e{i}", k, 1.05 + (i * 7 + j * 5) % 11) for i in range(14) for j, k in enumerate(keys)], "source string, event string, market string, posted double")
    key = ["source", "event"]
    rows = lambda df: sorted((r.event, r.market, r.posted, round(r.fair, 9), round(r.ev, 9), r.robust) for r in df.collect())
    got = mo.posted_values(posted, fitted, key)
    want = rows(mo.model_values(posted, mo.sheets(fitted, key), key))
    assert want and rows(got) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Join")  # the join is below: its sides are events, not keys of sheets
