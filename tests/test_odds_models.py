import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsloom.functions import odds as fo
from oddsloom.operators import models as mo


def test_golden_prices(spark):
    row = spark.range(1).select(
        fo.american_to_decimal(F.lit(-110)).alias("a"), fo.american_to_decimal(F.lit(150)).alias("b"), fo.american_to_decimal(F.lit(0)).alias("z"), fo.shin_two_way(F.lit(1.91), F.lit(1.91)).alias("e"),
        fo.shin_two_way(F.lit(7.31), F.lit(1.023)).alias("dog"), fo.proportional(F.lit(7.31), F.lit(1.023)).alias("prop"), fo.line_text(F.lit(-0.0)).alias("l0"), fo.line_text(F.lit(1.50)).alias("l1"), fo.line_text(F.lit(-2.0)).alias("l2"),
    ).first()
    assert row.a == pytest.approx(1.9090909) and row.b == 2.5 and row.z is None and row.e == pytest.approx(0.5)
    assert row.dog == pytest.approx(0.0796, abs=1e-4) and row.prop == pytest.approx(0.1228, abs=1e-4)
    assert (row.l0, row.l1, row.l2) == ("0", "+1.5", "-2")


def test_the_closed_form_is_the_bisection(spark):
    rng = np.random.default_rng(1)
    prices = 1.01 + rng.exponential(2.0, (4000, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in prices], "x double, y double").select(fo.shin_two_way(F.col("x"), F.col("y")).alias("p"))
    assert np.abs(np.array([r.p for r in df.collect()]) - fo.shin(prices)[:, 0]).max() < 1e-9


def test_solvers_sum_to_one_and_refuse_bad_prices():
    p = np.array([[8.9, 6.15, 1.18], [2.0, np.nan, 3.0], [0.9, 3.0, 3.0]])
    for f in (fo.shin, fo.power):
        got = f(p)
        assert got[0].sum() == pytest.approx(1) and np.isnan(got[1:]).all()
    assert fo.power(p)[0] == pytest.approx([0.0708, 0.1108, 0.8184], abs=1e-4)


def test_golden_fit_and_sheet():
    p = fo.power(np.array([[8.9, 6.15, 1.18]]))
    lh, la, residual = mo.fit_rates(p[:, 0], p[:, 1], rho=0.0)
    assert (lh[0], la[0]) == (pytest.approx(0.921, abs=2e-3), pytest.approx(3.239, abs=2e-3)) and residual[0] < 1e-6
    s = {k: 1 / v[0] for k, v in mo.price_sheet(lh, la, 0.45, rho=0.0).items()}
    assert len(s) == 248
    assert (s["ht_1x2:2"], s["htft:2/2"], s["htft:X/2"]) == (pytest.approx(1.575, abs=0.01), pytest.approx(1.66, abs=0.01), pytest.approx(5.58, abs=0.03))
    assert 140 < s["htft:2/1"] < 155


def test_sheets_are_consistent():
    s = mo.price_sheet(np.array([1.4, 0.6]), np.array([1.1, 2.2]))
    close = lambda a, b: np.allclose(a, b, atol=1e-9)
    assert close(s["ft_1x2:1"] + s["ft_1x2:X"] + s["ft_1x2:2"], 1) and close(sum(v for k, v in s.items() if k.startswith("cs:")), 1)
    assert close(sum(v for k, v in s.items() if k.startswith("htft:")), 1) and close(s["ah:home_0"], s["dnb:1"]) and close(s["ah:home_-0.5"], s["ft_1x2:1"]) and close(s["ah:home_0.5"], s["dc:1X"])
    assert close(s["ah:home_-0.25"], (s["ah:home_0"] + s["ah:home_-0.5"]) / 2) and close(s["exact:0"] + s["exact:1"] + s["exact:2"], s["ft_total:under_2.5"]) and "ah:away_-0" not in s


def test_half_full_margins():
    nine = mo.half_full_fair(np.array([0.0]), sigma=11.0, rho=2**-0.5)
    six = mo.half_full_fair(np.array([0.0]), sigma=11.0, rho=2**-0.5, nine=False)
    assert 1 / nine["1/1"][0] == pytest.approx(2.83, abs=0.01) and 1 / six["1/1"][0] == pytest.approx(2.76, abs=0.01)
    assert sum(nine.values())[0] == pytest.approx(1) and mo.bivariate_cdf(np.array([0.0]), np.array([0.0]), 0.5)[0] == pytest.approx(1 / 3, abs=1e-7)


def test_a_planted_rung_is_off_the_curve(spark):
    m = mo.score_matrices(np.array([1.5]), np.array([1.1]))
    rows = []
    for line in np.arange(-2, 2.1, 0.5):
        p = mo.handicap(m, line)[0] + (0.05 if line == 0.5 else 0)
        rows.append(("b", "e", "ah", float(line), float(1 / p), float(1 / (1 - p))))
    got = mo.ladder_curves(spark.createDataFrame(rows, "source string, event string, kind string, line double, x double, y double"), ["source", "event"]).collect()
    assert 0.5 in {r.line for r in got} and max(got, key=lambda r: abs(r.points)).line == 0.5


def test_functions_from_sql(spark):
    from oddsloom.sql import register

    assert "token_set_ratio" in register(spark)
    row = spark.sql("SELECT token_set_ratio('real madrid', 'madrid real club') AS a, shin_three_way(8.9D, 6.15D, 1.18D) AS b, normal_team('FC Köln') AS c").first()
    assert row.a == 100 and sum(row.b) == pytest.approx(1) and row.c == "koln"
