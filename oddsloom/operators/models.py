"""Score models as vectorised operators: Poisson score matrices for soccer, a bivariate normal margin for basketball.

All numerics run on whole Arrow batches at once; an event is a row of arrays, never a Python loop of its own, except the small
ladder fits, which run per event inside their group."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.odds import power, shin

#: Goals per side in the matrix, low-score correction, first half's share, bounds of the rates.
GOALS, LOW_SCORE, FIRST_HALF, RATES = 12, -0.08, 0.44, (0.03, 8.0)
#: Correlation of half-time and full-time margins, deviation of the final margin by league and else.
MARGIN_CORRELATION, MARGIN_SIGMA = 0.70, 10.0
MARGIN_SIGMAS = [("nba", 11.75), ("ncaa", 10.3), ("college", 10.3)]
#: Thresholds: least value of a derived price and of one in the tails, longest fair price, shortest posted price, other halves' shares.
LEAST_EV, LEAST_EV_TAIL, LONGEST, SHORTEST, OTHER_SHARES = 0.03, 0.08, 15.0, 1.10, (0.42, 0.48)
CURVE_POINTS, SUPREMACY_GAP, TOTAL_GAP = 2.0, 0.15, 0.25
_R = ("1", "X", "2")


def _pmf(rate: np.ndarray, n: int) -> np.ndarray:
    k = np.arange(n)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.exp(k * np.log(rate)[:, None] - rate[:, None] - log_factorial)


def score_matrices(home: np.ndarray, away: np.ndarray, n: int = GOALS, rho: float = LOW_SCORE) -> np.ndarray:
    """(events, n, n): chance of each score, the four lowest scores corrected by rho, each matrix summing to 1."""
    m = _pmf(home, n)[:, :, None] * _pmf(away, n)[:, None, :]
    m[:, 0, 0] *= 1 - home * away * rho
    m[:, 0, 1] *= 1 + home * rho
    m[:, 1, 0] *= 1 + away * rho
    m[:, 1, 1] *= 1 - rho
    m = np.maximum(m, 0.0)
    return m / m.sum(axis=(1, 2), keepdims=True)


@lru_cache(8)
def _grid(n: int):
    i, j = np.indices((n, n))
    return i, j


def results(m: np.ndarray) -> np.ndarray:
    """(events, 3): home, draw, away."""
    i, j = _grid(m.shape[1])
    return np.stack([m[:, i > j].sum(1), m[:, i == j].sum(1), m[:, i < j].sum(1)], axis=1)


def over(m: np.ndarray, line: float) -> np.ndarray:
    i, j = _grid(m.shape[1])
    return m[:, i + j > line].sum(1)


def totals(m: np.ndarray) -> np.ndarray:
    i, j = _grid(m.shape[1])
    return np.stack([m[:, i + j == g].sum(1) for g in range(2 * m.shape[1] - 1)], axis=1)


def handicap(m: np.ndarray, line: float) -> np.ndarray:
    """Chance that home covers the line, returned stakes left out; a quarter line is the mean of its neighbours."""
    if abs(line * 2 - round(line * 2)) > 1e-9:
        return (handicap(m, line - 0.25) + handicap(m, line + 0.25)) / 2
    i, j = _grid(m.shape[1])
    win, lose = m[:, i - j + line > 1e-9].sum(1), m[:, i - j + line < -1e-9].sum(1)
    return win / np.maximum(win + lose, 1e-300)


def fit_rates(p_home: np.ndarray, p_draw: np.ndarray, line: np.ndarray | None = None, p_over: np.ndarray | None = None, rho: float = LOW_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goal rates of all events at once by damped Newton steps in log rates, and the residual. Anchors: chance of home and, where a
    total is given, of over; else of the draw."""
    n = len(p_home)
    x = np.full((n, 2), np.log(1.2))
    total = np.zeros(n, dtype=bool) if p_over is None else np.isfinite(p_over)
    lines = np.zeros(n) if line is None else np.nan_to_num(line)

    anchor = np.zeros(n) if p_over is None else np.nan_to_num(p_over)

    def residual(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = score_matrices(np.exp(x[:, 0]), np.exp(x[:, 1]), rho=rho)
        r = results(m)
        i, j = _grid(GOALS)
        second = np.where(total[at], (m * ((i + j)[None] > lines[at, None, None])).sum((1, 2)) - anchor[at], r[:, 1] - p_draw[at])
        return np.column_stack([r[:, 0] - p_home[at], second])

    every, bound, eps = np.arange(n), np.log(RATES), 1e-5
    r = residual(x, every)
    for _ in range(60):
        # an event is done on its own, whatever the others of its batch need
        own = every[np.abs(r).max(axis=1) >= 1e-11]
        if not len(own):
            break
        y, q = x[own], r[own]
        jac = np.stack([(residual(y + eps * np.eye(2)[c], own) - q) / eps for c in range(2)], axis=2)
        det = jac[:, 0, 0] * jac[:, 1, 1] - jac[:, 0, 1] * jac[:, 1, 0]
        det = np.where(np.abs(det) < 1e-14, np.inf, det)
        step = -np.column_stack([(jac[:, 1, 1] * q[:, 0] - jac[:, 0, 1] * q[:, 1]) / det, (jac[:, 0, 0] * q[:, 1] - jac[:, 1, 0] * q[:, 0]) / det])
        size, best, open_ = np.ones(len(own)), np.linalg.norm(q, axis=1), np.arange(len(own))
        for _ in range(20):
            trial = residual(np.clip(y[open_] + size[open_, None] * step[open_], *bound), own[open_])
            open_ = open_[np.linalg.norm(trial, axis=1) >= best[open_]]
            if not len(open_):
                break
            size[open_] /= 2
        x[own] = np.clip(y + size[:, None] * step, *bound)
        r[own] = residual(x[own], own)
    return np.exp(x[:, 0]), np.exp(x[:, 1]), np.linalg.norm(r, axis=1)


def _text(x: float) -> str:
    return f"{x + 0.0:g}" if x else "0"


def price_sheet(home: np.ndarray, away: np.ndarray, share: float = FIRST_HALF, rho: float = LOW_SCORE) -> dict[str, np.ndarray]:
    """Chance of every key of the sheet, for all events at once."""
    ft = score_matrices(home, away, rho=rho)
    h1, h2 = score_matrices(home * share, away * share, rho=rho), score_matrices(home * (1 - share), away * (1 - share), rho=rho)
    i, j = _grid(GOALS)
    s: dict[str, np.ndarray] = {}
    part = lambda mask: ft[:, mask].sum(1)
    bands = {"1": i > j, "X": i == j, "2": i < j}
    r = results(ft)
    for k, x in enumerate(_R):
        s[f"ft_1x2:{x}"] = r[:, k]
    s |= {"dc:1X": r[:, 0] + r[:, 1], "dc:12": r[:, 0] + r[:, 2], "dc:X2": r[:, 1] + r[:, 2], "dnb:1": r[:, 0] / (r[:, 0] + r[:, 2]), "dnb:2": r[:, 2] / (r[:, 0] + r[:, 2])}
    # half-time and full-time: the second half's goal difference decides from each half-time difference
    size = 2 * GOALS - 1
    diff = lambda m: np.stack([m[:, i - j == d].sum(1) for d in range(-GOALS + 1, GOALS)], axis=1)
    d1, d2, at = diff(h1), diff(h2), np.arange(-GOALS + 1, GOALS)
    joint, final = d1[:, :, None] * d2[:, None, :], at[:, None] + at[None, :]
    sign = {"1": 1, "X": 0, "2": -1}
    for a in _R:
        for b in _R:
            mask = (np.sign(at)[:, None] == sign[a]) & (np.sign(final) == sign[b])
            s[f"htft:{a}/{b}"] = joint.reshape(-1, size * size)[:, mask.ravel()].sum(1)
    for tag, m in (("ht", h1), ("h2", h2)):
        for k, x in enumerate(_R):
            s[f"{tag}_1x2:{x}"] = results(m)[:, k]
    for tag, m, top in (("ft", ft, 7), ("h1", h1, 4), ("h2", h2, 4)):
        for g in range(top):
            p = over(m, g + 0.5)
            s[f"{tag}_total:over_{g}.5"], s[f"{tag}_total:under_{g}.5"] = p, 1 - p
    for q in range(-16, 17):
        line = q / 4
        p = handicap(ft, line)
        s[f"ah:home_{_text(line)}"], s[f"ah:away_{_text(-line)}"] = p, 1 - p
    for k in (-3, -2, -1, 1, 2, 3):
        for x, mask in (("1", i + k > j), ("X", i + k == j), ("2", i + k < j)):
            s[f"eh:{k:+d}:{x}"] = part(mask)
    for side, marginal in (("home", ft.sum(2)), ("away", ft.sum(1))):
        for g in range(4):
            p = marginal[:, g + 1 :].sum(1)
            s[f"tt_{side}:over_{g}.5"], s[f"tt_{side}:under_{g}.5"] = p, 1 - p
    both = (i > 0) & (j > 0)
    s["btts:yes"], s["btts:no"] = part(both), part(~both)
    for x, mask in bands.items():
        s[f"btts_res:yes&{x}"], s[f"btts_res:no&{x}"] = part(both & mask), part(~both & mask)
        for g in (1.5, 2.5, 3.5):
            s[f"res_tot:{x}&over_{g}"], s[f"res_tot:{x}&under_{g}"] = part(mask & (i + j > g)), part(mask & (i + j < g))
    for a in range(6):
        for b in range(6):
            s[f"cs:{a}-{b}"] = ft[:, a, b]
    s["cs:other"] = part((i > 5) | (j > 5))
    s |= {"wtn:home": part((i > 0) & (j == 0)), "wtn:away": part((i == 0) & (j > 0)), "cleansheet:home": part(j == 0), "cleansheet:away": part(i == 0)}
    t = totals(ft)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (1, 3), (2, 4), (0, 2), (0, 3), (2, 5), (1, 4), (4, 6)):
        s[f"multigoal:{a}-{b}"] = t[:, a : b + 1].sum(1)
    for g in range(7):
        s[f"exact:{g}"] = t[:, g]
    s |= {"exact:7+": t[:, 7:].sum(1), "parity:odd": t[:, 1::2].sum(1), "parity:even": t[:, ::2].sum(1)}
    t1, t2 = totals(h1), totals(h2)
    goals = t1[:, :, None] * t2[:, None, :]
    a, b = np.indices(goals.shape[1:])
    s |= {"high_half:h1": goals[:, a > b].sum(1), "high_half:h2": goals[:, a < b].sum(1), "high_half:equal": goals[:, a == b].sum(1)}
    yes = (1 - t1[:, 0]) * (1 - t2[:, 0])
    s |= {"both_halves_goal:yes": yes, "both_halves_goal:no": 1 - yes}
    return s


def _spread(df: DataFrame) -> DataFrame:
    """Few bytes but much work a row: over all tasks, whatever their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rates(anchors: DataFrame, key: list[str], method: str = "power") -> DataFrame:
    """Goal rates of events. anchors: key, h, d, a (prices), and line, o, u of the main total or nulls. Adds lh, la, residual; rows without
    three valid prices are left out."""
    kinds = dict(anchors.dtypes)
    devig = power if method == "power" else shin

    def run(batches):
        for b in batches:
            p = devig(b[["h", "d", "a"]].to_numpy(float))
            ok = np.isfinite(p).all(axis=1)
            if ok.any():
                b, p = b[ok], p[ok]
                main = devig(b[["o", "u"]].to_numpy(float))[:, 0]
                lh, la, residual = fit_rates(p[:, 0], p[:, 1], b["line"].to_numpy(float), np.where(b["line"].isna(), np.nan, main))
                yield b[key].assign(lh=lh, la=la, residual=residual)

    return _spread(anchors).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", lh double, la double, residual double")


#: Fixed value: events of which sheets are held in memory at once.
SHEETS_AT_ONCE = 1000


def _parts(batches):
    for b in batches:
        for i in range(0, len(b), SHEETS_AT_ONCE):
            yield b.iloc[i : i + SHEETS_AT_ONCE].reset_index(drop=True)


def _priced(b: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Keys of the sheet, and by event and key the chance and the least chance at the other shares."""
    lh, la = b["lh"].to_numpy(float), b["la"].to_numpy(float)
    main, others = price_sheet(lh, la), [price_sheet(lh, la, x) for x in OTHER_SHARES]
    names = list(main)
    return names, np.column_stack([main[n] for n in names]), np.minimum.reduce([np.column_stack([o[n] for n in names]) for o in others])


def sheets(fitted: DataFrame, key: list[str]) -> DataFrame:
    """Long sheet: key, market, prob, odds and robust_lo, the least chance at the other shares of the first half."""
    kinds = dict(fitted.dtypes)

    def run(batches):
        for b in _parts(batches):
            names, prob, least = _priced(b)
            out = pd.DataFrame({"market": np.tile(names, len(b)), "prob": prob.ravel(), "robust_lo": least.ravel()})
            for k in key:
                out[k] = np.repeat(b[k].to_numpy(), len(names))
            out["odds"] = 1 / np.maximum(out["prob"], 1e-12)
            yield out[[*key, "market", "prob", "odds", "robust_lo"]]

    return _spread(fitted).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", market string, prob double, odds double, robust_lo double")


def model_values(posted: DataFrame, sheet: DataFrame, key: list[str]) -> DataFrame:
    """Posted prices of derived markets that beat the model's fair ones; robust if they do at the other shares, too. posted: key, market, posted."""
    return _better(_derived(posted).join(sheet, [*key, "market"]), key)


def posted_values(posted: DataFrame, fitted: DataFrame, key: list[str]) -> DataFrame:
    """model_values() on the sheets of fitted rates (key, lh, la). Each event's posted prices meet its sheet where it is made, so no sheet, hundreds
    of rows an event, is shuffled or taken for small and broadcast. An event's posted prices are of bounded number."""
    kinds = dict(fitted.dtypes)

    def run(batches):
        for b in _parts(batches):
            names, prob, least = _priced(b)
            place = {n: i for i, n in enumerate(names)}
            sizes = [len(p) for p in b["_posted"]]
            told = [(place.get(r["market"], -1), r["market"], r["posted"]) for p in b["_posted"] for r in p]
            col, row = np.array([t[0] for t in told], dtype=int), np.repeat(np.arange(len(b)), sizes)
            known = col >= 0
            out = b.loc[row[known], key].reset_index(drop=True)
            chance = prob[row[known], col[known]]
            yield out.assign(market=[t[1] for t in told if t[0] >= 0], posted=[t[2] for t in told if t[0] >= 0], prob=chance, odds=1 / np.maximum(chance, 1e-12), robust_lo=least[row[known], col[known]])

    by = _derived(posted).groupBy(*key).agg(F.collect_list(F.struct("market", "posted")).alias("_posted"))
    rows = _spread(fitted.select(*key, "lh", "la").join(by, key))
    return _better(rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", market string, posted double, prob double, odds double, robust_lo double"), key)


def _derived(posted: DataFrame) -> DataFrame:
    return posted.where(~F.col("market").startswith("ft_1x2:") & (F.col("posted") >= SHORTEST))


def _better(j: DataFrame, key: list[str]) -> DataFrame:
    j = j.where(F.col("odds") <= LONGEST)
    least = F.when((F.col("odds") > 8.0) | F.col("market").startswith("cs:"), LEAST_EV_TAIL).otherwise(LEAST_EV)
    j = j.withColumns({"ev": F.col("posted") * F.col("prob") - 1, "robust": F.col("posted") * F.col("robust_lo") - 1 >= least})
    return j.where(F.col("ev") >= least).select(*key, "market", "posted", F.col("odds").alias("fair"), "ev", "robust")


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """By integrating the density from 0; beyond 9 the rest is below what a double resolves."""
    x = np.clip(np.asarray(x, dtype=float), -9.0, 9.0)
    t = x[..., None] / 2 * (_NODES + 1)
    return 0.5 + x / 2 * (np.exp(-t * t / 2) * _WEIGHTS).sum(-1) / np.sqrt(2 * np.pi)


def margin_of(win: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The expected margin at which the home side wins with the given chance."""
    lo, hi = np.full_like(win, -9.0), np.full_like(win, 9.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = _normal_cdf(mid) < win
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return sigma * (lo + hi) / 2


def bivariate_cdf(a: np.ndarray, b: np.ndarray, rho: float) -> np.ndarray:
    """P(X <= a, Y <= b) of standard normals: the density integrated over the correlation (20 Gauss-Legendre nodes)."""
    nodes, weights = np.polynomial.legendre.leggauss(20)
    t = rho / 2 * (nodes + 1)
    a, b = np.clip(a, -38, 38)[..., None], np.clip(b, -38, 38)[..., None]
    f = np.exp(-(a * a - 2 * t * a * b + b * b) / (2 * (1 - t * t))) / np.sqrt(1 - t * t)
    return _normal_cdf(a[..., 0]) * _normal_cdf(b[..., 0]) + rho / 2 * (f * weights).sum(-1) / (2 * np.pi)


def half_full_fair(mu: np.ndarray, mu1: np.ndarray | None = None, sigma: np.ndarray | float = MARGIN_SIGMA, rho: float = MARGIN_CORRELATION, nine: bool = True) -> dict[str, np.ndarray]:
    """Fair chances of half-time/full-time outcomes from expected margins, bands of half a point around a tie. With six outcomes the
    full-time tie is split between the sides."""
    mu1 = mu / 2 if mu1 is None else mu1
    edge = lambda m, s: [np.full_like(mu, -np.inf), (-0.5 - m) / s, (0.5 - m) / s, np.full_like(mu, np.inf)]
    h, f = edge(mu1, sigma * rho), edge(mu, sigma + 0 * mu)
    c = np.array([[bivariate_cdf(x, y, rho) for y in f] for x in h])
    cell = lambda r, k: c[r + 1, k + 1] - c[r, k + 1] - c[r + 1, k] + c[r, k]
    order = {"2": 0, "X": 1, "1": 2}
    out = {f"{a}/{b}": cell(order[a], order[b]) for a in _R for b in _R}
    if not nine:
        out = {f"{a}/{b}": out[f"{a}/{b}"] + out[f"{a}/X"] / 2 for a in _R for b in ("1", "2")}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def sigma_of(league: pd.Series) -> np.ndarray:
    low = league.fillna("").str.lower()
    out = np.full(len(low), MARGIN_SIGMA)
    for word, s in reversed(MARGIN_SIGMAS):
        out = np.where(low.str.contains(word, regex=False), s, out)
    return out


def half_full_sheet(events: DataFrame, key: list[str], *, combo: str | None = None, win: str | None = None) -> DataFrame:
    """key, outcome, prob for events with mu (expected margin of home), mu1 (of the half, or null) and league.

    combo: column with the posted prices by outcome; without one that ends in X there are six outcomes, else (or without the column) nine.
    win: column with the chance of home that stands in for an unknown mu. Events with neither are left out."""
    kinds = dict(events.dtypes)
    nine = F.lit(True) if combo is None else F.exists(F.map_keys(combo), lambda k: k.endswith("/X"))
    work = events.select(*key, "mu", "mu1", "league", (F.lit(None).cast("double") if win is None else F.col(win)).alias("_win"), F.coalesce(nine, F.lit(True)).alias("_nine"))

    def run(batches):
        for b in batches:
            sigma = sigma_of(b["league"])
            mu, mu1, win = (b[c].to_numpy(float) for c in ("mu", "mu1", "_win"))
            mu = np.where(np.isnan(mu), margin_of(np.nan_to_num(win, nan=0.5), sigma), mu)
            mu1 = np.where(np.isnan(mu1), mu / 2, mu1)
            for wide in (True, False):
                own = b["_nine"].to_numpy(bool) == wide
                if own.any():
                    got = half_full_fair(mu[own], mu1[own], sigma[own], nine=wide)
                    out = b.loc[own, key].iloc[np.repeat(np.arange(own.sum()), len(got))]
                    yield out.assign(outcome=np.tile(list(got), own.sum()), prob=np.column_stack(list(got.values())).ravel())

    return work.where("mu IS NOT NULL OR _win IS NOT NULL").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", outcome string, prob double")


def _least_squares(f, x: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Gauss-Newton with halved steps."""
    r = f(x)
    for _ in range(rounds):
        jac = np.column_stack([(f(x + 1e-5 * e) - r) / 1e-5 for e in np.eye(len(x))])
        step = np.linalg.solve(jac.T @ jac + 1e-9 * np.eye(len(x)), -jac.T @ r)
        size = 1.0
        while size > 1e-6 and not (np.square(f(x + size * step)).sum() < np.square(r).sum()):
            size /= 2
        if size <= 1e-6:
            break
        x = np.clip(x + size * step, *np.log(RATES))
        r = f(x)
        if np.square(r).sum() < 1e-16:
            break
    return x


def _total_over(rate: float, lines: np.ndarray) -> np.ndarray:
    p = _pmf(np.array([rate]), 24)[0]
    return np.array([p[np.arange(24) > x].sum() for x in lines])


def ladder_curves(ladders: DataFrame, key: list[str]) -> DataFrame:
    """Rungs off the curve that fits their ladder, of ladders with three rungs or more: a Skellam curve for kind 'ah', a Poisson one for
    'total'. ladders: key, kind, line, x, y (prices of home and away, or over and under). Result: key, kind, line, seen, fitted, points.
    A ladder is one market of one event and so of bounded size."""
    kinds = dict(ladders.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(seen=power(pdf[["x", "y"]].to_numpy(float))[:, 0]).dropna(subset=["seen"]).drop_duplicates("line").sort_values("line")
        if len(pdf) < 3:
            return pdf.assign(fitted=0.0, points=0.0).iloc[:0][[*key, "kind", "line", "seen", "fitted", "points"]]
        lines, seen = pdf["line"].to_numpy(float), pdf["seen"].to_numpy(float)
        if pdf["kind"].iloc[0] == "ah":
            curve = lambda x: (lambda m: np.array([handicap(m, v)[0] for v in lines]))(score_matrices(np.exp(x[:1]), np.exp(x[1:])))
            start = np.log([1.3, 1.3])
        else:
            curve = lambda x: _total_over(float(np.exp(x[0])), lines)
            start = np.log([2.6])
        fitted = curve(_least_squares(lambda x: curve(x) - seen, start))
        pdf = pdf.assign(fitted=fitted, points=(seen - fitted) * 100)
        return pdf.loc[pdf["points"].abs() >= CURVE_POINTS, [*key, "kind", "line", "seen", "fitted", "points"]]

    return ladders.groupBy(*key, "kind").applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in key) + ", kind string, line double, seen double, fitted double, points double")


def cross_fit(ladders: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Events whose supremacy or total by their ladders differs from that of the anchor rates (key, lh, la): gap_s, gap_t."""
    kinds = dict(ladders.dtypes)

    def fit(k, rungs: pd.DataFrame, anchor: pd.DataFrame) -> pd.DataFrame:
        cols = [*key, "gap_s", "gap_t"]
        rungs = rungs.assign(seen=power(rungs[["x", "y"]].to_numpy(float))[:, 0]).dropna(subset=["seen"]).drop_duplicates(["kind", "line"])
        ah, tot = (rungs[rungs["kind"] == n] for n in ("ah", "total"))
        if not len(anchor) or (len(ah) < 3 and len(tot) < 3):
            return pd.DataFrame(columns=cols)

        def residual(x):
            out = []
            if len(ah) >= 3:
                m = score_matrices(np.exp(x[:1]), np.exp(x[1:]))
                out.append(np.array([handicap(m, v)[0] for v in ah["line"]]) - ah["seen"].to_numpy())
            if len(tot) >= 3:
                out.append(_total_over(float(np.exp(x).sum()), tot["line"].to_numpy()) - tot["seen"].to_numpy())
            return np.concatenate(out)

        lh, la = np.exp(_least_squares(residual, np.log([1.3, 1.3])))
        s, t = abs(anchor["lh"].iloc[0] - anchor["la"].iloc[0] - (lh - la)), abs(anchor["lh"].iloc[0] + anchor["la"].iloc[0] - (lh + la))
        return pd.DataFrame([(*k, s, t)], columns=cols) if s >= SUPREMACY_GAP or t >= TOTAL_GAP else pd.DataFrame(columns=cols)

    return ladders.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in key) + ", gap_s double, gap_t double")
