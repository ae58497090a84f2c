"""Likeness of fixtures as arrays against the likeness of one pair."""

import random

import numpy as np
import pandas as pd

from oddsloom.functions import text as tx
from oddsloom.operators import fixture_blocks as fb
from oddsloom.operators import fixtures as fx

ODD = ["", "abc", "alba beta ceda", "rovers rovers city", "a/b c", "ab c/d e", "café rovers", "z" * 70, "a b c d e f g h i j", "x"]


def _names(n: int = 120) -> list[str]:
    rng = random.Random(5)
    stems = ["".join(rng.choice("klmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    return ODD + list(dict.fromkeys(" ".join(rng.sample([*stems, "rovers", "city", "united"], rng.randint(1, 4))) for _ in range(n)))


def test_fixtures_scored_as_arrays_are_as_one_by_one(monkeypatch):
    said = _names()
    names = fb.Names(said)
    i, j = np.divmod(np.arange(len(said) ** 2), len(said))
    assert (names.likeness(i, j) == np.array([tx.token_set(said[a], said[b]) for a, b in zip(i, j)])).all()
    rng = np.random.default_rng(1)
    sides = rng.integers(0, len(said), (4, 20_000))
    sides[2:, :8000] = sides[1::-1, :8000]  # the sides changed
    sides[0, :4000] = rng.integers(0, len(said), 4000)
    got = list(zip(*fx.likenesses(names, *sides)))
    assert got == [fx.likeness(*(said[x] for x in four))[:3] for four in sides.T] and sum(flipped for *_, flipped in got) > 1000
    plain = np.flatnonzero(names.fits)
    monkeypatch.setattr(fb, "token_set", None)
    names.likeness(rng.choice(plain, 1000), rng.choice(plain, 1000))


def test_unknown_kickoffs_meet_by_bounds_not_below_the_likeness():
    said = _names()
    names = fb.Names(said)
    every = np.arange(len(said))
    i, j = np.divmod(np.arange(len(said) ** 2), len(said))
    half = fb._half_bounds(names, every, every, fx.MEDIUM)
    lifted = np.where(names.short[i] | names.short[j], fx.MEDIUM, 0)
    assert (half.ravel() == np.ceil(np.maximum(names.bound(i, j), lifted)).astype(int) // 2).all()
    rows = lambda side, names_: pd.DataFrame({"n_home": [h for h, _ in names_], "n_away": [a for _, a in names_], "_kind": 1, "sport": "s", "_bk": 0, "_part": 0, "_side": side, "start": None, "win": 3600})
    rng = random.Random(2)
    soft, ref = ([(rng.choice(said), rng.choice(said)) for _ in range(n)] for n in (40, 90))
    f = pd.concat([rows(0, soft), rows(1, ref + [(a, h) for h, a in soft])], ignore_index=True)
    got = {(i, j): (m, low, flip) for i, j, m, low, flip in zip(*fb.candidates(f, fx._may_be_accepted, (fx.STRONG, fx.FLIP_MEAN, fx.MEDIUM)))}
    n, want = f[["n_home", "n_away"]].to_numpy(), {}
    for a in range(40):
        for b in range(40, len(f)):
            m = fx.likeness(*n[a], *n[b])[:3]
            if m[0] >= fx.STRONG and m[1] >= fx.LEAST_SIDE:
                want[a, b] = m
    assert got == want and len(got) >= 30
