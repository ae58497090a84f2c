import os

import numpy as np
import pytest

import __spark_entry__ as entry
from oddsloom.functions import text as tx
from oddsloom.operators import fixture_blocks as fb
from oddsloom.operators import fixtures as fx

D = "/root/testdata/sf0.001"
RESOLVED = ["ev_edges", "arb_edges", "matches_resolved", "opportunities", "shared_id_grid"]


def test_bounds_are_never_below_the_likeness():
    said = ["", "rovers", "kofo rovers", "belu rovers", "rovers kofo", "abc", "alba beta ceda", "u19 city", "lumidara", "lumidaro city", "a/b", "café", "z" * 70, "x x y", "kofos"]
    names = fb.Names(said)
    i, j = np.divmod(np.arange(len(said) ** 2), len(said))
    exact = np.array([tx.token_set(said[a], said[b]) for a, b in zip(i, j)])
    bound = names.bound(i, j)
    sharper = names.sharper(i, j, bound)
    assert (bound >= exact - 1e-9).all() and (sharper >= exact - 1e-9).all()
    apart = np.array([not set(said[a].split()) & set(said[b].split()) for a, b in zip(i, j)]) & (names.words[i] & names.words[j] == 0) & names.fits[i] & names.fits[j]
    assert apart.sum() > 100 and np.allclose(sharper[apart], exact[apart])


def test_matches_in_blocks_are_those_of_all_pairs(spark):
    schema = "id long, book string, sport string, home string, away string, league string, start long"
    names = [("Kofo Rovers", "Belu City"), ("Lumidara", "AC Tarno"), ("Sotikhanur FC U-19", "Defupani U19"), ("ABC", "Fohebasal United"), (None, "Belu City"), ("Albion", "Kofo Rovers")]
    turned = [("kofo rovrs", "belu ciy"), ("Tarno", "Lumidara"), ("Sotikhanur U19", "Defupani Dynamo U19"), ("Alba Beta Ceda", "Fohebasal Utd"), ("x", "y"), ("Albion", "Rovers Kofo")]
    ref = [(i, "apex", "soccer", h, a, None, None if i == 5 else i * 1000) for i, (h, a) in enumerate(names)]
    soft = [(100 + 10 * k + i, book, "soccer", h, a, None, None if i == k else i * 1000 + 3000 * k) for k, book in enumerate(["x", "y"]) for i, (h, a) in enumerate(turned)]
    a, b = spark.createDataFrame(soft, schema), spark.createDataFrame(ref, schema)
    got = {tuple(r) for r in fx.matches(a, b, ("book",)).collect()}
    assert len(got) >= 6 and got == {tuple(r) for r in fx.match_fixtures(a, b, ("book",))[0].collect()}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", RESOLVED)
def test_resolved_queries_make_no_row_of_every_pair(spark, monkeypatch, name):
    query, rows = entry.queries()[name], lambda df: sorted(str(r) for r in df.collect())
    with monkeypatch.context() as m:
        m.setattr(fx, "matches", lambda *a: fx.match_fixtures(*a)[0], raising=False)
        want = rows(query(spark, D))
    monkeypatch.setattr(fx, "scored_pairs", None)
    assert rows(query(spark, D)) == want
