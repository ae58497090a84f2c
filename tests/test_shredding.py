import json

from oddsloom.operators.shredding import cut, flat, load, paths, plan_tables, plain, shred


def test_loading_and_plain_values():
    assert load("﻿{\"a\": 1}") == {"a": 1}
    assert load(json.dumps(json.dumps({"a": [1]}))) == {"a": [1]}
    assert load('{"a": 1') is None and load(None) is None and load("") is None and load("[" * 100_000) is None
    assert [plain(x) for x in (7, 7.0, 7.5, "7", True, None, 1e30)] == ["7", "7", "7.5", "7", "true", None, "1e+30"]


DOCS = [
    {"id": 1, "meta": {"a": {"b": 5}}, "games": [{"g": 10, "outs": [{"o": 1}, {"o": 2}]}, {"g": 11}]},
    {"id": "2", "games": {"g": 12, "outs": {"o": 3}}},
    {"id": 3.0, "games": {"0": {"g": 13}, "1": {"g": "14", "outs": json.dumps([{"o": 4}])}}},
    {"id": 4, "games": None},
    {"id": 5, "games": [], "next": {"id": 6, "next": {"id": 7}}},
]


def shredded(spark, docs, **kw):
    rows = [(i, "f", d if isinstance(d, str) or d is None else json.dumps(d), "x") for i, d in enumerate(docs)]
    return shred(spark.createDataFrame(rows, "pid long, feed string, body string, tab string"), ident="pid", feed="feed", body="body", **kw)


def test_tables_keys_and_inlining(spark):
    rows = shredded(spark, DOCS, keys={"f": {"$": "id", "$.games": "g"}})
    games = {(r.pid, r.parent_key, r.g, r.ordinal) for r in flat(rows, "f", "$.games", ["g"]).collect()}
    assert games == {(0, "1", "10", 0), (0, "1", "11", 1), (1, "2", "12", 0), (2, "3", "13", 0), (2, "3", "14", 1)}
    outs = {(r.parent_key, r.o) for r in flat(rows, "f", "$.games.outs", ["o"]).collect()}
    assert outs == {("10", "1"), ("10", "2"), ("12", "3"), ("14", "4")}
    root = {r.pid: r for r in flat(rows, "f", "$", ["id", "meta.a.b"]).collect()}
    assert root[0]["meta.a.b"] == "5"
    ids = [(r.pid, r.row_id) for r in rows.collect()]
    assert len(ids) == len(set(ids))
    known = set(ids)
    assert all((r.pid, r.parent_id) in known for r in rows.where("parent_id IS NOT NULL").collect())


def test_recursive_elements_share_a_table():
    from collections import Counter

    seen = Counter()
    for d in DOCS:
        paths(d, "$", seen)
    plan = plan_tables([(p, k, n) for (p, k), n in seen.items()])
    assert plan.same.get("$.next.next", "$.next") == "$.next"
    tabs = Counter(r[0] for r in cut(DOCS[4], plan, {}))
    assert tabs["$"] == 1


def test_bad_bodies_keyed_elements_and_nothing(spark):
    docs = [None, "", "{", '{"a": ', "5", '"text"', [["k1", {"n": 1}], [2, {"n": 2}]], {"101": {"n": 3}, "102": {"n": None}}, [None, 3]]
    rows = shredded(spark, docs)
    got = {(r.pid, r["@key"], r.n) for r in flat(rows, "f", "$", ["@key", "n"]).collect() if r.pid in (6, 7)}
    assert got == {(6, "k1", "1"), (6, "2", "2"), (7, "101", "3"), (7, "102", None)}
    assert {r.pid for r in rows.collect()} <= {6, 7, 8}
    assert shredded(spark, docs[:0] + [None]).count() == 0


def test_declared_repeats_hold_for_lone_objects(spark):
    rows = shredded(spark, [{"id": 1, "games": {"g": 9}}], repeated={"f": ["$.games"]}, keys={"f": {"$": "id"}})
    assert [(r.parent_key, r.g) for r in flat(rows, "f", "$.games", ["g"]).collect()] == [("1", "9")]


def test_depth_is_no_limit(spark):
    """Recursive objects, nested lists and names that differ on every level, thousands of levels down; none is lost."""
    def nest(n, wrap):
        text = '{"v": 0}'
        for i in range(n):
            text = wrap(i, text)
        return text

    docs = [nest(5_000, lambda i, t: f'{{"id": {i}, "next": {t}}}'), nest(20_000, lambda i, t: f"[{t}]"), nest(1_500, lambda i, t: f'{{"k{i}": {t}}}')]
    rows = shredded(spark, docs).select("pid", "row_id", "parent_id", "columns").collect()
    ids = {(r.pid, r.row_id) for r in rows}
    assert len(ids) == len(rows) and all((r.pid, r.parent_id) in ids for r in rows if r.parent_id)
    of = lambda pid: [r.columns for r in rows if r.pid == pid]
    assert sum(k == "id" or k.endswith(".id") for c in of(0) for k in c) == 5_000
    assert all(any(k == "v" or k.endswith(".v") for c in of(pid) for k in c) for pid in range(3))
