import json

from pyspark.sql import functions as F

from oddsloom.sources import feeds as fd
from oddsloom.sources import titles as ti
from oddsloom.sources.html_pages import hidden_fields, paired_cells


def classes(spark, f, rows):
    df = spark.createDataFrame(rows, "i int, sport string, title string").withColumn("c", f("title", F.col("sport")))
    return {r.i: None if r.c is None else (r.c.market_type, r.c.period, r.c.rank, r.c.n_way, r.c.submarket, r.c.team_side) for r in df.collect()}


STRICT = [
    ("basketball", "Winner (incl. overtime)", ("moneyline", "FT", 0, 2, None, None)), ("basketball", "Total points (regular time)", ("total", "FT", 1, 2, None, None)), ("basketball", "2nd Half - Total", ("total", "H2", 1, 2, None, None)),
    ("basketball", "2nd half - total (incl. overtime)", ("total", "H2", 0, 2, None, None)), ("basketball", "4rt. quarter - total points *", ("total", "Q4", 0, 2, None, None)), ("basketball", "1x2", None), ("basketball", "Home team total", None),
    ("basketball", "3rd quarter -  Asian Handicap", ("spread", "Q3", 0, 2, None, None)), ("soccer", "1X2", ("moneyline", "FT", 0, 3, None, None)), ("soccer", "Total corners*", ("total", "FT", 0, 2, "corners", None)), ("soccer", "Total corners***", None),
    ("soccer", "1st Half - Home team total", ("team_total", "H1", 0, 2, None, "home")), ("soccer", "1st half - corner handicap hcp=-1.5", ("spread", "H1", 0, 2, "corners", None)), ("soccer", "Double chance", None), ("soccer", "Handicap & total", None), ("tennis", "Winner", None),
    ("soccer", None, None), ("soccer", "", None),
]
PERMISSIVE = [
    ("basketball", "Halftime/Fulltime", ("htft", "FT", 0, 2, None, None)), ("basketball", "HT/FT and total", ("total", "FT", 0, 2, None, None)), ("basketball", "1st Half - 1x2", ("moneyline", "H1", 0, 3, None, None)), ("basketball", "Handicap 2nd quarter (regular time)", ("spread", "Q2", 1, 2, None, None)),
    ("basketball", "Player total assists", None), ("basketball", "Total 1st. period", ("total", "H1", 0, 2, None, None)), ("soccer", "Half Time / Full Time", ("htft", "FT", 0, 2, None, None)), ("soccer", "HT/FT exact goals", None), ("soccer", "Handicap", ("spread", "FT", 0, 2, None, None)),
]


def test_titles(spark):
    for f, cases in ((ti.strict_class, STRICT), (ti.permissive_class, PERMISSIVE)):
        got = classes(spark, lambda t, s: f(F.col(t), s), [(i, s, t) for i, (s, t, _) in enumerate(cases)])
        assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_names_of_markets(spark):
    df = spark.createDataFrame([(n,) for n in ("Full Time Result", "Handicap ①", "1st Half Total ②", "Total (OT)", "Corners", None)], "n string").select(ti.named_market(F.col("n")).alias("c"))
    assert [None if r.c is None else tuple(r.c) for r in df.collect()] == [("moneyline", 3), ("spread", 2), None, ("total", 2), None, None]
    names = ["Half time / Full time", "HT/FT", "Half time/full time or goals", "1st half - result", "First half result", "12 halftime", "1st half total", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(ti.half_full_name(F.col("n")).alias("a"), ti.first_half_name(F.col("n")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(True, False), (True, False), (False, False), (False, True), (False, True), (False, True), (False, False), (False, False)]


def rows_of(df):
    return sorted((r.home, r.market_type, r.period, r.line, r.team_side, tuple(sorted(r.selections.items()))) for r in df.collect())


def test_feed_a(spark):
    match = {"id": 7, "homeId": 1, "awayId": 2, "tourId": 3, "startTime": "2026-02-01T10:00:00", "meta": {"matchProvider": {"matchId": "sr:match:55"}}, "markets": {
        "a": {"typeId": 10, "outcomes": {"1": {"value": 2.0}, "2": {"value": 3.1}, "3": {"value": 4.0}}}, "b": {"typeId": 11, "specifier": {"total": "2.5"}, "outcomes": {"4": {"value": 1.9}, "5": {"value": 1.8}}},
        "c": {"typeId": 12, "specifier": {"hcp": "9"}, "outcomes": {"1": {"value": 1.7, "specifier": {"hcp": "-1.5"}}, "3": {"value": 2.1}}}, "d": {"typeId": 11, "outcomes": {"4": {"value": 1.9}, "5": {"value": 1.8}}},
        "e": {"typeId": 13, "outcomes": {"1": {"value": 1.5}, "3": {"value": 2.5}}}, "f": {"typeId": 14, "outcomes": {"1": {"value": 1.0}, "3": {"value": 2.5}}},
    }}
    virtual = {**match, "id": 8, "tourId": 4}
    ancestors = spark.createDataFrame([("1", " Alpha ", None), ("2", "Beta", None), ("3", "Cup", "9"), ("4", "Tour", "5"), ("5", "Simulated Reality", None), ("9", "Country", None)], "id string, name string, parent string")
    labels = {"1": "1", "2": "X", "3": "2", "4": "Over", "5": "Under"}
    types = spark.createDataFrame([("10", "Full Time Result", labels), ("11", "Total", labels), ("12", "Handicap", labels), ("13", "1st Half Winner", labels), ("14", "Winner", labels)], "id string, name string, labels map<string,string>")
    got = fd.feed_a(spark.createDataFrame([(json.dumps(match),), (json.dumps(virtual),), (None,)], "m string"), ancestors, types, source="a", sport="soccer")
    assert rows_of(got) == [("Alpha", "moneyline", "FT", None, None, (("away", 4.0), ("draw", 3.1), ("home", 2.0))), ("Alpha", "spread", "FT", -1.5, None, (("away", 2.1), ("home", 1.7))), ("Alpha", "total", "FT", 2.5, None, (("over", 1.9), ("under", 1.8)))]
    assert {r.sr_match_id for r in got.collect()} == {"55"}


EVENT = "sport string, home string, away string, league string, start_time timestamp_ntz, raw_event_id string, sr_match_id string"


def test_feed_c(spark):
    ev = ("basketball", "A", "B", "L", None, "1", None)
    rows = [(*ev, "g1", -2527, 3.5, "1", 1.5), (*ev, "g1", -2527, 3.5, "2", 2.5), (*ev, "g2", -2966, 160.5, "მეტი", 1.9), (*ev, "g2", -2966, 160.5, "ნაკლები", 1.9), (*ev, "g3", -2950, None, "1", 1.9), (*ev, "g3", -2950, None, "2", 1.9),
            (*ev, "g4", 182, 80.5, "მეტი", 1.8), (*ev, "g4", 182, 80.5, "ნაკლები", 1.0), (*ev, "g5", 99999, 1.0, "1", 1.8)]
    got = rows_of(fd.feed_c(spark.createDataFrame(rows, EVENT + ", game_id string, game_type int, argument double, outcome string, price double"), source="c"))
    assert got == [("A", "moneyline", "FT", None, None, (("away", 2.5), ("home", 1.5))), ("A", "total", "FT", 160.5, None, (("over", 1.9), ("under", 1.9)))]


def test_feed_d(spark):
    ev = lambda i, home="A": ("basketball", home, "B", "L", None, str(i), None)
    own = [(*ev(1), None, None, 2, 7, -3.5, 1.9), (*ev(1), None, None, 2, 8, 3.5, 1.8), (*ev(1), None, None, 2, 7, 0.0, 2.0), (*ev(1), None, None, 2, 8, 0.0, 1.7)]
    same = [(*ev(2), None, None, 2, 7, -3.5, 1.9), (*ev(2), None, None, 2, 8, -3.5, 1.8)]
    rest = [(*ev(3), "1st quarter", None, 17, 9, 40.5, 1.9), (*ev(3), "1st quarter", None, 17, 10, 40.5, 1.8), (*ev(3), "1st quarter", "Statistics", 17, 9, 9.5, 1.9), (*ev(3), "1st quarter", "Statistics", 17, 10, 9.5, 1.9), (*ev(3), None, None, 101, 401, None, 1.4),
            (*ev(3), None, None, 101, 402, None, 3.0), (*ev(3), "1st quarter", None, 101, 401, None, 1.4), (*ev(4, "Team 1"), None, None, 101, 401, None, 1.4), (*ev(4, "Team 1"), None, None, 101, 402, None, 1.4), (*ev(5), None, None, 15, 11, 80.5, 1.4), (*ev(5), None, None, 15, 12, 80.5, 2.4)]
    df = spark.createDataFrame(own + same + rest, EVENT + ", part string, tag string, g int, t int, p double, c double")
    got = sorted((r.raw_event_id, r.market_type, r.period, r.line, r.team_side, tuple(sorted(r.selections.items()))) for r in fd.feed_d(df, source="d").collect())
    assert got == [
        ("1", "spread", "FT", -3.5, None, (("away", 1.8), ("home", 1.9))), ("1", "spread", "FT", 0.0, None, (("away", 1.7), ("home", 2.0))), ("2", "spread", "FT", -3.5, None, (("away", 1.8), ("home", 1.9))),
        ("3", "moneyline", "FT", None, None, (("away", 3.0), ("home", 1.4))), ("3", "total", "Q1", 40.5, None, (("over", 1.9), ("under", 1.8))), ("5", "team_total", "FT", 80.5, "home", (("over", 1.4), ("under", 2.4))),
    ]


def test_feed_e(spark):
    item = lambda params, outs, removed=False: (params, removed, [(c, o, False, frozen) for c, o, frozen in outs])
    rows = [
        ("F", "e1", 1, 0, 2, 0, [item([], [(0, 210, False), (1, 320, False), (3, 400, False)])]), ("F", "e1", 1, 15, 2, 1, [item([], [(0, 210, False), (1, 320, False), (3, 400, False)])]),
        ("F", "e1", 1, 0, 5, 1, [item([1.5], [(4, 190, False), (5, 180, False)]), item([2.5], [(4, 190, True), (5, 180, False)]), item([3.5], [(4, 190, False), (5, 180, False)], True)]),
        ("F", "e1", 1, 0, 7, 0, [item([2.0, 1.5], [(37, 150, False), (38, 250, False)])]), ("F", "e1", 2, 0, 5, 0, [item([8.5], [(4, 190, False), (5, 180, False)])]), ("F", "e2", 1, 0, 2, 0, [item([], [(0, 210, False), (1, 320, False), (3, 400, False)])]),
    ]
    m = spark.createDataFrame(rows, "sport_code string, event_id string, result_kind int, sub_period int, market_code int, period_code int, items array<struct<parameters:array<double>,removed:boolean,outcomes:array<struct<code:int,odd:int,removed:boolean,frozen:boolean>>>>")
    ev = spark.createDataFrame([("e1", "soccer", 1, 1, [" A", "B"], "L", None), ("e2", "soccer", 1, 1, ["C", "D"], "Virtual League", None)], "event_id string, sport string, stage int, status int, names array<string>, league string, start_time timestamp_ntz")
    assert rows_of(fd.feed_e(m, ev, source="e")) == [
        ("A", "moneyline", "FT", None, None, (("away", 4.0), ("draw", 3.2), ("home", 2.1))), ("A", "team_total", "FT", 1.5, "away", (("over", 1.5), ("under", 2.5))), ("A", "total", "H1", 1.5, None, (("over", 1.9), ("under", 1.8))),
    ]


def test_list_view_and_horizon(spark):
    rows = [(1, 1, None, "01.02.2026", None, None), (1, 2, "Alpha - Beta", None, "01:30", "Cup"), (1, 3, "Cup winner", None, "10:00", "Cup"), (1, 4, "C - D", "02.02.2026", "20:00", "E-soccer"), (1, 5, "E - F - G", None, "20:00", None), (2, 1, "X - Y", None, "10:00", "Cup")]
    got = fd.list_view(spark.createDataFrame(rows, "page int, pos int, txt string, day string, clock string, league string"), page="page", position="pos", text="txt", day="day", clock="clock", league="league").orderBy("page", "pos").collect()
    assert [(r.pos, r.home, r.away, str(r.start_time)) for r in got if r.page == 1] == [(2, "Alpha", "Beta", "2026-01-31 21:30:00"), (5, "E", "F - G", "2026-02-02 16:00:00")]
    assert [r.start_time for r in got if r.page == 2] == [None]
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("2026-01-01 11:58:30",), ("2026-01-01 11:57:00",), ("2026-01-02 13:00:00",), (None,)], "s string").select(F.col("s").cast("timestamp_ntz").alias("s"))
    assert [r[0] for r in df.select(fd.within(F.col("s"), now, 24)).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(fd.kickoff_bucket(F.col("s"))).collect()][3] is None


def test_hidden_fields_and_cells(spark):
    html = "".join(f'<input type="hidden" name="{k}" value="{v}">' for k, v in (("a", 1), ("a", 2), ("b", 3)))
    assert spark.createDataFrame([(html,), ("",)], "h string").select(hidden_fields(F.col("h")).alias("m")).collect()[0].m == {"a": "2", "b": "3"}
    cells = [(1, 1, "s", "home", None, 1.5), (1, 2, "s", "away", None, 2.5), (1, 3, "s", "home", None, 9.0), (1, 4, "t", "over", 2.5, 1.9), (1, 5, "t", "over", 3.5, 1.9), (1, 6, "t", "under", 3.5, 1.8)]
    got = paired_cells(spark.createDataFrame(cells, "page int, seq int, section string, side string, line double, price double"), "page").collect()
    assert sorted((r.section, r.line, tuple(sorted(r.selections.items()))) for r in got) == [("s", None, (("away", 2.5), ("home", 1.5))), ("t", 3.5, (("over", 1.9), ("under", 1.8)))]
