from oddsloom.llm.minhash import Bands, bands_for, grams
from oddsloom.llm.names import link_names, linked_pairs
from oddsloom.llm.nametext import edits, monge_elkan, parse, side_marks, word_likeness


def test_the_bands_reach_their_recall():
    b, r = bands_for(0.4, 0.97)
    assert 1 - (1 - 0.4**r) ** b >= 0.97 and b * r <= 256
    f = Bands(b, r)
    same = lambda x, y: (f(grams(x)) == f(grams(y))).any()
    words = [f"{a}{c}{d}o" for a in ("tipe", "boma", "relo", "kusa") for c in ("ra", "mi", "do") for d in ("len", "pos", "tur")]
    hits = sum(same([w], [w[:3] + w[4:]]) for w in words)
    assert hits >= 0.9 * len(words)


def test_parts_and_likeness():
    assert parse("F.C. Peñófønü Albion (W)", False) == ("w", ("penofonu", "albion")) and parse("Rovers U-19", False)[0] == "u19" and parse("Club Under 21 II", False)[0] == "ru21"
    assert parse("tífabãhě w", True) == ("", ("tifabahe", "v")) and parse("SoresikeDefore", True)[1] == ("soresike", "defore") and parse("", False) == ("", ())
    assert side_marks("Premier Division, Women") == "w" and side_marks("Cup U21") == "u21" and side_marks("Second Division Reserves") == "r" and side_marks(None) == ""
    assert edits("abcd", "abdc", 2) == 1 and edits("abcd", "xyzw", 2) == 3
    assert word_likeness("robert", "bob") > 0.9 and word_likeness("rvrs", "rovers") > 0.9 and word_likeness("albion", "rovers") == 0 and word_likeness("d", "daniel") == 0.9 and word_likeness("a", "daniel") == 0
    assert monge_elkan(("tifabahe", "josef"), ("tifabahe", "villiam"))[0] == 0 and monge_elkan((), ("x",))[0] == 0


def test_variants_are_linked_and_others_are_not(spark):
    groups = [
        ["Topimujar Rovers", "Topimujar Rvrs.", "SK Topimujar Rovers", "Rovers, Topimujar", "TOPIMUJAR ROVERS", "Topimjuar Rovers", "Topimujãř\xa0Rovers"],
        ["Topimujar Albion", "Topimujar Alb", "Topimujar Alboin FC"], ["Topimujar Rovers W", "Topimujar Rovers (Women)", "Topimujar Rvrs Ladies"], ["Topimujar Rovers U19", "Topimujar Rovers Under 19"], ["Topimujar Rovers U21"],
        ["Sotihanur United", "Sotikhanur Utd", "Sotihanur"], ["Topimujar"], ["Gemobonal Sporting"],
    ]
    people = [["William Tifabahe", "Tifabahe, William", "Bill Tifabahe", "W. Tifabahe", "tífabãhě w"], ["Joseph Tifabahe", "Joe Tifabahe"], ["Tifabahe"]]
    rows = [("soccer", n) for g in groups for n in g] * 2 + [("tennis", n) for g in people for n in g] + [("soccer", None), (None, "Topimujar Rovers"), ("soccer", ""), ("soccer", " ?! "), ("basketball", "Topimujar Rovers"), ("soccer", "Q" * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "domain string, name string, key string, n int").repartition(3)
    got = {(r.domain, r.name_a, r.name_b) for r in linked_pairs(link_names(df, people=["tennis"])).collect()}
    want = {(d, *sorted(p)) for d, gs in (("soccer", groups), ("tennis", people)) for g in gs for p in ((a, b) for a in g for b in g if a < b)}
    assert got == want


def test_nothing(spark):
    assert link_names(spark.createDataFrame([], "domain string, name string"), people=[]).count() == 0
