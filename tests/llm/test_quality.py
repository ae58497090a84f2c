import math

from oddsloom.llm.quality import SIDES, not_prose, quality, text_statistics

COMMON = {"en": frozenset("the of and to in a is that for it on was with as be at by this are from or have an not but they we were has had you".split()), "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo".split())}
PROSE = ["The line was taken down before noon, and we have not seen it since. It is a pity that the desk was slow.", "and then they moved it to the other side of the board without a word from the desk, as it was late", "El precio de la casa no se movió en toda la noche. Los clientes no han visto una cuota para el partido.", "<p>It was the price of the day, and they had to take it. We were not in the room at that time.</p>",
         "It was late in the day when\nthe desk saw the price, and it\nwas not the one that they had\nin mind for the match.", "client: Where is the money that you have promised to me?\ndesk: It is on the way to you, as we have said."]
JUNK = ["", " \n\t", None, "...", "price point edge line draw set push over under market home away " * 10, "1. no price before Monday\n2. call the desk about the line\n3. limits on the set, again\n4. the price for the cup of the week", "book,line,remark\nfjord,2.5,back on the board\ngale,3.5,not in the list\ndune,1.5,was at the top",
        "| home | away |\n|---|---|\n| Alpha | Beta |\n| Gamma | Delta |", "10:00:01 [WARN] a_b=0x1f rc=2\n10:00:02 [ERR] c_d=0x2f rc=4", '<div class="a"><span id="1">1</span></div>' * 20, "zx|q1 kk0w vbd 1lm " * 30, "limit: 250\nprice: 3.2\nbook: fjord\nstatus: n/a", "x" * 50_000]


def test_statistics():
    lang, words, mean, symbols, digits, ended, common, running = text_statistics("The price is 10.\nIt was on", COMMON)
    assert (lang, words, ended) == ("en", 6.0, 0.5) and math.isclose(mean, 17 / 6) and math.isclose(digits, 2 / 20) and math.isclose(symbols, 1 / 20) and math.isclose(common, 5 / 6)
    assert text_statistics(None, COMMON)[1:] == (0.0,) * 7


def test_prose_is_told_from_the_rest(spark):
    rows = [(i, t, "EN" if i % 3 else None, "x", 1.0) for i, t in enumerate(PROSE * 30 + JUNK * 5)]
    docs = spark.createDataFrame(rows, "doc long, body string, lang string, g string, score double").repartition(4)
    words = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v] + [(None, "x"), ("en", None)], "lang string, word string")
    scored = quality(docs, words, ident="doc", text="body", lang="lang")
    got = {r.doc for r in not_prose(scored).collect()}
    assert got == {i for i, t, *_ in rows if t in JUNK}
    # the scores against counting
    all_ = scored.collect()
    assert len(all_) == len(rows)
    groups = {r.doc: r.spoken if r.spoken in COMMON else "en" for r in all_}
    for r in all_[::17]:
        mates = [m for m in all_ if groups[m.doc] == groups[r.doc]]
        total = 0.0
        for c, side in SIDES.items():
            low, high = (sum(f(m[c], r[c]) for m in mates) / len(mates) for f in (lambda x, y: x <= y, lambda x, y: x >= y))
            total -= math.log(low if side == "low" else high if side == "high" else min(1.0, 2 * min(low, high)))
        assert math.isclose(r.tail_sum, total, abs_tol=1e-9)
    assert all(r.spoken in COMMON or groups[r.doc] == "en" for r in all_)
    # the score decides: with another one, other documents come out
    assert {r.doc for r in not_prose(scored.withColumn("score", -scored["score"])).collect()} == {i for i, t, *_ in rows if t in PROSE}


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc long, body string, lang string")
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    assert quality(docs, words, ident="doc", text="body", lang="lang").count() == 0
