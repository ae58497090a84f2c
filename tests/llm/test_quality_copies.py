from oddsloom.llm.quality import not_prose, quality


def test_copies_of_one_table_and_a_language_of_one_text_come_out(spark):
    table, prose = "| home | away |\n|---|---|\n| Alpha | Beta |\n| Gamma | Delta |", "It was the price of the day, and they had to take it. We were not in the room at that time."
    rows = [(i, table, "ru") for i in range(90)] + [(100 + i, prose, "en") for i in range(9)] + [(200, "de: 4\nla: 5\nque: 6", "es")]
    words = spark.createDataFrame([("en", w) for w in "the of and to in it was they had we were not at that".split()] + [("es", w) for w in "de la que".split()] + [("ru", "и")], "lang string, word string")
    scored = quality(spark.createDataFrame(rows, "doc long, body string, lang string"), words, ident="doc", text="body", lang="lang")
    assert {r.doc for r in not_prose(scored).collect()} == {*range(90), 200}
