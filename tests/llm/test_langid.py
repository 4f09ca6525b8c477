from vigil.llm import langid


def test_operator(spark, docs, nothing):
    texts = {"xx": "lorem ipsum dolor sit amet consectetur ", "yy": "zwölf boxkämpfer jagen viktor quer über "}
    train = spark.createDataFrame([(i, t * 8 + str(i), k) for i, (k, t) in enumerate(list(texts.items()) * 10)], "doc_id long, text string, lang string")
    d = langid.fit_dictionaries(train)
    assert set(d) == {"xx", "yy"}
    models = langid.compressors(tuple(sorted(d.items())), langid.LEVEL)
    assert langid.classify(texts["xx"] * 50, models)[0] == "xx"
    assert langid.classify(texts["yy"], models)[0] == "yy"
    for t in (None, "", "12 !!"):
        assert langid.classify(t, models) == ("und", 0.0, False)
    got = langid.identify(docs, d).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing, d).count() == 0
    assert langid.fit_dictionaries(nothing) == {}


def test_dictionaries_learn_from_whole_texts(spark):
    header = "the same header stands before every document of this source " * 10
    rows = [("header", header + " ".join(f"w{i}x{k}" for k in range(200))) for i in range(500)]
    rows += [("short", f"{i:06} " + "one of very many short texts, of fifty characters") for i in range(4000)]
    rows += [("twice", "a copy that stands many times"), ("empty", "")] + [("twice", "a copy that stands many times")] * 1000
    rows += [(f"l{i}", f"a language of one text, number {i}") for i in range(300)]
    got = langid.fit_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert len(got) == 303 and got["l299"] == b"a language of one text, number 299"
    assert len(got["header"]) == len(got["short"]) == langid.DICT_BYTES
    assert len({w.split(b"x")[0] for w in got["header"].split() if w[:1] == b"w" and w[1:2].isdigit()}) > 200
    assert got["twice"] == b"a copy that stands many times"
    langid.classify("a language of one text", langid.compressors(tuple(sorted(got.items())), langid.LEVEL))


def test_numerals_are_no_letters():
    models = langid.compressors((("de", b"das ist ein Wort und noch eines"), ("en", b"this is a word and another")), 6)
    assert [langid.classify(t, models)[0] for t in ("½ ² 12", "Ⅷ", "_ 3", "")] == ["und"] * 4 and langid.classify("ª", models)[0] != "und"
