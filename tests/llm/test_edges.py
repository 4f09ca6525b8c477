"""Nulls, empties, ties, repeated rows, empty tables and clashing columns for the operators without a module of their own."""

import datetime

from pyspark.sql import functions as F

from vigil.llm import ann, brown, quality, url_filter


def test_quality(docs, nothing):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == 11 and quality.quality_rules(docs).count() == 12
    assert got[5].n_words == 0 and got[5].base_failed and not got[5].kept
    assert got[6].n_words == 0 and got[7].word_chars == 0
    assert (got[11].n_words, got[11].n_repeat_words, got[11].n_dup_lines) == (2400, 2400, 39)
    assert got[1].kept and got[1].n_repeat_words == 0 and got[10].n_symbols == 4
    assert quality.quality_rules(nothing).count() == 0


def test_line_frequency(spark):
    rows = [(i, "a common line that all of them have in them\n" + " ".join(f"x{i}y{k}" for k in range(30)), "h") for i in range(60)]
    rows += [(100, "a common line that all of them have in them and\nA common line that all of them have in them!" + "\nfive words more and no" * 1, "h")]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].removed_words == 10 and got[0].kept
    assert got[100].removed_words == 10 and not got[100].kept  # 16 words are left, under 20


def test_url_filter(spark):
    day = datetime.date
    entries = spark.createDataFrame(
        [("bad.example.com", "block", day(2024, 1, 1)), ("bad.example.com", "remove", day(2024, 2, 1)), ("example.com", "allow", day(2024, 1, 5)), ("ok.org/ads", "block", day(2024, 1, 1)), (None, "block", day(2024, 1, 1)),
         ("tie.org", "block", day(2024, 1, 1)), ("tie.org", "remove", day(2024, 1, 1))],
        "pattern string, action string, listed date",
    )
    captures = spark.createDataFrame(
        [(1, "http://bad.example.com/x", day(2024, 1, 10)), (2, "http://bad.example.com/x", day(2024, 2, 1)), (3, "HTTPS://user@OK.org:80/ads/1", day(2024, 1, 1)), (4, "http://ok.org/other", day(2024, 1, 1)),
         (5, None, day(2024, 1, 1)), (6, "not a url", day(2024, 1, 1)), (7, "http://bad.example.com/x", None), (8, "http://bad.example.com/", day(2023, 12, 31)), (9, "http://tie.org", day(2024, 5, 1)), (1, "http://bad.example.com/x", day(2024, 1, 10))],
        "key long, url string, fetched date",
    )
    got = url_filter.evaluate(captures, entries).collect()
    assert len(got) == 10
    by = {r.key: (r.action, r.n_active, r.kept) for r in got}
    assert by == {1: ("block", 2, False), 2: ("allow", 1, True), 3: ("block", 1, False), 4: ("none", 0, True), 5: ("none", 0, True), 6: ("none", 0, True), 7: ("none", 0, True), 8: ("none", 0, True), 9: ("block", 1, False)}
    assert url_filter.evaluate(captures.where("false"), entries).count() == 0
    assert all(r.kept for r in url_filter.evaluate(captures, entries.where("false")).collect())


def test_nearest_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash"))
    got = ann.search(df, "vec_id % 20 = 0", 3).collect()
    lists = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    assert lists == {0: [(1, 1.0), (8, 1.0), (2, 0.0)], 20: [(2, 2.0), (0, 0.0), (1, 0.0)]}
    assert ann.search(df.where("false"), "true").count() == 0


def test_language_model_of_odd_texts(docs, nothing):
    model, counts = brown.fit(docs)
    got = brown.score_texts(docs, model, counts).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[5].n_tokens == by[6].n_tokens == by[7].n_tokens == 1 and by[5].score == by[6].score < 0
    assert all(r.n_known == r.n_tokens for r in got)
    model, counts = brown.fit(nothing)
    assert model.tokens == 0
    assert [r.n_known for r in brown.score_texts(docs, model, counts).collect()] == [0] * 12
    assert brown.score_texts(nothing, model, counts).count() == 0


def test_line_frequency_of_repeated_rows(spark):
    line = "a common line that all of them have in them"
    rows = [(i, line + "\n" + " ".join(f"x{i}y{k}" for k in range(21)), "h") for i in range(60)]
    rows += [(0, rows[0][1], "h"), (0, rows[0][1], "h"), (0, rows[0][1], None), (1, line + "\n" + line + "\n" + " ".join(f"z{k}" for k in range(21)), "h")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 2").collect()
    assert sorted((r.doc_id, r.n_words, r.removed_words, r.kept) for r in got) == [(0, 31, 0, True), (0, 31, 10, True), (0, 31, 10, True), (0, 31, 10, True), (1, 31, 10, True), (1, 41, 20, False)]  # the last for its repeated windows


def test_a_line_of_many_documents_of_a_large_host(spark):
    line = "a line that forty of many documents have, far less than two in a hundred"
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all alike to the rule
    rows = [(i, "h", (line + "\n" if i < 40 else "") + " ".join(f"x{name(i)}y{name(k)}" for k in range(25))) for i in range(3000)]
    rows += [(5000, "h", rows[50][2] + "\n" + "\n".join(["twenty-five times one line of one document"] * 25))]
    got = {r.doc_id: r.removed_words for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[0] == got[39] == 15 and got[40] == 0 and got[5000] == 0


def test_quality_lines_of_signs_alone(spark):
    """Lines of different signs are different lines; the same signs in more than 20 documents of a host are one."""
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits are all alike to the rule
    signs = ["***", "| |", "-- --", "#"]
    words = lambda i: " ".join(f"x{name(i)}y{name(k)}" for k in range(25))
    rows = [(i, "h", f"{words(i)}\n{signs[i % 4]}") for i in range(60)] + [(60 + i, "g", f"{words(60 + i)}\n *** \n***") for i in range(21)]
    got = {r.doc_id: r.removed_words for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[60 + i] for i in range(21)} == {2}
