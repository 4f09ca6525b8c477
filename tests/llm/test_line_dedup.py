import numpy as np

from vigil.llm import line_dedup as ld


def test_lines(spark, docs, nothing):
    a = "The quick brown fox jumps over the lazy dog near the river bank today and tomorrow again"
    rows = [(1, a + "\nshort\nshort"), (2, "own line of the second document here\n" + a.replace("today", "todaY")), (3, a[:-1] + "\nlast"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _gone string")
    got = {r.doc_id: r for r in ld.drop_lines(df).collect()}
    assert got[1].text == a + "\nshort"
    assert got[2].text == "own line of the second document here"
    assert got[3].text == "last"
    assert got[4].text is None and got[5].text == "" and got[1]["_gone"] == "k"
    kept = ld.drop_lines(docs).collect()
    assert len(kept) == 12 and kept[0].asDict().keys() == docs.first().asDict().keys()
    assert ld.drop_lines(nothing).count() == 0


def test_bands_find_similar_lines():
    a = "".join(chr(97 + i * 7 % 26) for i in range(300))
    keys = ld.minhash_bands([a, a[:150] + "#" + a[151:], a[::-1]])
    assert (keys[0] == keys[1]).any()
    assert not (keys[0] == keys[2]).any()


def test_rows_of_one_id(spark):
    long = "one line that stands in two of these documents, at the same place"
    rows = [(1, long + "\nshort"), (2, long + "\nanother line that only one of the documents has"), (2, "the other text of this id has no line twice anywhere\nlast"), (2, "the other text of this id has no line twice anywhere\nlast"), (3, "short\n" + long), (3, long + "\nand more of the third")]
    got = sorted(r.text for r in ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id > 1").collect())
    assert got == sorted(["another line that only one of the documents has", rows[2][1], rows[3][1], "and more of the third", ""])


def test_rows_without_an_id_come_last(spark):
    line = "one line that stands in several documents, word for word"
    rows = [(None, line + "\nfirst"), (None, line + "\nsecond"), (2, line + "\nthird"), (None, "only those without an id have this other line\na"), (None, "only those without an id have this other line\nb")]
    got = sorted(r.text for r in ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(line in t for t in got) == 1 and line + "\nthird" in got and {"first", "second"} < set(got)
    assert sum("other line" in t for t in got) == 1


def test_empty_bins_are_filled_as_step_by_step():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 1 << 63, (300, ld.BINS), dtype=np.uint64)
    for i in range(299):  # from one full bin to all
        bins[i, rng.permutation(ld.BINS)[i % ld.BINS + 1 :]] = ld.EMPTY
    want = bins.copy()
    while (empty := want == ld.EMPTY).any():
        moved = np.roll(want, -1, axis=1)
        want = np.where(empty & (moved != ld.EMPTY), moved + ld.STEP, want)
    ld.fill(bins)
    assert (bins == want).all()
    ld.fill(bins[:0])


def test_wanted_lines_move_once_on_their_way_to_buckets(spark, monkeypatch):
    seen = []

    def watched(df, by, name="table", deal=True, plain=ld.bucketed):
        seen.append((name, deal))
        return plain(df, by, name, deal)

    monkeypatch.setattr(ld, "bucketed", watched)
    line = "the quick brown fox jumps over the lazy dog and goes home again"
    rows = [(i, f"{line} {'x' * i}\nother line number {i} " + "abcdefghij"[i] * 30) for i in range(6)]
    got = ld.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if line in r.text} == {0}
    assert seen == [("line-bodies", False)]
