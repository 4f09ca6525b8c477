import random

from vigil.llm import ngram_join as nj


def brute(rows, n, least):
    sets = {}
    for k, t in rows:
        w = [x for x in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    part = {k: k for k in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= least * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_equals_brute_force_with_frequent_classes(spark, monkeypatch):
    monkeypatch.setattr(nj, "FREQUENT_FROM", 3)
    rng = random.Random(4)
    rows = []
    for g in range(12):
        words = [f"{rng.choice('abcdef')}{rng.randint(0, 400)}" for _ in range(rng.choice([6, 9, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)


def test_edge_rows(docs, nothing):
    got = nj.jaccard_components(docs).collect()
    parts = {r.doc_id: r.component_id for r in got}
    assert len(got) == 12
    assert parts[1] == parts[2] == parts[3] == 1 and parts[8] == parts[9] == 8
    assert parts[11] == 1  # its repetitions add 3 shingles to the 57 of row 1
    assert all(parts[k] == k for k in (4, 5, 6, 7, 10))
    assert nj.jaccard_components(nothing).count() == 0


def test_rows_without_an_id(spark):
    def words(a, head=0, tail=0):
        return " ".join([f"{a}h{i}" for i in range(head)] + [f"{a}{i}" for i in range(head, 60 - tail)] + [f"{a}t{i}" for i in range(tail)])

    # of a, only the row without an id is near both 5 and 6; b and c have no id at all; 7 stands for different texts
    rows = [(5, words("a", 4)), (None, words("a")), (6, words("a", 0, 4)), (7, words("a", 4, 1)), (7, words("d")), (7, words("d")), (4, words("e"))]
    rows += [(None, words("b")), (None, words("b", 1)), (None, words("c")), (None, None), (None, ""), (None, " \n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _row string")
    parts = nj.jaccard_components(df).collect()
    assert {(r.doc_id, r.component_id) for r in parts} == {(5, 5), (6, 5), (7, 5), (7, 7), (None, 5), (None, None), (4, 4)}
    kept = nj.stage(spark, df, "").collect()
    got = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept)
    assert got == [(0, ""), (0, ""), (0, " "), (0, "b"), (0, "c"), (4, "e"), (5, "a"), (7, "d")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "_row"}
    assert nj.stage(spark, df.where("false"), "").count() == 0
