import math
import random

import numpy as np

from vigil.llm import toxicity as tx


def by_definition(scores):
    out = []

    def rec(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best:
            rec(lo, best[1])
            out.append((best[1], best[2]))
            rec(best[2], hi)

    rec(0, len(scores))
    return out


def test_segments_are_those_of_the_definition():
    rng = random.Random(0)
    for _ in range(500):
        scores = [rng.choice([-3, -2, -1, -0.5, 1, 2, 3]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in tx.maximal_segments(scores)] == by_definition(scores)


def test_operator(spark, docs, nothing):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" vile scum " if i % 4 == 0 else f" nice {i}") + str(i)) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, None)], "doc_id long, toxic int")
    model = tx.fit(train, labels)
    got = {r.doc_id: r for r in tx.score_documents(docs.select("doc_id", "text"), model).collect()}
    assert all(r.score < 0.7 and r.n_segments == 0 for r in got.values())
    bad = spark.createDataFrame([(1, "alpha scum beta " + "gamma delta " * 3000), (2, "alpha beta"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in tx.score_documents(bad, model).collect()}
    assert got[1].score > got[2].score and got[1].segments[0].start == 1
    assert tx.score_documents(nothing.select("doc_id", "text"), model).count() == 0
    assert tx.fit(train, labels.where("false")) == tx.Model()


def probability(text, model):
    return tx.probability(sum(s for *_, s in tx.normalised(tx.Scorer(model).scores(text), model)), model)


def corpus(spark, toxic, clean, n=240):
    """Texts of chance words; every sixth is toxic and holds some of the toxic words, the others hold clean ones."""
    rng = random.Random(7)
    filler = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(filler, k=60)
        for w in rng.sample(clean if i % 6 else toxic, 3):
            words.insert(rng.randrange(60), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_weights_are_of_both_signs_and_need_evidence(spark):
    docs, labels = corpus(spark, ["vile", "scum", "idiot"], ["kind", "garden", "letter"])
    model = tx.fit(docs, labels)
    assert all(model.weights[w] > 1 for w in ("vile", "scum", "idiot")) and all(model.weights[w] < 0 for w in ("kind", "garden", "letter"))
    assert probability("you are an idiot", model) >= 0.7  # one strong word
    assert probability("what a kind letter from the garden", model) < 0.3
    scores = tx.Scorer(model).scores("kind vile")
    assert scores[0] < -tx.COST < 0 < scores[1]


def test_beginnings_need_several_words_and_no_clean_one(spark):
    docs, labels = corpus(spark, ["worthless", "pathetic", "scumbag", "scummy", "scumlike"], ["worthwhile", "pathway", "letter", "garden"])
    model = tx.fit(docs, labels)
    assert {"scum"} <= set(model.beginnings) and not {"wort", "worth", "path"} & set(model.beginnings)
    for text in ("A worthwhile journey along the pathway was good for everyone in the village", "The pathology department published a worthwhile study", "worthy pathos"):
        assert probability(text, model) < 0.5, text
    assert probability("such scumhood", model) >= 0.7


def test_scripts_without_spaces(spark):
    docs, labels = corpus(spark, ["他是一个白痴吗", "我说白痴你好", "真的白痴啊"], ["他是一个好人吗", "我说朋友你好", "真的好啊"])
    model = tx.fit(docs, labels)
    assert model.weights["白痴"] > 1
    long = "我说朋友你好" * 50
    assert probability(long + "白痴" + long, model) >= 0.7 > probability(long, model)


def test_intervals():
    n = np.array([0.0, 1.0, 4.0, 20.0, 100.0])
    low, high = tx.lowest(n), tx.highest(n)
    assert (low <= n).all() and (high > n).all() and 2.8 < high[0] < 3.1 and 0.03 < low[1] < 0.07
    odds = tx.log_odds(np.array([1.0, 30.0, 0.0, 5.0]), np.array([0.0, 0.0, 300.0, 45.0]), 50, 450)
    assert odds[0] == 0 and odds[1] > 3 and odds[2] < -1 and odds[3] == 0


def by_hand(rows, labels):
    """The model's weights worked out from texts and labels in plain Python, text by text."""
    least, kinds = {}, {}
    for d, t in rows:
        if d in labels:
            values, ends = tx.Shingler(4).of_texts([t or ""])
            k = int(values[0]) >> 1 if ends[1] else -1
            least.setdefault(k, []).append((d, t))
            kinds[k] = max(kinds.get(k, 0), labels[d])
    toxic, clean = {}, {}
    for k, texts in least.items():
        for w in tx.words(max(texts, key=lambda x: x[0])[1]):
            of = toxic if kinds[k] else clean
            of[w] = of.get(w, 0) + 1
    n1, n0 = sum(kinds.values()), len(kinds) - sum(kinds.values())
    out = {}
    for w in set(toxic) | set(clean):
        if toxic.get(w, 0) + clean.get(w, 0) > 1:
            x = float(tx.log_odds(np.array([toxic.get(w, 0.0)], float), np.array([clean.get(w, 0.0)], float), n1, n0)[0])
            if x:
                out[w] = x
    return out


def test_query_against_brute_force(spark):
    """Weights from all texts, segments by definition, and the sum over them, against the query."""
    import zlib

    from vigil.llm import registry

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    mine = {r.doc_id: int(r.toxic > 0) for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = tx.fit(docs, labels.where(~tx.held_out()))
    want = by_hand(rows, mine)
    assert {w for w, x in model.weights.items() if x} == set(want) and all(abs(model.weights[w] - x) < 1e-9 for w, x in want.items())
    for text, bad in (("A worthwhile journey along the pathway was good for everyone in the village", False), ("The pathology department published a worthwhile study", False), ("you are an idiot", True)):
        assert (probability(text, model) >= 0.7) is bad, text
    got = {r.doc_id: r for r in registry.queries()["op1_toxicity"](spark, folder).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r, found = got[d], tx.tokens(t)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        if 0 < len(found) <= 60:
            scores = [max((model.weights.get(w, model.beginnings.get(w[:6], model.beginnings.get(w[:5], model.beginnings.get(w[:4], 0.0)))) for w in tx.FORM.findall(x)), key=abs, default=0.0) - tx.COST for x in found]
            floor = math.log(max(model.size * len(found), math.e))
            total = sum(max(0.0, model.rate * sum(scores[a:b]) - floor) for a, b in by_definition(scores))
            assert abs(r.score - 1 / (1 + math.exp(-max(-60, min(60, model.slope * total + model.offset))))) < 1e-9
