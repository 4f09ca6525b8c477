"""Queries and pipeline stages without SQL, against results worked out by hand or on held-out rows."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import ann, bpe, common, langid, line_dedup, mixing, registry, toxicity

SMALL = "/root/testdata/sf0.01"


def root(up, x):
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def alike(sets, least):
    """Components of the ids of sets whose Jaccard similarity reaches least %, by an index of their elements."""
    up = {k: k for k in sets}
    owners = collections.defaultdict(list)
    for k, s in sets.items():
        for e in s:
            owners[e].append(k)
    for a, s in sets.items():
        common_ = collections.Counter(b for e in s for b in owners[e] if b > a)
        for b, n in common_.items():
            if 100 * n >= least * (len(s) + len(sets[b]) - n):
                x, y = sorted((root(up, a), root(up, b)))
                up[y] = x
    return {k: root(up, k) for k in sets}


def lines_by_hand(rows):
    """(doc, position) of the lines that go, from rows (doc, text), by exact similarity of all forms."""
    places = collections.defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            form = line.strip().lower()
            if any(c.isalnum() for c in form):
                places[form].append((d, i))
    forms = sorted(places)
    part = alike({k: {f[i : i + 7] for i in range(len(f) - 6)} for k, f in enumerate(forms)}, 80)
    first = {}
    for k, f in enumerate(forms):
        first[part[k]] = min(first.get(part[k], min(places[f])), min(places[f]))
    return {p for k, f in enumerate(forms) for p in places[f] if p != first[part[k]]}


def test_line_dedup_query_against_all_pairs(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    gone = lines_by_hand(rows)
    got = {r.doc_id: r for r in registry.queries()["op10_line_dedup"](spark, tiny).collect()}
    kept = {d: sum((d, i) not in gone for i in range(len((t or "").split("\n")))) for d, t in rows if t is not None}
    assert len(got) == len(rows)
    off = sum(abs(got[d].n_lines_kept - n) for d, n in kept.items() if n)
    assert off <= 0.05 * max(1, len(gone))  # bands find a similar pair with probability 0.98 at 0.8, and more above


def test_recall_of_bands():
    rng = random.Random(3)
    found = asked = 0
    while asked < 1500:
        a = "".join(rng.choices("abcdefghij klmno", k=rng.randint(24, 400)))
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 50))):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b)
        p, q = ({x[i : i + 7] for i in range(len(x) - 6)} for x in (a, b))
        if 100 * len(p & q) >= 80 * len(p | q):
            keys = line_dedup.minhash_bands([a, b])
            found, asked = found + bool((keys[0] == keys[1]).any()), asked + 1
    assert found >= 0.98 * asked


def test_many_near_copies_are_one_component(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=240))
    forms = []
    for _ in range(700):
        c = list(base)
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(len(c))] = rng.choice("0123456789")
        forms.append("".join(c))
    others = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=240)) for _ in range(100)]
    rows = list(enumerate(forms + others))
    want = lines_by_hand(rows)
    kept = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").count()
    assert abs(kept - (len(rows) - len(want))) <= 3


def test_toxicity_on_held_out_rows(spark):
    got = registry.queries()["op1_toxicity"](spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    x = got.where("held_out").join(labels, "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert x[x.toxic == 1].predicted.mean() >= 0.75 and x[x.toxic == 0].predicted.mean() <= 0.02


def test_toxicity_ties_copies_and_clashes(spark):
    texts = ["nice words of no harm", "scum vile scum vile"]
    train = spark.createDataFrame([(i, texts[i % 2] + f" {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    got = toxicity.score_documents(train.unionByName(train), model).collect()
    assert len(got) == 120 and len({(r.text, r.score) for r in got}) == 6  # equal texts score alike
    with pytest.raises(ValueError, match="score"):
        toxicity.score_documents(train.withColumn("score", F.lit(1)), model)


def test_language_on_held_out_rows(spark):
    got = registry.queries()["op2_language_id"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    x = got.where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").toPandas()
    assert (x.lang_pred == x.lang).mean() >= 0.95


def test_language_ties_clashes_and_long_texts(spark):
    same = {"aa": b"the very same dictionary for both", "bb": b"the very same dictionary for both"}
    df = spark.createDataFrame([(1, "the very same words"), (2, "the very same words"), (3, "word " * 200_000)], "doc_id long, text string")
    got = sorted(langid.identify(df, same).collect())
    assert [r.lang_pred for r in got] == ["aa"] * 3 and got[0].score == got[1].score and not got[0].accepted
    with pytest.raises(ValueError, match="lang_pred"):
        langid.identify(df.withColumn("lang_pred", F.lit("x")), same)


def test_mix_query_against_targets_by_hand(spark, tiny):
    got = registry.queries()["op7_mixing"](spark, tiny).toPandas()
    again = registry.queries()["op7_mixing"](spark, tiny).toPandas()
    docs = spark.read.parquet(f"{tiny}/documents.parquet").toPandas()
    size = docs.text.fillna("").map(lambda t: len(t.replace("\t", " ").split()))
    source = docs.source.where(docs.source.notna(), None)
    totals = size.groupby(source, dropna=False).sum()
    names = sorted((s for s in totals.index if isinstance(s, str))) + [s for s in totals.index if not isinstance(s, str)]
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    of = {n: int(totals[totals.index.isna()].iloc[0] if not isinstance(n, str) else totals[n]) for n in names}
    target, free, left = {}, set(names), float(size.sum())
    while free:  # those that the share by weight lifts above their cap stop there
        level = left / sum(weight[n] for n in free)
        capped = [n for n in free if weight[n] * level > 3 * of[n]]
        if not capped:
            target |= {n: weight[n] * level for n in free}
            break
        for n in capped:
            target[n] = 3.0 * of[n]
            left -= target[n]
            free.discard(n)
    x = got.merge(docs[["doc_id", "source"]], on="doc_id")
    assert len(got) == len(docs) and (x.taken <= 3 * x["size"]).all() and (x.taken >= 0).all()
    for n in names:
        mine = x[x.source.isna()] if not isinstance(n, str) else x[x.source == n]
        assert np.allclose(mine.target, target[n]) and (mine.source_size == of[n]).all()
        assert abs(mine.taken.sum() - target[n]) <= 2 * mixing.BLOCK_WORDS
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))


def test_mix_refuses_its_own_names(spark):
    sizes = spark.createDataFrame([(1, "a", 5)], "_id long, source string, size long")
    with pytest.raises(ValueError, match="target"):
        mixing.apportion(sizes.withColumn("target", F.lit(1)))


def recall(spark, vectors, k=20, block=1024):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.search(df, "vec_id % 100 = 0", k, block).collect()
    mine = collections.defaultdict(set)
    for r in got:
        mine[r.query_id].add(r.vec_id)
    found = 0
    asked = range(0, len(vectors), 100)
    for q in asked:
        s = vectors @ vectors[q]
        s[q] = -np.inf
        found += len(mine[q] & set(np.argpartition(-s, k)[:k].tolist()))
    return found / (k * len(asked))


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.15 * rng.standard_normal((20_000, 32))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def test_recall_on_random_vectors(spark):
    x = np.random.default_rng(2).standard_normal((20_000, 24))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def words_of(rng, n, letter):
    return [f"{letter}{rng.randint(0, 500)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic, clean and labelled documents, near and exact copies, repeated lines and rows, nulls, blanks, a long text, clashing columns."""
    rng, rows = random.Random(6), []
    for i in range(60):
        text = " ".join(words_of(rng, 60, "t")) + (" vile scum vile scum" if i % 5 == 0 else " kind people")
        rows.append((i, "\n".join([text, "a line that every one of these documents has at its end, more or less"]), "en", f"s{i % 3}"))
    base = words_of(rng, 80, "b")
    for i in range(60, 80):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy), "de", None))
    rows += [(80, None, None, "s0"), (81, "", "en", "s1"), (82, " \n\t", None, None), (83, " ".join(words_of(rng, 60_000, "l")), "en", "s2"), (None, "a text without an id of its own, alone", "en", "s0"), (84, rows[1][1], "en", "s1"), (85, "same id one", "en", "s1"), (85, "same id two, with words", "en", "s1"), (85, "same id one", "en", "s1")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, _copy int")
    docs.coalesce(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_by_hand(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "", r.text is None)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "mixing", "bpe_encoding"]

    def through(name, df):
        out = common.materialise(stages[name](spark, df, corpus), f"test-{name}")
        return out, sorted(out.collect(), key=key)

    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    df, got = through("toxicity", docs)
    scorer = toxicity.Scorer(model)
    want = sorted((r for r in rows if toxicity.probability(sum(s for *_, s in toxicity.normalised(scorer.scores(r.text), model)), model) < 0.7), key=key)
    assert got == want and {r.doc_id for r in rows} - {r.doc_id for r in got} == set(range(0, 60, 5)) and df.columns == columns

    before = got
    df, got = through("line_dedup", df)
    first = lines_by_hand([((1 << 40 if r.doc_id is None else r.doc_id, i), r.text) for i, r in enumerate(before)])
    texts = {(r.doc_id, i): r.text for i, r in enumerate(before)}
    want = collections.Counter()
    for (d, i), t in texts.items():
        alone = d is None or d == 85  # rows of one id are told apart in another order: looked at below
        if not alone:
            want[d, t and "\n".join(x for p, x in enumerate(t.split("\n")) if ((d, i), p) not in first)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in got if r.doc_id not in (None, 85)) == want
    assert sorted(r.text for r in got if r.doc_id == 85) == ["same id one", "same id one", "same id two, with words"] and [r.text for r in got if r.doc_id is None] == ["a text without an id of its own, alone"]

    before = got
    df, got = through("ngram_jaccard_join", df)
    sets = {}
    for i, r in enumerate(before):
        w = (r.text or "").lower().split()
        if w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    part = alike(sets, 80)
    groups = collections.defaultdict(list)
    for i, p in part.items():
        groups[p].append(i)
    wordless = sum(i not in sets for i in range(len(before)))
    assert len(got) == len(groups) + wordless
    for members in groups.values():
        ids = [before[i].doc_id for i in members]
        assert sum(r in [before[i] for i in members] for r in got) == 1
        if any(x is not None for x in ids):
            assert any(r.doc_id == min(x for x in ids if x is not None) and (r.doc_id, r.text) in {(before[i].doc_id, before[i].text) for i in members} for r in got)

    before = got
    df, got = through("mixing", df)
    copies = collections.Counter((r.doc_id, r.text) for r in got)
    size = lambda t: len((t or "").split())
    assert max(copies.values()) <= 3 and all(copies[r.doc_id, r.text] == 1 for r in before if not size(r.text)) and set(copies) <= {(r.doc_id, r.text) for r in before} and df.columns == columns

    df, got = through("bpe_encoding", df)
    vocabulary = bpe.WordBPE(bpe.default_vocabulary())
    for r in got:
        packed = vocabulary.encode(r.text)
        assert r.ids == np.frombuffer(packed, "<i4").tolist() and r.decoded == vocabulary.decode(packed)
    assert df.columns == [*columns, "ids", "decoded"]


def test_stages_of_an_empty_table(spark, corpus):
    df = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        df = common.materialise(stage(spark, df, corpus), f"test-{name}")
        assert df.count() == 0
