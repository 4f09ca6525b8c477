"""The class model against counts and sums written out by hand."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import brown


def f(x):
    return x * math.log(x) if x > 0 else 0.0


def likelihood_by_hand(counts, of):
    k = max(of) + 1
    n = [[0] * k for _ in range(k)]
    for a, b in itertools.product(range(len(counts)), repeat=2):
        n[of[a]][of[b]] += int(counts[a][b])
    return sum(f(x) for r in n for x in r) - sum(f(sum(r)) for r in n) - sum(f(sum(c)) for c in zip(*n, strict=True))


def test_exchange_ends_where_no_move_is_better():
    rng = random.Random(2)
    size = 14
    counts = np.array([[rng.choice([0, 0, 1, 5 if a % 3 == b % 3 else 2]) for b in range(size)] for a in range(size)])
    of = brown.exchange(counts, classes=3, passes=50)
    best = likelihood_by_hand(counts, of.tolist())
    start = [*(np.arange(size - 1) % 3), 3]
    assert of[-1] == 3 and best >= likelihood_by_hand(counts, start) - 1e-9
    for w in range(size - 1):
        for c in range(3):
            other = of.tolist()
            other[w] = c
            assert likelihood_by_hand(counts, other) <= best + 1e-6


def test_gain_of_a_move_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(4)
    counts, of, k = rng.integers(0, 9, (9, 9)), np.array([0, 1, 2, 0, 1, 2, 0, 1, 3]), 4
    one = np.eye(k)[of]
    table = one.T @ counts @ one
    w, old = 3, 0
    row, col, own = np.bincount(of, counts[w], k), np.bincount(of, counts[:, w], k), float(counts[w, w])
    row[old] -= own
    col[old] -= own
    t = table.copy()
    brown.without(t, row, col, own, old)
    gain = brown.move_gains(t, row, col, own)
    for c in range(3):
        other = of.copy()
        other[w] = c
        assert gain[c] - gain[old] == pytest.approx(likelihood_by_hand(counts, other.tolist()) - likelihood_by_hand(counts, of.tolist()))


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(7)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(1, 8)) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(80)] + ["", None, "Rare1 rare2 n1"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(brown, "MAX_CLASSED", 16)
        m.setattr(brown, "MAX_KNOWN", 24)
        m.setattr(brown, "TOP", 6)
        m.setattr(brown, "CLASSES", 4)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        more = spark.createDataFrame([(500, "n1 v1 never seen"), (501, "never"), (502, None)], "doc_id long, text string")
        model, counts = brown.fit(docs)
        yield model, texts, brown.score_texts(docs, model, counts).collect(), brown.score_texts(more, model, counts).collect()


def test_counts_and_classes(toy):
    model, texts, _, _ = toy
    v = model.vocabulary
    words = [w.encode() for t in texts for w in (t or "").lower().split()]
    assert model.tokens == len(words) + len(texts) and model.kinds == len(set(words)) + 1
    assert v.classed == 16 and len(v.known) <= 24 and all(v.counts[i] == words.count(w) for w, i in v.known.items())
    symbol = lambda w: v.known[w] if v.known.get(w, 99) < v.classed else v.classed + brown.spelling_group(w)
    k = 5
    n = np.zeros((k, k))
    for t in texts:
        path = [v.end, *(symbol(w.encode()) for w in (t or "").lower().split()), v.end]
        for a, b in itertools.pairwise(path):
            n[model.of[a], model.of[b]] += 1
    share = (n.sum(0) + 0.5) / (n.sum() + 0.5 * k)
    want = (n + brown.BACKOFF * share) / (n.sum(1, keepdims=True) + brown.BACKOFF)
    assert np.allclose(10**model.transitions, want) and np.allclose(want.sum(1), 1)


def test_emissions_sum_to_one(toy):
    model, texts, _, _ = toy
    v = model.vocabulary
    words = [w.encode() for t in texts for w in (t or "").lower().split()]
    total = np.zeros(5)
    for w in set(words):
        s = v.known[w] if v.known.get(w, 99) < v.classed else v.classed + brown.spelling_group(w)
        total[model.of[s]] += 10 ** float(model.emission(np.array([words.count(w)]), model.of[[s]])[0])
    groups = model.of[v.classed : v.end]
    np.add.at(total, groups, 10 ** model.emission(np.zeros(brown.GROUPS), groups, model.group_share))
    used = [c for c in range(4) if model.class_tokens[c] > 0]
    assert np.allclose(total[used], 1, atol=0.01) and np.allclose(total[sorted(set(groups))], 1)


def test_scores_are_sums_over_the_path(toy):
    model, texts, got, more = toy
    v = model.vocabulary
    words = [w.encode() for t in texts for w in (t or "").lower().split()]
    asked = {**dict(enumerate(texts)), 500: "n1 v1 never seen", 501: "never", 502: None}
    for r in [*got, *more]:
        tokens = [w.encode() for w in (asked[r.doc_id] or "").lower().split()]
        symbols = [v.known[w] if v.known.get(w, 99) < v.classed else v.classed + brown.spelling_group(w) for w in tokens]
        path = [v.end, *symbols, v.end]
        score = sum(model.transitions[model.of[a], model.of[b]] for a, b in itertools.pairwise(path))
        for w, s in zip(tokens, symbols, strict=True):
            n = words.count(w)
            share = model.group_share[s - v.classed] if s >= v.classed else 0.0
            score += float(model.emission(np.array([n]), model.of[[s]], share)[0])
        assert r.n_tokens == len(tokens) + 1 and r.n_known == sum(w in words for w in tokens) + 1
        assert r.score == pytest.approx(score) and r.perplexity == pytest.approx(10 ** (-score / r.n_tokens))


def test_no_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = brown.fit(none)
    got = brown.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), model, counts).collect()
    assert model.tokens == 0 and all(r.n_known == 0 and r.score < 0 for r in got)


def test_every_accepted_step_raises_the_likelihood(spark, monkeypatch):
    """Words of three kinds that follow one another: the exchange ends by its rule, and what it keeps never falls."""
    import random

    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(40)] for k in "abc"]
    texts = spark.createDataFrame([(" ".join(rng.choice(kinds[(i + rng.choice([0, 0, 0, 1])) % 3]) for i in range(60)),) for _ in range(200)], "text string")
    seen, real = [], brown.likelihood
    monkeypatch.setattr(brown, "likelihood", lambda t: seen.append(real(t)) or seen[-1])
    monkeypatch.setattr(brown, "TOP", 8)
    brown.fit(texts)
    best = [max(seen[: i + 1]) for i in range(len(seen))]
    assert len(seen) >= 5 and best[-1] > seen[0]
    assert best[-1] - best[-3] <= brown.ENOUGH * abs(best[-1])  # the last round


def test_contexts_are_counted_in_one_shuffle_and_whatever_is_held_at_once(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = brown.vocabulary(brown.word_counts(df))
    shared, size = spark.sparkContext.broadcast(words), words.end + 1
    want = {}
    for t in texts:
        path = [words.end, *words((t or "").encode().split())[0].tolist(), words.end]
        for a, b in itertools.pairwise(path):
            want[a, b] = want.get((a, b), 0) + 1
            want[b, a + size] = want.get((b, a + size), 0) + 1
    for bounds in ({}, {"counted": 40, "merged": 30, "written": 20}):
        rows = brown.contexts(df, shared, **bounds)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") - plan.count("RoundRobin") == 1, plan
        got = [(r.w, o, n) for r in rows.collect() for o, n in zip(np.frombuffer(r.o, np.int32).tolist(), np.frombuffer(r.n, np.int32).tolist(), strict=True)]
        assert {(w, o): n for w, o, n in got} == want and len(got) == len(want)


def test_counts_of_64_bits_stay():
    small, large = np.array([1, 2], np.int32), np.array([1 << 40, 3, 4])
    columns = [[5, 6], [np.array([7, 8], np.int32).tobytes(), np.array([1, 2, 3], np.int32).tobytes()], [small.tobytes(), large.tobytes()]]
    batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2])], names=["w", "o", "n"])
    w, row, o, n = brown.flat(batch)
    assert (w.tolist(), row.tolist(), o.tolist(), n.tolist()) == ([5, 6], [0, 0, 1, 1, 1], [7, 8, 1, 2, 3], [1, 2, 1 << 40, 3, 4])
    assert all(not len(c) for c in brown.flat(batch.slice(2)))
