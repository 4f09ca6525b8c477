"""Circulant MinHash: its coordinates, its recall, and components against all pairs."""

import random

import numpy as np
from test_brute import alike

from vigil.llm import minhash, registry


def test_permutations_are_one_to_one():
    at = np.arange(0, 1 << 32, 65537, dtype=np.uint64).astype(np.uint32)
    assert len(np.unique(minhash.ranks(at))) == len(at)


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng, agree = np.random.default_rng(1), []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 230).astype(np.uint64)
        a, b = x[:200], x[30:]  # 170 of 230
        s = minhash.signature(np.concatenate((a, b)), np.array([0, 200]), 64)
        agree.append((s[0] == s[1]).mean())
        shifted = minhash.places(a) - np.uint32(9)
        assert s[0][9] == minhash.ranks(shifted).min()
    assert abs(np.mean(agree) - 170 / 230) < 0.02


def near_copies(n, seed):
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 4, 12, 40, 150]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_components_against_all_pairs(spark):
    rows = near_copies(150, 4)
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    part = alike(sets, 85)
    least = {}
    for d, p in part.items():
        least[p] = min(d, least.get(p, d))
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.component_id for d, r in got.items()} == {d: least[p] for d, p in part.items()}
    assert all(r.n_shingles == len(sets[d]) and r.kept == (r.component_id == d) for d, r in got.items())
    assert len(set(part.values())) < len(rows) - 50


def test_odd_texts(spark, docs, nothing):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert [by[k].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 1, 4, 5, 6, 7, 8, 8, 10]
    assert by[5].n_shingles == by[6].n_shingles == by[7].n_shingles == 0 and by[5].kept and by[8].n_shingles == 1 and not by[9].kept
    assert minhash.near_duplicates(nothing).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (3, text), (None, "alone here"), (None, None), (4, "x" * 100_000)]
    null_ids = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert null_ids == [(0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (4, 4, True)]


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*base[: k % 100], f"own{k}", *base[k % 100 + 1 :]])) for k in range(600)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_registered():
    assert {"op11_minhash", "op12_periodic_runs", "op13_token_alignment"} < set(registry.queries())
