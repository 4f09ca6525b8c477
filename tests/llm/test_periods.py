"""Periodic runs against all lags, and the query against brute force."""

import hashlib
import random
import zlib

import numpy as np

from vigil.llm import periods, registry


def by_hand(w):
    """All runs by looking at every lag and every divisor."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng, found = random.Random(5), 0
    for _ in range(1500):
        n, k = rng.randrange(0, 240), rng.choice([1, 2, 2, 3, 5, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 30:
                a, p = rng.randrange(n), rng.randrange(1, 30)
                for i in range(a + p, min(n, a + rng.randrange(p * 3 + 5))):
                    w[i] = w[i - p]
        want = by_hand(w)
        found += len(want)
        assert periods.periodic_runs(np.array(w, np.int32)) == want
    assert found > 200


def test_lag_counts_of_frequent_and_rare_words():
    w = np.minimum(np.random.default_rng(2).zipf(1.4, 3000), 900).astype(np.int32)
    counts = periods.lag_counts(w, 1000)
    assert counts[0] == 0 and all(counts[q] == (w[:-q] == w[q:]).sum() for q in range(1, 1001))


def test_a_text_of_one_word_is_one_run():
    assert periods.periodic_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    assert periods.periodic_runs(np.resize(np.arange(7, dtype=np.int32), 100_000)) == [(0, 100_000, 7)]


def test_query_against_brute_force(spark, tiny):
    got = {r.doc_id: r for r in registry.queries()["op12_periodic_runs"](spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(got) == len({d.doc_id for d in docs})
    looped = 0
    for d in docs:
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n = len(words)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            looped += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = by_hand(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if not runs else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert looped > 5


def test_odd_texts(spark, docs, nothing):
    got = periods.with_runs(docs, collapsed="collapsed").collect()
    assert len(got) == 12 and set(docs.columns) < set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert all(by[k].n_runs == 0 and by[k].start is None and by[k].collapsed == "" for k in (5, 6, 7))
    assert (by[11].start, by[11].length, by[11].period, by[11].exponent_milli) == (0, 2400, 60, 40000)
    assert by[11].collapsed == by[1].text and by[10].collapsed == by[10].text
    assert periods.with_runs(nothing).count() == 0
    null_id = spark.createDataFrame([(None, "a " * 30), (1, "a " * 23)], "doc_id long, text string")
    assert sorted(r.n_runs for r in periods.with_runs(null_id, loops="doc_id").collect()) == [0, 1]
