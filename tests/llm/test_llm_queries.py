"""Queries with SQL against it on the smallest tables; numbers of rows of the others."""

import pytest
from compare import connection, rows

import corpus_pipeline
from vigil.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, tiny, name):
    got = registry.queries()[name](spark, tiny).toPandas()
    want = connection(tiny).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_nearest_neighbours(spark, tiny):
    import numpy as np

    got = registry.queries()["op5_nearest_neighbours"](spark, tiny).toPandas()
    e = spark.read.parquet(f"{tiny}/embeddings.parquet").toPandas()
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    found = wanted = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        found += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
        wanted += 20
        assert list(mine["rank"]) == list(range(1, 21))
    assert found >= 0.9 * wanted


def test_rows_that_repeat_get_one_verdict(spark, tiny):
    """The quality query and its SQL agree where ids repeat with one text."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    from vigil.llm import quality

    once = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    twice = quality.quality_rules(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(once) and all(r == once[r.doc_id] for r in twice)


def test_language_model(spark, tiny):
    import collections
    import math
    import zlib

    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    train = [w for i, w in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = {r.doc_id: r for r in registry.queries()["op8_brown_lm"](spark, tiny).collect()}
    out = base = 0.0
    for i, w in docs:
        r = got[i]
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.n_known == sum(c[x] > 0 for x in w) + 1 and r.train_tokens == n
        if r.held_out:
            out, base = out + r.score, base + r.base_score
    assert out > base


def test_pipeline(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert {"doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"} == set(out.columns)
    assert out.count() > 0


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values())
