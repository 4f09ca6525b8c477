"""What links move and keep."""

import random

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import links, ngram_join
from vigil.llm.common import bucketed


def test_verification_moves_no_table_of_bodies(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []

    def watched(pairs, bodies, sets_of, least, plain=links.similar_pairs):
        found = plain(pairs, bodies, sets_of, least)
        seen.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(links, "similar_pairs", watched)
    try:
        rng = random.Random(3)
        base = [[f"w{rng.randint(0, 999)}" for _ in range(80)] for _ in range(10)]
        rows = [(i, " ".join([*base[i % 10][: 80 - i // 10], *(f"x{i}" for _ in range(i // 10))])) for i in range(30)]
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i % 10 for i in range(30)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen
    for plan in seen:  # an exchange right above a scan of bodies would move them all
        lines = [x.strip(" :+-|*()0123456789") for x in plan.split("\n")]
        scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x and "body" in x]
        assert scans
        for i in scans:
            above = [x for x in lines[max(0, i - 5) : i] if x.startswith(("Project", "Filter", "ColumnarToRow", "Exchange", "Sort"))]
            assert not any(x.startswith("Exchange") for x in above), plan


def test_buckets_hold_what_was_written(spark):
    rows = spark.range(1000).select(F.col("id") % 7 * 1000 + F.col("id"), F.col("id").cast("string").alias("body")).toDF("id", "body")
    kept = bucketed(rows, "id")
    assert sorted(kept.collect()) == sorted(rows.collect())
    assert not any(t.name.startswith("vigil_") for t in spark.catalog.listTables())
    assert bucketed(rows.where("false"), "id").count() == 0


def test_signatures_of_one_id_go(spark):
    rng = random.Random(5)
    rows = [(i % 900, 5 + i % 3, [rng.randint(-3000, 3000) for _ in range(rng.randint(1, 6))]) for i in range(1000)] + [(7, 5, [77_777, 77_777]), (7, 5, [77_777]), (8, 5, [-(1 << 63), (1 << 63) - 1])]
    sets = spark.createDataFrame(rows, "id long, size long, sigs array<long>").repartition(5)
    ids = {}
    for i, _, sigs in rows:
        for s in sigs:
            ids.setdefault(s, set()).add(i)
    every = sorted((s, i, n) for i, n, sigs in rows for s in sigs)
    got = sorted(tuple(r) for r in links.shared_signatures(sets).collect())
    assert got == [x for x in every if len(ids[x[0]]) > 1] and len(got) < len(every)
    assert sorted(tuple(r) for r in links.shared_signatures(sets, most=10).collect()) == every
    assert links.shared_signatures(sets.where("false")).count() == 0


def test_large_sets_that_are_not_alike_meet_no_texts(spark, monkeypatch):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(4000 + 500 * k)] for k in range(6)]
    rows = [(10 * k + j, " ".join([*words[: len(words) - 40 * j], *(f"x{j}" for _ in range(j))])) for k, words in enumerate(base) for j in range(2)]
    met = []

    def watched(pairs, *rest, plain=links.similar_pairs):
        met.extend((r.a, r.b) for r in pairs.collect())
        return plain(pairs, *rest)

    def signers():  # all sets share a signature
        return lambda sets, wanted: (np.ones(int(wanted.sum()), np.uint64), np.concatenate(([0], np.cumsum(wanted))))

    monkeypatch.setattr(links, "similar_pairs", watched)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), signers=signers).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 10 * 10 for d, _ in rows}
    assert len(set(met)) == len(base)  # the pairs that are similar, and no other


def test_wide_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(11)
    for least in (80, 85):
        for n, m, common in ((1100, 1100, 1010), (2100, 2000, 1890), (2040, 2060, 1885), (9000, 7700, 7690), (5000, 5000, 3000), (3000, 3000, 0)):
            pool = rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64)
            p, q = np.sort(pool[:n]), np.sort(pool[n - common :])
            x, y = links.wide_sketches((np.concatenate((p, q)), np.array([0, n, n + m])))
            apart = links.places_apart(x, y)
            assert apart == links.places_apart(y, x) <= n + m - 2 * common
            if common * 100 < 60 * (n + m - common):
                assert (100 + least) * apart > (100 - least) * (n + m)
    assert links.wide_sketches((np.arange(1024, dtype=np.uint64), np.array([0, 1024, 1024]))) == [None, None]


def test_texts_move_once_on_their_way_to_buckets(spark, monkeypatch):
    seen = []

    def watched(df, by, name="table", deal=True, plain=ngram_join.bucketed):
        seen.append((name, deal, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, by, name, deal)

    monkeypatch.setattr(ngram_join, "bucketed", watched)
    rows = [(i, " ".join(f"w{k}" for k in range(40 + i))) for i in range(9)]
    ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ((deal, plan),) = ((d, p) for n, d, p in seen if n == "ngram-bodies")
    assert not deal and plan.count("Exchange") == 2  # of texts and of wanted rows, none of what they join to
