"""Folds in sorted partitions: batches of any size, keys of any number, rows that belong together."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import folds, sequences

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(params=["10000", "3"])
def batches(spark, request):
    spark.conf.set(SIZE, request.param)
    yield request.param
    spark.conf.unset(SIZE)


def test_state_goes_on_from_batch_to_batch(spark, batches):
    rows = [(k, t) for k in ("a", "b", None) for t in range(20)] + [("c", 5)]
    df = spark.createDataFrame(rows, "k string, t long").orderBy(F.rand(3))

    def fold(total, part):
        out = []
        for t in part["t"]:
            total = (total or 0) + t
            out.append((t, total))
        return out, total

    got = sorted((r.k or "", r.t, r.total) for r in folds.folded(df, ["k"], ["t"], "t long, total long", fold).collect())
    assert got == sorted((k or "", t, t * (t + 1) // 2 if k != "c" else t) for k, t in rows)
    assert folds.folded(df.where("false"), ["k"], ["t"], "t long, total long", fold).count() == 0


def test_rows_that_belong_together_come_in_one_call(spark, batches):
    df = spark.createDataFrame([(k, t, i) for k in "ab" for t in range(6) for i in range(1 + t % 3 * 2)], "k string, t long, i long")
    got = folds.folded(df, ["k"], ["t", "i"], "t long, n long", lambda s, p: ([(t, p["t"].count(t)) for t in dict.fromkeys(p["t"])], None), "t").collect()
    assert sorted((r.k, r.t, r.n) for r in got) == [(k, t, 1 + t % 3 * 2) for k in "ab" for t in range(6)]


def test_throttle_by_hand(spark, batches):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([0.0, 3.0]) if k == "c" else 5.0, round(rng.random() * 300, 1), i) for i in range(300) for k in [rng.choice("abc")]]
    rows = [(k, {"a": 5.0, "b": 0.0, "c": 40.0}[k], t, i) for k, _, t, i in rows]
    want, last = [], {}
    for k, gap, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if gap <= 0 or k not in last or t - last[k] >= gap:
            last[k] = t
            want.append((k, i))
    got = sequences.throttle(spark.createDataFrame(rows, "k string, gap double, t double, i long"), ["k"], "t", "gap", "i").collect()
    assert sorted((r.k, r.i) for r in got) == sorted(want)


def test_schedules_by_hand(spark, batches):
    rng, rows, t = random.Random(2), [], 0.0
    for i in range(400):
        t += rng.choice([0.1, 0.3, 0.3, 0.4, 0.9, 2.5, 3.5]) if rng.random() < 0.9 else 30.0
        rows.append(("a", t, i))
    want, planned = [], None
    for _, t, i in rows:
        if planned is None or t >= planned:
            planned = t - 1.0 if planned is None else max(planned + 1.0, t - 1.0)
            want.append(i)
    got = sequences.scheduled(spark.createDataFrame(rows, "k string, t double, i long"), ["k"], "t", 1.0, "i").collect()
    assert sorted(r.i for r in got) == want and 50 < len(want) < 400


def recorded_by_hand(times, interval, segment, still, lost):
    out, written, began, kept, before = [], None, None, None, None
    for i, t in enumerate(times):
        if before is not None and t - before >= lost:
            began = None
        before = t
        if written is None or t - written >= interval:
            written = t
            began = t if began is None or t - began >= segment else began
            due = still > 0 and (kept is None or t - kept >= still)
            kept = t if due else kept
            out.append((i, began, due))
    return out


@pytest.mark.parametrize("still", [9.0, 0.0])
def test_recorder(spark, batches, still):
    draw = random.Random(5)
    times = {"a": [0.0], "b": [3.0, 3.0, 3.0], "c": []}
    for _ in range(300):
        times["a"].append(times["a"][-1] + draw.choice([0.0, 0.5, 1.0, 1.5, 1.5, 4.0, 7.0, 30.0]))
    df = spark.createDataFrame([(k, t, i) for k, ts in times.items() for i, t in enumerate(ts)], "camera_id string, at double, i long").orderBy(F.rand(2))
    got = sequences.recorded(df, ["camera_id"], "at", "i", 2.0, 20.0, still, 6.0).collect()
    for k, ts in times.items():
        assert sorted((r.i, r.segment, r.still) for r in got if r.camera_id == k) == recorded_by_hand(ts, 2.0, 20.0, still, 6.0)
