"""Streams with lifetimes against the batch operators on the same rows, cut into batches."""

import random

import pytest
from pyspark.sql import functions as F
from test_rules import collected

from vigil.operators import alerts, ppe, sequences
from vigil.streaming import lifetimes


def batches(spark, rows, schema, folder, n):
    """A stream that reads the rows, in their order, in n batches."""
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/b")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b")


@pytest.mark.parametrize("n", [1, 4])
def test_identities(spark, tmp_path, n):
    rng, rows = random.Random(3), []
    for i in range(240):
        kind = rng.choice([None, None, None, "entry", "exit"])
        rows.append(("c", rng.randrange(6), round(sum(rng.random() for _ in range(3)), 3), i if kind else None, kind, rng.choice(["known", "unknown_face", None])))
    at, out = 0.0, []
    for c, t, gap, i, k, s in rows:
        at += gap * (4 if len(out) % 40 == 39 else 0.4)
        out.append((c, t, at, i, k, s))
    schema = "camera_id string, track_id long, at double, alert_id long, subtype string, identity_status string"
    whole = spark.createDataFrame(out, schema).withColumn("ts", F.timestamp_seconds("at"))
    want = {r.alert_id: r.identity for r in alerts.exit_identities(whole.where("subtype IS NOT NULL"), whole.where("subtype IS NULL"), 5.0).collect()}
    s = batches(spark, out, schema, str(tmp_path), n).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "0 seconds")
    got = {r.alert_id: r.identity for r in collected(lifetimes.identity_stream(s), f"identities{n}")}
    assert got == want and None in got.values() and len(set(got.values())) > 2


@pytest.mark.parametrize("n", [1, 3])
def test_protective_equipment(spark, tmp_path, n):
    rng = random.Random(4)
    rows, check = [], 0
    for _ in range(400):
        check += rng.choice([1, 1, 2, 20])
        rows.append(("c", rng.choice(["z1", "z2"]), rng.randrange(2), rng.choice(["helmet", "vest"]), check, rng.choice(["absent", "absent", "absent", "present", "unclear"])))
    schema = "camera_id string, zone_id string, track_id long, item string, check_no long, state string"
    key = lambda r: (r.zone_id, r.track_id, r.item, r.check_no)
    want = sorted(map(key, ppe.violations(spark.createDataFrame(rows, schema), 3, 60).collect()))
    s = batches(spark, rows, schema, str(tmp_path), n).withColumn("ts", F.timestamp_seconds("check_no")).withWatermark("ts", "0 seconds")
    got = sorted(map(key, collected(lifetimes.ppe_stream(s, 3, 60), f"ppe{n}")))
    assert got == want and len(want) > 20
    assert want != sorted(map(key, ppe.violations(spark.createDataFrame(rows, schema), 3, 10_000).collect()))


@pytest.mark.parametrize("n", [1, 5])
def test_episodes(spark, tmp_path, n):
    rng, rows, at = random.Random(5), [], 0.0
    for _ in range(500):
        at += rng.choice([0.1, 0.2, 0.5, 2.0, 5.0])
        rows.append((rng.choice(["a", "b"]), at, int(rng.random() < 0.5), rng.choice([0.0, 20.0, 60.0])))
    schema = "camera_id string, at double, spark int, y double"
    want = sorted((r.camera_id, r.started) for r in sequences.episodes(spark.createDataFrame(rows, schema), ["camera_id"], "at", "spark", y="y").collect())
    got = sorted((r.camera_id, r.started) for r in collected(lifetimes.episode_stream(batches(spark, rows, schema, str(tmp_path), n)), f"episodes{n}"))
    assert got == want and len(want) > 5


def test_a_full_queue_drops_its_oldest(spark, tmp_path):
    rows = [("mail", i) for i in range(30)] + [("mail", 100)] + [("mail", None)] * 29
    got = collected(lifetimes.bounded_queue(batches(spark, rows, "lane string, seq long", str(tmp_path), 2), capacity=20, served=8), "queue")
    assert [(r.seq, r.dropped) for r in sorted(got, key=lambda r: r.seq)] == [(i, 10) for i in range(10, 26)]


def test_states_end_by_their_timer(spark):
    """A key that is silent for its lifetime is dropped when the watermark has passed it; one that is not has a later timer."""

    class State:
        exists, hasTimedOut, get, timer, gone = False, False, None, None, False

        def update(self, x):
            self.exists, self.get = True, x

        def remove(self):
            self.exists, self.gone = False, True

        def setTimeoutTimestamp(self, t):  # noqa: N802
            self.timer = t

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

    import pandas as pd

    held = {}

    class Rows:
        dtypes = [("k", "string")]

        def groupBy(self, *_):  # noqa: N802
            return self

        def applyInPandasWithState(self, run, *_):  # noqa: N802
            held["run"] = run

    lifetimes.keyed(Rows(), ["k"], ["at"], "n int", "n int", lambda s, x: ([], (1,)), 5.0)
    state = State()
    list(held["run"](("a",), iter([pd.DataFrame({"at": [1.0], "ts": [pd.Timestamp(1, unit="s")]})]), state))
    assert state.exists and state.timer == 6001
    state.hasTimedOut = True
    assert list(held["run"](("a",), iter([]), state)) == [] and state.gone
