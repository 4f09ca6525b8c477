import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions import geometry, schedule
from vigil.operators import alerts, sequences, similarity, zones
from vigil.streaming import stateful


def test_polygon_covers_its_edges_and_not_its_notch(spark):
    shape = geometry.edges(geometry.polygon([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]))
    points = spark.createDataFrame([(0.0, 0.0, True), (2.0, 1.0, True), (2.0, 3.0, False), (1.0, 1.0, True), (4.0, 2.0, True), (5.0, 2.0, False), (2.0, 0.5, True)], "x double, y double, want boolean")
    got = points.select("want", geometry.covers(shape, F.col("x"), F.col("y")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_polyline_takes_the_nearest_segment(spark):
    line = geometry.polygon([(0, 0), (10, 0), (10, 10)])
    points = spark.createDataFrame([(5.0, 1.0, "a"), (5.0, -1.0, "b"), (11.0, 5.0, "b"), (5.0, 0.0, "on")], "x double, y double, want string")
    got = points.select("want", geometry.side_of_polyline(line, F.col("x"), F.col("y")).alias("got")).collect()
    assert [(r.want, r.got) for r in got if r.want != r.got] == []


def test_overnight_schedule_belongs_to_the_day_before(spark):
    # 2024-01-01 is a Monday
    rows = [("2024-01-01 23:00:00", True), ("2024-01-02 05:00:00", True), ("2024-01-02 23:00:00", False), ("2024-01-01 05:00:00", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("ts", F.to_timestamp_ntz("t"))
    got = df.select("want", schedule.is_active(F.col("ts"), F.array(F.lit(0)), F.lit(79200), F.lit(21600)).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def fold(states, frames):
    confirmed, candidate, age, out = states[0], states[0], frames, []
    for i, s in enumerate(states[1:], 1):
        age = age + 1 if s == candidate else 1
        candidate = s
        if s != confirmed and age >= frames:
            confirmed = s
            out.append((i, s))
    return out


def test_hysteresis_equals_a_fold(spark):
    rng = random.Random(5)
    cases = {k: [rng.choice("io") for _ in range(rng.randint(1, 30))] for k in range(60)}
    df = spark.createDataFrame([(k, i, s) for k, v in cases.items() for i, s in enumerate(v)], "k long, i long, s string")
    got = sequences.confirmed_changes(df, ["k"], ["i"], "s", F.lit(3)).select("k", "i", "s").collect()
    assert sorted(map(tuple, got)) == sorted((k, i, s) for k, v in cases.items() for i, s in fold(v, 3))


def test_throttle_counts_from_what_passed(spark):
    df = spark.createDataFrame([("a", t, i, 10.0) for i, t in enumerate([0.0, 5.0, 9.0, 10.0, 19.0, 20.0])] + [("b", 0.0, 9, 0.0), ("b", 0.0, 8, 0.0)], "k string, t double, i long, g double")
    got = sequences.throttle(df, ["k"], "t", "g", "i").collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 0), ("a", 3), ("a", 5), ("b", 8), ("b", 9)]


def test_episode_latches_until_calm(spark):
    sparks = [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (9, 0), (10, 1), (11, 1), (12, 1)]
    df = spark.createDataFrame([("c", float(t), s) for t, s in sparks], "k string, t double, s int")
    got = sequences.episodes(df, ["k"], "t", "s").collect()
    assert sorted(r.started for r in got) == [2.0, 12.0]


def test_clusters():
    assert zones.cluster_sizes([(0, 0), (1, 0), (2, 0), (50, 50), (51, 50)], 1.0, 2) == [3, 2]
    assert zones.cluster_sizes([(0, 0), (9, 9)], 1.0, 2) == []


def test_suppression_and_matching(spark):
    boxes = [(1, 0, "pred", 0, 0.9, 0, 0, 10, 10), (2, 0, "pred", 0, 0.8, 1, 1, 11, 11), (3, 0, "pred", 0, 0.7, 50, 50, 60, 60), (4, 0, "gt", 0, 1.0, 0, 0, 10, 10)]
    names = "box_id long, image_id long, role string, class_id int, score double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(*b[:5], *map(float, b[5:])) for b in boxes], names)
    assert sorted(r[0] for r in similarity.suppress(df.where("role = 'pred'"), ["image_id"], 0.5).collect()) == [1, 3]
    r = similarity.precision_recall(df).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 0)


def test_near_hashes_meet_on_equal_chunks(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(63) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for v in values[:20]]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    got = {tuple(r) for r in similarity.near_hashes(df, 4).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if bin(values[i] ^ values[j]).count("1") <= 4}


@pytest.mark.parametrize("empty,want", [(6, [(1, "exit")]), (5, [])])
def test_left_view_exit_after_six_updates(empty, want):
    state = {}
    for u in range(1, 4):
        stateful.boundary_step(state, u, {1: (True, True)}, 2)
    got = [e for u in range(4, 4 + empty) for e in stateful.boundary_step(state, u, {}, 2)]
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [("cam", "bay", u, t, rng.random() < 0.5, rng.random() < 0.3) for u in range(1, 60) for t in (1, 2, 3) if rng.random() < 0.8]
    names = "camera_id string, zone_id string, update_no long, track_id long, inside boolean, at_edge boolean"
    for k in range(3):
        part = [r for r in rows if (r[2] - 1) // 20 == k]
        spark.createDataFrame(part, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = stateful.boundary_batch(spark.createDataFrame(rows, names), 2).toPandas()
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stateful.boundary_stream(stream, 2)
    q = out.writeStream.format("memory").queryName("got").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("got").toPandas()
    order = ["update_no", "track_id", "kind"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), batch.sort_values(order).reset_index(drop=True))


def test_stored_alerts_have_defaults(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    given = spark.sql("SELECT 1L AS alert_id, 'cam' AS camera_id, 'fire' AS kind, 'm' AS message, TIMESTAMP '2024-01-02 03:04:05' AS ts, 'high' AS severity, true AS delivered UNION ALL SELECT 2L, 'cam', 'fire', 'm', NULL, NULL, true")
    a, b = alerts.inserted(given, now).orderBy("alert_id").collect()
    assert (str(a.ts), a.severity, a.delivered, a.delivery_attempts, a.bbox) == ("2024-01-02 03:04:05", "high", False, 0, None)
    assert (str(b.ts), b.severity, b.zone_id) == ("2024-06-01 00:00:00", "medium", None)
    assert "zone_name" in alerts.inserted(given.where("false"), now).columns
