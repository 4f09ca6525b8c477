"""Frames near alerts in time: against SQL on odd rows, and without pairs of alerts and frames."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd

from vigil.operators import alerts as A
from vigil.operators import sequences as S
from vigil.plans.catalogue import seconds

START = datetime(2024, 1, 1, 5, 0, 0)
FRAMES, ALERTS = "camera_id string, det_id long, ts timestamp_ntz", "camera_id string, alert_id long, ts timestamp_ntz"


def odd_rows():
    """Frames and alerts at full hours, on equal instants, equally far on both sides, exactly at limits, without camera or time."""
    rng = random.Random(4)
    frames, alerts = [], []
    for k in range(60):
        t = START + timedelta(hours=rng.randrange(400), microseconds=rng.choice([0, 1, 999_999, rng.randrange(3_600_000_000)]))
        camera = rng.choice("ab")
        alerts += [(camera, k, t)] * rng.choice([1, 1, 2])
        for far in rng.sample([1, 5, 13, 777_777, 1_800_000_000, 3_599_999_999, 3_600_000_000, 3_600_000_001, 5_400_000_000], 2):
            frames += [(camera, rng.randrange(1000), t + timedelta(microseconds=s * far)) for s in rng.choice([(-1, 1), (1, -1), (-1,), (1,)])]
    frames += [("a", 2000 + k, frames[k][2]) for k in range(20)] + [(None, 3000, START), ("b", 3001, None)]
    alerts += [(None, 900, START), ("b", 901, None), ("c", 902, START)]
    return frames, alerts


def sql(frames, alerts, text):
    con = duckdb.connect()
    con.register("f", pd.DataFrame(frames, columns=["camera_id", "det_id", "ts"]))
    con.register("a", pd.DataFrame(alerts, columns=["camera_id", "alert_id", "ts"]))
    con.execute("CREATE TABLE detections AS SELECT camera_id, det_id, CAST(ts AS TIMESTAMP) AS ts FROM f")
    con.execute("CREATE TABLE alerts AS SELECT camera_id, alert_id, CAST(ts AS TIMESTAMP) AS ts FROM a")
    return sorted(con.execute(text).fetchall())


def of(spark, frames, alerts):
    return spark.createDataFrame(alerts, ALERTS), spark.createDataFrame(frames, FRAMES)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


NEAREST = """SELECT alert_id, arg_min(det_id, struct_pack(d := gap, i := det_id)) FROM (SELECT a.alert_id, d.det_id, abs(epoch(a.ts) - epoch(d.ts)) AS gap FROM alerts a
 JOIN detections d ON a.camera_id = d.camera_id AND d.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR) GROUP BY alert_id"""


def test_nearest_frames_equal_sql(spark):
    frames, alerts = odd_rows()
    got = sorted(tuple(r) for r in A.nearest_frames(*of(spark, frames, alerts), 3600).collect())
    assert got == sql(frames, alerts, NEAREST) and 40 < len(got) <= 60


def test_nearest_frames_make_no_pairs(spark, tiny):
    from vigil import plans

    assert joins(plans.queries()["snapshot_nearest"](spark, tiny)) == 0


def test_clip_counts_equal_sql(spark):
    frames, alerts = odd_rows()
    text = """SELECT a.alert_id, count(d.det_id) FROM alerts a LEFT JOIN detections d ON d.camera_id = a.camera_id
     AND epoch(d.ts) BETWEEN epoch(a.ts) + 1800 - 5400 AND epoch(a.ts) + 1800 GROUP BY a.alert_id"""
    assert sorted(tuple(r) for r in A.clip_counts(*of(spark, frames, alerts), 5400, 1800).collect()) == sql(frames, alerts, text)


def test_clip_counts_make_no_pairs(spark, tiny):
    from vigil import plans

    assert joins(plans.queries()["clip_ring_join"](spark, tiny)) == 0


def test_clip_windows_make_no_pairs(spark, tiny):
    from vigil import plans

    assert joins(plans.queries()["clip_window_join"](spark, tiny)) == 0


def test_clip_windows_equal_sql(spark):
    frames, alerts = odd_rows()
    text = """SELECT a.alert_id, count(d.det_id) FROM alerts a JOIN detections d ON d.camera_id = a.camera_id
     AND d.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR GROUP BY a.alert_id"""
    assert sorted(tuple(r) for r in A.clip_counts(*of(spark, frames, alerts), 7200, 3600).where("frames > 0").collect()) == sql(frames, alerts, text)


RING = "SELECT det_id, count(*) OVER (PARTITION BY camera_id ORDER BY epoch(ts) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) FROM detections"


def test_rings_equal_sql(spark):
    """Rows that are exactly the ring's length apart count, at whatever microsecond; rows that are equal stay apart; rows without camera or time are rings of their own."""
    frames = odd_rows()[0]
    frames += [("r", 5000 + k, START + timedelta(seconds=7200 * (k % 2), microseconds=172_411 + 29 * (k // 2))) for k in range(80)] + frames[:5]
    x = spark.createDataFrame(frames, FRAMES).withColumn("at", seconds("ts"))
    assert sorted(tuple(r) for r in S.held(x, ["camera_id"], "at", 7200.0).select("det_id", "held").collect()) == sql(frames, [("a", 1, START)], RING)


def test_rings_do_not_walk_a_camera_in_one_task(spark, tiny):
    from vigil import plans

    plan = plans.queries()["ring_buffer"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "-7200000000" not in plan and "_stretch" in plan
