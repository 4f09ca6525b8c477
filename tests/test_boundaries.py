"""Boundary windows against the stream's steps, update by update."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import boundaries
from vigil.streaming import stateful

KINDS = "camera_id string, zone_id string, update_no long, track_id long, inside boolean, at_edge boolean"


def walks(seed, zones, length):
    """Random observations: tracks come and go at the edge and in the middle, with short and long absences."""
    rng, rows = random.Random(seed), []
    for z in range(zones):
        last = rng.choice([length, length // 3])
        for track in range(3):
            u, inside = rng.choice([1, 3, 7, 9, 20]), rng.random() < 0.5
            while u <= last:
                rows.append(("c", f"z{z}", u, track, inside, rng.random() < 0.6))
                if rng.random() < 0.4:
                    inside = not inside
                u += rng.choice([1, 1, 1, 1, 2, 5, 6, 7, 8, 12, 300, 301, 302, 303])
        rows += [("c", f"z{z}", u, None, False, False) for u in range(1, length + 1)]
    return rows


@pytest.mark.parametrize("frames", [1, 2, 3, 4])
def test_windows_equal_the_steps(spark, frames):
    df = spark.createDataFrame(walks(frames, 40, 700), KINDS)
    want = sorted(map(tuple, stateful.boundary_batch(df, frames).collect()))
    got = sorted((r.camera_id, r.zone_id, r.track_id, r.update_no, r.kind) for r in boundaries.boundary_events(df, frames).collect())
    assert got == want and len(want) > 50


def test_a_run_goes_on_over_absences(spark):
    """Seen inside at the edge, once in every eight updates: the third sight makes three in a row."""
    seen = [("c", "z", u, 1, u > 1, True) for u in (1, 2, 10, 18, 26, 34, 42)]
    df = spark.createDataFrame(seen, KINDS)
    got = sorted((r.update_no, r.kind) for r in boundaries.boundary_events(df, 3).collect())
    assert got == [(18, "entry"), (24, "exit"), (42, "entry")]
    clock = spark.createDataFrame([("c", 48)], "camera_id string, newest long")
    assert sorted((r.update_no, r.kind) for r in boundaries.boundary_events(df, F.lit(3), clock).collect())[-1] == (48, "exit")


def test_nothing_observed(spark):
    assert boundaries.boundary_events(spark.createDataFrame([], KINDS), 2).count() == 0
    assert boundaries.boundary_events(spark.createDataFrame([("c", "z", 1, None, False, False)], KINDS), 2).count() == 0
