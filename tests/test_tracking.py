"""Tracks: motion, confirmation, loss, and batches that carry what is live."""

import random
import time
import tracemalloc

import numpy as np

from vigil.operators import tracking
from vigil.operators.similarity import overlap

SCHEMA = "camera_id string, tick long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"


def box(tick, det, x, y, score=0.9, camera="a", w=40.0, h=80.0):
    x, y = float(x), float(y)
    return (camera, tick, det, score, x, y, x + w, y + h)


def tracks(spark, rows, **how):
    got = tracking.track(spark.createDataFrame(rows, SCHEMA), **how).collect()
    assert len(got) == len({r.det_id for r in got})
    return {r.det_id: r.track_id for r in got}


def test_filters_follow_what_moves_evenly():
    m = tracking.Motion(np.array([[0.0, 0.0, 0.5, 80.0]]))
    for k in range(1, 25):
        m.predict()
        m.update(np.array([0]), np.array([[9.0 * k, 4.0 * k, 0.5, 80.0]]))
    m.predict()
    assert np.abs(m.x[0] - [225.0, 100.0, 0.5, 80.0]).max() < 3 and abs(m.v[0, 0] - 9) < 0.5
    before = m.p.copy()
    m.predict()
    assert (m.p > before).all()  # less sure as long as it isn't seen


def test_a_filter_equals_the_matrix_form():
    """One coordinate by hand with 2 x 2 matrices."""
    h, rng = 80.0, random.Random(2)
    m = tracking.Motion(np.array([[5.0, 0.0, 0.5, h]]))
    x, P = np.array([5.0, 0.0]), np.diag([(2 * h / 20) ** 2, (10 * h / 160) ** 2])
    A, H = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    for _ in range(15):
        x, P = A @ x, A @ P @ A.T + np.diag([(h / 20) ** 2, (h / 160) ** 2])
        m.predict()
        z = rng.random() * 10
        S = H @ P @ H.T + (h / 20) ** 2
        K = P @ H.T / S
        x, P = x + (K * (z - x[0])).ravel(), P - K @ H @ P
        m.update(np.array([0]), np.array([[z, 0.0, 0.5, h]]))
        assert np.allclose([m.x[0, 0], m.v[0, 0], m.p[0, 0], m.q[0, 0], m.r[0, 0]], [x[0], x[1], P[0, 0], P[0, 1], P[1, 1]])


def test_tracks_are_sure_after_two_frames(spark):
    rows = [box(1, 0, 0, 0), box(2, 1, 2, 0), box(3, 2, 4, 0)]  # a walker
    rows += [box(1, 10, 500, 0), box(3, 11, 502, 0), box(4, 12, 504, 0)]  # missed in its second frame: begins anew
    rows += [box(2, 20, 900, 0)]  # seen once
    assert tracks(spark, rows) == {1: 0, 2: 0, 12: 11}


def test_walkers_that_cross_keep_their_tracks(spark):
    """Two walk towards each other and hide one another for a few frames; by place alone they would be mixed up."""
    rows = []
    for t in range(40):
        a, b = 10.0 * t, 400.0 - 10.0 * t
        if not 17 <= t <= 23:
            rows += [box(t, 100 + t, a, 0), box(t, 200 + t, b, 4)]
    got = tracks(spark, rows, lost_after=30)
    assert {got[100 + t] for t in range(1, 40) if 100 + t in got} == {100} and {got[200 + t] for t in range(1, 40) if 200 + t in got} == {200}
    assert len(got) == len(rows) - 2


def test_weak_boxes_go_on_but_begin_nothing(spark):
    rows = [box(t, t, 2.0 * t, 0, score=0.9 if t < 5 else 0.2) for t in range(12)] + [box(t, 50 + t, 700.0, 0, score=0.3) for t in range(12)] + [box(t, 80 + t, 900.0, 0, score=0.05) for t in range(12)]
    assert tracks(spark, rows) == {t: 0 for t in range(1, 12)}


def test_tracks_end_after_silence(spark):
    rows = [box(t, t, 0.0, 0) for t in range(5)] + [box(20, 20, 0.0, 0), box(21, 21, 0.0, 0), box(60, 60, 0.0, 0), box(61, 61, 0.0, 0)]
    assert tracks(spark, rows, lost_after=30) == {1: 0, 2: 0, 3: 0, 4: 0, 20: 0, 21: 0, 61: 60}


def test_batches_carry_what_is_live(spark):
    """A camera that is never silent, in batches of few rows, and another with gaps: the same tracks as in one piece."""
    rng, rows = random.Random(6), []
    for camera in "ab":
        people = [[rng.random() * 800, rng.random() * 400, rng.uniform(-6, 6), rng.uniform(-3, 3)] for _ in range(6)]
        for t in range(120):
            if camera == "b" and 50 <= t < 62:
                continue
            for k, p in enumerate(people):
                p[0] += p[2]
                p[1] += p[3]
                if rng.random() < 0.85:
                    rows.append(box(t, len(rows), p[0] + rng.random(), p[1] + rng.random(), score=rng.choice([0.9, 0.7, 0.2]), camera=camera))
                if rng.random() < 0.02:
                    people[k] = [rng.random() * 800, rng.random() * 400, 3.0, 1.0]
    whole = tracks(spark, rows, lost_after=8)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "37")
    try:
        assert whole == tracks(spark, rows, lost_after=8) and 6 < len(set(whole.values())) < 60
    finally:
        spark.conf.unset(size)


def by_matrix(a, b, least):
    """All pairs, sorted: the most overlap first, then by row and column."""
    pairs = [(-overlap(tuple(x), tuple(y)), i, j) for i, x in enumerate(a.tolist()) for j, y in enumerate(b.tolist())]
    out, rows, columns = [], set(), set()
    for share, i, j in sorted(pairs):
        if -share >= least and i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return out


def test_matching_equals_all_pairs(monkeypatch):
    """Boxes on a lattice, with many ties and many at one place; chance boxes; few pairs or comparisons at once; flat boxes."""
    rng = np.random.default_rng(3)
    for k in range(45):
        n, m, step = rng.integers(0, 40), rng.integers(0, 40), [1, 10, 40][k % 3]
        make = lambda size: np.concatenate((xy := rng.integers(0, 160 // step, (size, 2)) * step * (1.0 if k % 2 else 0.9), xy + rng.integers(0 if k % 5 == 0 else 1, 4, (size, 2)) * 20), axis=1)
        a, b = make(n), make(m)
        for chunk, pairs in ((1 << 20, 1 << 21), (7, 3)):
            monkeypatch.setattr(tracking, "CHUNK", chunk)
            monkeypatch.setattr(tracking, "PAIRS", pairs)
            for least in (0.2, 0.5, 0.0):
                assert sorted(tracking.matched(a, b, least)) == sorted(by_matrix(a, b, least))


def test_a_crowded_frame_makes_no_matrix():
    """12,000 boxes of 600 places against as many tracks: a matrix alone would hold over 1 GB."""
    rng = np.random.default_rng(5)
    at = np.repeat(rng.integers(0, 900, (600, 2)).astype(float), 20, axis=0)
    a = np.concatenate((at, at + [300.0, 200.0]), axis=1)
    b = a[rng.permutation(len(a))] + np.repeat(rng.normal(0, 3, (3000, 1)), 4, axis=0)
    tracemalloc.start()
    try:
        pairs = tracking.matched(a, b, 0.2)
        assert tracemalloc.get_traced_memory()[1] < 600e6
    finally:
        tracemalloc.stop()
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == len(a)


def test_choices_equal_one_by_one(monkeypatch):
    """Each candidate in turn against all free boxes, on lattices with many ties; few choosers, comparisons or pairs at once."""
    rng = np.random.default_rng(9)
    for k in range(60):
        step = [1, 10, 40][k % 3]
        make = lambda n: np.concatenate((xy := rng.integers(0, 160 // step, (n, 2)) * float(step), xy + rng.integers(0 if k % 5 == 0 else 1, 4, (n, 2)) * [10.0, 30.0]), axis=1)
        a, b = make(rng.integers(0, 50)), make(rng.integers(0, 30))
        for least in (0.1, 0.4, 0.0):
            free, want = list(range(len(b))), []
            for i, x in enumerate(a.tolist()):
                best = max(((overlap(tuple(x), tuple(b[j].tolist())), j) for j in free), default=(-1.0, -1))
                if best[0] >= least:
                    want.append((i, best[1]))
                    free.remove(best[1])
            for choosers, chunk, pairs in ((512, 1 << 20, 1 << 21), (5, 7, 3)):
                for name, value in (("CHOOSERS", choosers), ("CHUNK", chunk), ("PAIRS", pairs)):
                    monkeypatch.setattr(tracking, name, value)
                assert list(zip(*(x.tolist() for x in tracking.chosen(a, b, least)), strict=True)) == want


def test_a_crowded_gate_is_quick(spark):
    """Four frames of 6,000 boxes: one by one, each candidate would be held against up to 6,000 boxes a frame."""
    rng = np.random.default_rng(2)
    xy = rng.integers(0, 1000, (24_000, 2)).tolist()
    x = spark.createDataFrame([("a", k // 6000, "fire", k, float(p), float(q), p + 40.0, q + 100.0) for k, (p, q) in enumerate(xy)], "camera_id string, tick long, klass string, det_id long, x1 double, y1 double, x2 double, y2 double")
    began = time.monotonic()
    got = tracking.candidates(x, 48, 0.1).collect()
    assert time.monotonic() - began < 15 and len(got) == 24_000
