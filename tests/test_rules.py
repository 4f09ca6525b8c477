"""Rules against folds written out by hand, and streams against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.functions import geometry
from vigil.operators import alerts, dimensions, graph, sequences, tracking, validation, zones
from vigil.operators.similarity import overlap
from vigil.streaming import stateful


def episodes_by_hand(rows, window, needed, calm, jump):
    recent, latched, last, before, out = [], False, None, None, []
    for t, s, y in sorted(rows):
        counts = s and not (before is not None and y - before < -jump)
        if s:
            before, last = y, t
        recent = [*recent, counts][-window:]
        if latched and last is not None and t - last >= calm:
            latched, recent, before = False, [], None
        if s and not latched and sum(recent) >= needed:
            latched = True
            out.append(t)
    return out


def test_calm_forgets_only_while_an_episode_is_on(spark):
    rng = random.Random(3)
    cases = {0: [(t, t in (0, 0.5, 7), 0.0) for t in (0, 0.5, 2, 5, 6, 7)]}
    cases |= {k: [(float(t), rng.random() < 0.5, rng.choice([0.0, 20.0, 60.0])) for t in range(rng.randint(1, 40))] for k in range(1, 40)}
    df = spark.createDataFrame([(k, float(t), int(s), y) for k, v in cases.items() for t, s, y in v], "k long, t double, s int, y double")
    got = sequences.episodes(df, ["k"], "t", "s", y="y").collect()
    assert sorted((r.k, r.started) for r in got) == sorted((k, t) for k, v in cases.items() for t in episodes_by_hand(v, 10, 3, 4.0, 25.0))
    assert (0, 7.0) in {(r.k, r.started) for r in got}


def test_shapes_that_cross_themselves(spark):
    shapes = {"square": ([(0, 0), (1, 0), (1, 1), (0, 1)], []), "bow tie": ([(0, 0), (1, 1), (1, 0), (0, 1)], ["crosses itself", "no area"]), "notch": ([(0, 0), (1, 0), (1, 1), (0.5, 0.2), (0, 1)], []),
              "touching": ([(0, 0), (1, 0), (1, 1), (0.5, 0), (0, 1)], ["crosses itself"]), "triangle": ([(0, 0), (1, 0), (0, 1)], []), "outside": ([(0, 0), (2, 0), (0, 1)], ["outside 0 to 1"])}
    for name, (points, want) in shapes.items():
        assert spark.range(1).select(geometry.problems(geometry.polygon(points)).alias("p")).first().p == want, name


def test_lists_of_persons(spark):
    rows = [(1, "known", 7), (2, "known", 8), (3, "unknown_face", None), (4, "no_face", None), (5, None, None)]
    df = spark.createDataFrame([(i, "boundary", "entry", "z", s, p, "c", i) for i, s, p in rows], "alert_id long, kind string, subtype string, zone_id string, identity_status string, person_id long, camera_id string, track_id long")
    lists = spark.createDataFrame([("z", [7]), ("open", [])], "zone_id string, persons array<long>")
    assert sorted(r.alert_id for r in alerts.access_violations(df, lists).collect()) == [2, 3, 4]
    assert alerts.access_violations(df.withColumn("zone_id", F.lit("open")), lists).count() == 0


def test_identities_are_forgotten_after_a_gap(spark):
    ev = spark.createDataFrame([(1, "c", 1, 0.0, "entry", "known"), (2, "c", 1, 12.0, "exit", None), (3, "c", 2, 0.0, "entry", "known"), (4, "c", 2, 12.0, "exit", None)], "alert_id long, camera_id string, track_id long, s double, subtype string, identity_status string")
    seen = spark.createDataFrame([("c", 1, float(t)) for t in range(13)] + [("c", 2, 0.0), ("c", 2, 3.0), ("c", 2, 12.0)], "camera_id string, track_id long, s double")
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    got = {r.alert_id: r.identity for r in alerts.exit_identities(at(ev), at(seen), 5.0).collect()}
    assert got == {2: "known", 4: None}


def gate_by_hand(ticks, k, n, least):
    """ticks: tick -> boxes (det, klass, box). Confirmations (tick, klass) with every tick counted."""
    held, out = [], []
    for t in range(min(ticks), max(ticks) + 1):
        free = list(ticks.get(t, []))
        for c in held:
            near = [(overlap(c["box"], b), d, b) for d, kl, b in free if kl == c["klass"] and overlap(c["box"], b) >= least]
            if near:
                _, d, c["box"] = max(near)
                free = [x for x in free if x[0] != d]
                c["hits"].append(t)
        held += [{"klass": kl, "box": b, "hits": [t], "sure": False} for _, kl, b in free]
        held = [c for c in held if t - c["hits"][-1] < n]
        for c in held:
            if not c["sure"] and sum(t - h < n for h in c["hits"]) >= k:
                c["sure"] = True
                out.append((t, c["klass"]))
    return out


def test_gate_confirms_once(spark):
    rng = random.Random(8)
    rows = []
    for cam in "ab":
        for t in range(60):
            for _ in range(rng.choice([0, 0, 1, 2])):
                x, y = rng.choice([0, 6, 100]), rng.choice([0, 5])
                rows.append((cam, t, rng.choice(["fire", "smoke"]), len(rows), float(x), float(y), float(x + 20), float(y + 20)))
    df = spark.createDataFrame(rows, "camera_id string, tick long, klass string, det_id long, x1 double, y1 double, x2 double, y2 double")
    want = []
    for cam in "ab":
        ticks = {}
        for c, t, kl, d, *b in rows:
            if c == cam:
                ticks.setdefault(t, []).append((d, kl, tuple(b)))
        want += [(cam, t, kl) for t, kl in gate_by_hand(ticks, 3, 5, 0.3)]
    got = tracking.k_of_n(df, 3, 5, 0.3).collect()
    assert sorted((r.camera_id, r.tick, r.klass) for r in got) == sorted(want) and want


@pytest.mark.parametrize("chunk", [1 << 18, 97])
def test_components_of_any_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(1)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)] + [(i, i + 1) for i in range(2000, 2150)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len(up) and {r.id: r.component for r in got} == {x: root(x) for x in up}


def test_dimensions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(2, "x", 1, False), (2, "y", 2, False), (3, "c", 1, True), (4, "d", 1, False)], "k long, v string, _seq int, _removed boolean")
    assert sorted(map(tuple, dimensions.upsert(old, changes, "k").collect())) == [(1, "a"), (2, "y"), (4, "d")]
    poses = spark.createDataFrame([(1, p) for p in dimensions.POSES] + [(2, "front")] * 5, "person_id long, pose string")
    assert {r.person_id: r.accepted for r in dimensions.enrolments(poses).collect()} == {1: True, 2: False}
    versions = spark.createDataFrame([("s", 1, 1, []), ("s", 2, 2, []), ("s", 2, 3, ["bad"])], "store string, v int, zone int, errors array<string>")
    assert [r.zone for r in validation.last_good(versions, "store", "v").collect()] == [1]


def test_clusters_of_frames(spark):
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 1, 3.0, 0.0), ("a", 1, 50.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0), ("b", 2, 1.0, 0.0), ("b", 2, 2.0, 0.0)], "camera_id string, tick long, fx double, fy double")
    got = zones.largest_cluster(pts, ["camera_id", "tick"], 4.0).collect()
    assert {(r.camera_id, r.tick): r.largest for r in got} == {("a", 1): 2, ("b", 1): 0, ("b", 2): 3}


def stream(spark, df, folder):
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(query_of, name, mode="append"):
    q = query_of.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_of.sparkSession.table(name).collect()


def test_follow_ups_go_with_alerts_that_passed(spark, tmp_path):
    """Alert 2 is suppressed, so its follow-up is too, though alert 1 of the same key went out."""
    rows = [("a", 0.0, 1, False), ("a", 4.0, 2, False), ("a", 5.0, 1, True), ("a", 6.0, 2, True), ("a", 10.0, 4, False), ("b", 1.0, 5, True), ("b", 2.0, 6, False), ("b", 5000.0, 6, True)]
    df = spark.createDataFrame(rows, "key string, at double, alert_id long, followup boolean").repartition(4, "at")
    got = collected(stateful.throttle_stream(stream(spark, df.coalesce(1), str(tmp_path / "in")), 10.0), "throttled")
    assert sorted((r.at, r.alert_id) for r in got) == [(0.0, 1), (2.0, 6), (5.0, 1), (10.0, 4)]


def test_segments(spark, tmp_path):
    df = spark.createDataFrame([("a", t) for t in (0, 60, 899, 900, 5000)], "camera_id string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    got = collected(stateful.segment_counts(stream(spark, df, str(tmp_path / "in"))), "segments", "complete")
    assert sorted(r.n for r in got) == [1, 1, 3]


def test_written_once_and_delivered(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "k long, d string").withColumn("d", F.to_date("d")).coalesce(1)
    src, out, sent = str(tmp_path / "in"), str(tmp_path / "out"), []

    def broken(_):
        raise OSError("no way out")

    for run in range(2):  # the second run has a checkpoint of its own, and so repeats the batch
        s = stream(spark, df, src) if not run else spark.readStream.schema(df.schema).parquet(src)
        q = stateful.write_once(s, out, "k", str(tmp_path / f"c{run}"), {"broken": broken, "count": lambda b: sent.append(b.count())}, day="d")
        q.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2] and sent == [2, 0]


def test_sinks_are_tried_again_and_apart(spark):
    waits, calls = [], []

    def late(_):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("not yet")

    def never(_):
        raise ValueError("never")

    got = stateful.deliver(spark.range(1), {"late": late, "never": never}, sleep=waits.append)
    assert list(got) == ["never"] and len(calls) == 3 and waits == [0.5, 1.0, 0.5, 1.0]


def test_bad_versions_leave_the_last_good(spark):
    versions = iter([[(1, [])], [(2, ["bad"])], [(3, [])]])
    read = stateful.KeepLastGood(lambda: spark.createDataFrame(next(versions), "zone int, errors array<string>"), F.col("errors"))
    assert [[r.zone for r in read().collect()] for _ in range(3)] == [[1], [1], [3]]


def test_a_dimension_that_is_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(stateful, "MAX_DIMENSION", 2)
    with pytest.raises(ValueError, match="over 2 rows"):
        stateful.KeepLastGood(lambda: spark.range(3).withColumn("errors", F.array().cast("array<string>")), F.col("errors"))()


def test_null_keys_and_days_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(None, "2024-01-01"), (3, None), (4, "2024-01-01")], "k long, d string").withColumn("d", F.to_date("d")).coalesce(1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(2):
        s = stream(spark, df, src) if not run else spark.readStream.schema(df.schema).parquet(src)
        stateful.write_once(s, out, "k", str(tmp_path / f"c{run}"), day="d").awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_reset_forgets_tracks(spark):
    seen = [(u, 1, True, False, False) for u in range(1, 4)] + [(4, None, False, False, True)] + [(u, 1, False, False, False) for u in range(5, 8)]
    df = spark.createDataFrame([("c", "z", *r) for r in seen], "camera_id string, zone_id string, update_no long, track_id long, inside boolean, at_edge boolean, reset boolean")
    assert stateful.boundary_batch(df, 2).count() == 0 and stateful.boundary_batch(df.drop("reset"), 2).count() == 1


def test_gate_on_the_tables(spark, tiny):
    """The registered query against the gate walked tick by tick."""
    from vigil import plans
    from vigil.plans.more import with_box
    from vigil.sources.observations import view

    ticks = {}
    for r in with_box(view(spark, tiny, "detections").where("klass IN ('fire', 'smoke')")).collect():
        ticks.setdefault(r.camera_id, {}).setdefault(r.tick, []).append((r.det_id, r.klass, (r.x1, r.y1, r.x2, r.y2)))
    want = sorted((c, t, k) for c, x in ticks.items() for t, k in gate_by_hand({t: sorted(b) for t, b in x.items()}, 2, 48, 0.1))
    got = sorted((r.camera_id, r.tick, r.klass) for r in plans.queries()["kofn_gate"](spark, tiny).collect())
    assert got == want and want
