"""Zone documents from files: faults, versions, and a stream that joins what is good."""

import json

from vigil.sources import files

SQUARE = [{"x": x, "y": y} for x, y in ((0.1, 0.1), (0.6, 0.1), (0.6, 0.6), (0.1, 0.6))]


def put(folder, name, *documents):
    (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))


def test_documents_and_their_faults(spark, tmp_path):
    good = {"id": "yard", "points": SQUARE, "camera_id": "a"}
    put(tmp_path, "z.json", good, {"id": "mask", "type": "exclusion", "points": SQUARE[:2], "min_frames": 0}, {"id": "twice", "points": SQUARE}, {"id": "twice", "points": SQUARE, "from": "22:00"}, "{broken")
    got = sorted((r.id or "", list(r.errors)) for r in files.zone_documents(spark, str(tmp_path)).collect())
    assert got == [("", ["no document", "no id", "no points"]), ("mask", ["min_frames below 1", "applies to nothing", "too few points", "no area"]), ("twice", ["duplicate id"]), ("twice", ["one of two times", "duplicate id"]), ("yard", [])]


def test_a_bad_version_leaves_the_last_good_one_to_the_stream(spark, tmp_path):
    zones, rows, out = tmp_path / "zones", tmp_path / "rows", []
    zones.mkdir()
    put(zones, "z.json", {"id": "v1", "points": SQUARE, "camera_id": "a"})
    feed = files.zone_feed(spark, str(zones))
    versions = iter([[{"id": "v2", "points": SQUARE[:1], "camera_id": "a"}], [{"id": "v3", "points": SQUARE, "camera_id": "a"}]])

    def batch(df, _):
        out.append(sorted(r.id for r in df.join(feed(), "camera_id").collect()))
        if (v := next(versions, None)) is not None:
            put(zones, "z.json", *v)

    for k in range(3):
        spark.createDataFrame([("a", k)], "camera_id string, n int").coalesce(1).write.mode("append").parquet(str(rows))
    s = spark.readStream.schema("camera_id string, n int").option("maxFilesPerTrigger", 1).parquet(str(rows))
    s.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert out == [["v1"], ["v1"], ["v3"]] and feed.problem == ""
