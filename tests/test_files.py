from vigil.operators import datasets
from vigil.sources import files


def test_labels_manifest_images(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "a.b.txt").write_text("0 0.5 0.5 0.2 0.4\n1 0.1 0.1\n\nx 0 0 0 0\n2 0.25 0.5 0.5 1.0\n")
    got = files.corners(files.label_boxes(spark, str(tmp_path / "labels")), 100, 100).collect()
    assert sorted((r.stem, r.class_id, round(r.x1), round(r.y2)) for r in got) == [("a.b", 0, 40, 70), ("a.b", 2, 0, 100)]
    (tmp_path / "m.jsonl").write_text('{"image": "a", "source": "s", "instances": [{"class": "vest", "domain": "d"}, {"class": "cap", "domain": null}]}\n\nbroken\n')
    assert sorted(r["class"] for r in files.manifest(spark, str(tmp_path / "m.jsonl")).collect()) == ["cap", "vest"]
    (tmp_path / "img").mkdir()
    for n in ("x.JPG", "y.png", "z.txt"):
        (tmp_path / "img" / n).write_bytes(b"12")
    assert sorted((r.stem, r.size) for r in files.images(spark, str(tmp_path / "img")).collect()) == [("x", 2), ("y", 2)]


def test_alert_table_and_coco(spark, tmp_path):
    alerts = spark.sql("SELECT 1L AS alert_id, TIMESTAMP '2024-01-02 03:04:05' AS ts, 'cam' AS camera_id, 'fire' AS kind")
    files.append_alerts(alerts, str(tmp_path / "alerts"))
    files.append_alerts(alerts, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).where("day = DATE '2024-01-02' AND camera_id = 'cam'").count() == 2
    boxes = spark.createDataFrame([(5, 1, 0, 0.0, 0.0, 2.0, 3.0), (4, 1, 1, 1.0, 1.0, 2.0, 2.0), (3, 2, 0, 0.0, 0.0, 1.0, 1.0)], "box_id long, image_id long, class_id int, x1 double, y1 double, x2 double, y2 double")
    notes = datasets.coco_annotations(boxes)
    assert [(r.annotation_id, r.box_id) for r in notes.orderBy("annotation_id").collect()] == [(1, 4), (2, 5), (3, 3)]
    got = {r.image_id: r.annotations for r in files.coco_records(notes).collect()}
    assert got[2] == '[{"annotation_id":3,"category_id":0,"bbox":[0.0,0.0,1.0,1.0],"area":1.0}]'
