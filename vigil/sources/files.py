"""File sources and sinks: label text, JSON-lines manifests, image listings, alert tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import validation
from vigil.streaming.stateful import KeepLastGood

MANIFEST = "image string, source string, instances array<struct<class:string,domain:string>>"
ALERTS = (
    "alert_id long, ts timestamp, camera_id string, kind string, subtype string, zone_id string, zone_name string, track_id long, message string, severity string, confidence double, "
    "bbox array<double>, foot_point array<double>, person_id string, identity_status string, identity_name string, snapshot_uri string, clip_uri string, clip_status string, delivered boolean, delivery_attempts int, delivery_error string"
)


def stem(path: F.Column) -> F.Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def label_boxes(spark: SparkSession, path: str) -> DataFrame:
    """stem, class_id, cx, cy, w, h of label files with a box a line; lines without five fields are skipped."""
    return label_lines(spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("stem"), "value"))


def label_lines(lines: DataFrame) -> DataFrame:
    """The same of lines (stem, value)."""
    x = lines.select("stem", F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") == 5)
    number = lambda i: F.expr(f"try_cast(v[{i}] AS double)")
    return x.select("stem", F.expr("try_cast(v[0] AS int)").alias("class_id"), *[number(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)]).where("class_id IS NOT NULL")


def corners(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Normalised centre boxes as pixel corners."""
    c = F.col
    return boxes.select(
        "stem", "class_id", ((c("cx") - c("w") / 2) * width).alias("x1"), ((c("cy") - c("h") / 2) * height).alias("y1"), ((c("cx") + c("w") / 2) * width).alias("x2"), ((c("cy") + c("h") / 2) * height).alias("y2")
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """image, source, class, domain of each instance; blank and broken lines are skipped."""
    x = spark.read.schema(MANIFEST).json(path, mode="DROPMALFORMED")
    return x.select("image", "source", F.explode("instances").alias("i")).select("image", "source", F.col("i.class").alias("class"), F.col("i.domain").alias("domain"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, size of the images under a folder; contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select("path", stem(F.col("path")).alias("stem"), F.col("length").alias("size"))


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts by day and camera, so that history and retention read or drop whole folders."""
    alerts.withColumn("day", F.to_date("ts")).repartition("day", "camera_id").sortWithinPartitions("day", "camera_id", "ts").write.mode("append").partitionBy("day", "camera_id").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def coco_records(annotations: DataFrame) -> DataFrame:
    """One JSON text an image: its annotations in order (from operators.datasets.coco_annotations)."""
    row = F.struct("annotation_id", F.col("class_id").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), "area")
    return annotations.groupBy("image_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("annotations"))


ZONES = (
    "id string, type string, points array<struct<x:double,y:double>>, severity string, direction string, events array<string>, detect array<string>, min_frames int, applies_to array<string>, days array<string>, `from` string, `to` string, "
    "crowd_threshold int, crowd_min_frames int, ppe_required array<string>, camera_id string"
)


def zone_documents(spark: SparkSession, path: str) -> DataFrame:
    """Zone documents (JSON, one a line) with errors: what is wrong with each, broken lines and repeated ids included."""
    x = spark.read.schema(f"{ZONES}, _broken string").json(path, columnNameOfCorruptRecord="_broken").withColumn("zone", F.struct("id", "type", "points", "severity", "direction", "events", "detect", "min_frames", "applies_to", "days", "from", "to", "crowd_threshold", "crowd_min_frames", "ppe_required"))
    faults = F.concat(validation.messages((F.col("_broken").isNotNull(), "no document")), validation.zone_errors("zone"))
    return validation.checked(x, "id", faults).drop("_broken")


def zone_feed(spark: SparkSession, path: str) -> KeepLastGood:
    """The zones of a folder of documents as they are at each call; a version with any fault leaves the one before in place.

    Call it in each batch of a stream, and join the batch with what it gives.
    """
    return KeepLastGood(lambda: zone_documents(spark, path), F.col("errors"))
