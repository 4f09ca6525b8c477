"""Observation tables from the driver's generic tables, as Spark SQL over temporary views.

Every adapter is deterministic and reads only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADAPTERS = {
    "detections": """
SELECT event_id AS det_id, 'cam_0' || CAST(1 + user_id % 4 AS STRING) AS camera_id, user_id AS track_id, CAST(n AS BIGINT) AS obs_no, ts,
 CAST(EXTRACT(DAY FROM ts) * 24 + EXTRACT(HOUR FROM ts) AS BIGINT) AS tick,
 CAST(abs((n * 60 + user_id * 37) % 2000 - 1000) AS DOUBLE) AS fx, CAST(abs((n * 40 + user_id * 53) % 2000 - 1000) AS DOUBLE) AS fy,
 CAST(5 + (event_id * 31) % 95 AS DOUBLE) / CAST(100 AS DOUBLE) AS score,
 CASE event_type WHEN 'error' THEN 'fire' WHEN 'signup' THEN 'smoke' ELSE 'person' END AS klass
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) e""",
    "alerts": """
SELECT event_id AS alert_id, ts, 'cam_0' || CAST(1 + user_id % 4 AS STRING) AS camera_id,
 CASE event_type WHEN 'view' THEN 'boundary' WHEN 'click' THEN 'crowd' WHEN 'purchase' THEN 'ppe' WHEN 'error' THEN 'fire' ELSE 'smoke' END AS kind,
 CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'entry' ELSE 'exit' END
  WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'formed' ELSE 'dispersed' END WHEN 'purchase' THEN 'helmet' END AS subtype,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'zone_' || CAST(user_id % 5 AS STRING) END AS zone_id, user_id AS track_id,
 CASE WHEN value < 5 THEN 'low' WHEN value < 15 THEN 'medium' WHEN value < 40 THEN 'high' ELSE 'critical' END AS severity,
 CASE WHEN event_type <> 'view' THEN NULL WHEN event_id % 3 = 0 THEN 'known' WHEN event_id % 3 = 1 THEN 'unknown_face' ELSE 'no_face' END AS identity_status
FROM events""",
    "zones": """
SELECT z.*, c.camera_id FROM (VALUES ('bay','polygon',200,200,800,800,4,'high',NULL), ('gate','polygon',0,400,500,900,2,'medium',NULL),
 ('mask','exclusion',600,600,900,900,NULL,'low',NULL), ('server','fire_roi',100,100,400,400,NULL,'critical',CAST(-0.2 AS DOUBLE)))
 AS z(zone_id, ztype, x0, y0, x1, y1, min_frames, severity, conf_delta) CROSS JOIN (VALUES ('cam_01'), ('cam_02'), ('cam_03'), ('cam_04')) AS c(camera_id)""",
    "site_zones": """
SELECT * FROM (VALUES ('cam_01',1,'yard','polygon',100,100,700,700,2,'high',NULL,'a_to_b','entry,exit','person',NULL,NULL,NULL,NULL),
 ('cam_01',2,'yard_mask','exclusion',500,500,900,900,NULL,'low',NULL,NULL,NULL,'person',NULL,NULL,NULL,NULL),
 ('cam_02',3,'dock','polygon',0,300,600,1000,3,'medium',NULL,'both','exit',NULL,NULL,NULL,NULL,NULL),
 ('cam_02',4,'stove','fire_roi',200,200,800,800,NULL,'critical',CAST(-0.15 AS DOUBLE),NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('cam_02',5,'oven','fire_roi',400,0,1000,500,NULL,'critical',CAST(-0.8 AS DOUBLE),NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('cam_03',6,'night','polygon',200,200,900,900,2,'high',NULL,'b_to_a',NULL,NULL,'0,2,4',79200,21600,NULL),
 ('cam_03',7,'night_mask','exclusion',0,0,500,500,NULL,'low',NULL,NULL,NULL,'fire,smoke','1,3,5',0,43200,NULL),
 ('cam_04',8,'hall','polygon',0,0,1000,500,4,'medium',NULL,NULL,'entry',NULL,NULL,NULL,NULL,NULL),
 ('cam_04',9,'warm','fire_roi',0,0,1000,1000,NULL,'critical',CAST(0.3 AS DOUBLE),NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('cam_04',10,'unnamed_mask','exclusion',0,0,1000,1000,NULL,'low',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL),
 ('cam_01',11,'fence','tripwire',NULL,NULL,NULL,NULL,2,'high',NULL,'a_to_b',NULL,'person',NULL,NULL,NULL,'0,500;500,300;1000,600'),
 ('cam_02',12,'gate','tripwire',NULL,NULL,NULL,NULL,1,'medium',NULL,'b_to_a','exit,entry',NULL,NULL,NULL,NULL,'200,0;400,500;300,1000'),
 ('cam_03',13,'path','tripwire',NULL,NULL,NULL,NULL,2,'low',NULL,'both','entry',NULL,NULL,NULL,NULL,'0,0;1000,1000'))
 AS z(camera_id, zone_order, zone_id, ztype, x0, y0, x1, y1, min_frames, severity, conf_delta, direction, events, classes, days, from_s, to_s, points)""",
    "alert_rules": """
SELECT * FROM (VALUES ('r1','medium',3600,'boundary,crowd',true), ('r2','high',0,'',true), ('r3','low',86400,'fire',true), ('r4','low',600,'',false), ('r5','critical',43200,'',true))
 AS r(rule_id, min_severity, cooldown_s, kinds, enabled)""",
    "boxes": """
SELECT event_id AS box_id, CAST((event_id - event_id % 8) / 8 AS BIGINT) AS image_id, CASE WHEN event_id % 2 = 0 THEN 'gt' ELSE 'pred' END AS role,
 CAST((k + CASE WHEN event_id % 2 = 1 AND k % 11 = 0 THEN 1 ELSE 0 END) % 3 AS INT) AS class_id,
 CAST(5 + (event_id * 31) % 95 AS DOUBLE) / CAST(100 AS DOUBLE) AS score,
 CAST(k * 137 % 500 + j AS DOUBLE) AS x1, CAST(k * 211 % 300 + j AS DOUBLE) AS y1,
 CAST(k * 137 % 500 + j + 40 + k * 17 % 80 AS DOUBLE) AS x2, CAST(k * 211 % 300 + j + 40 + k * 29 % 80 AS DOUBLE) AS y2
FROM (SELECT event_id, CAST((event_id - event_id % 2) / 2 AS BIGINT) AS k,
  CASE WHEN event_id % 2 = 1 THEN CAST((event_id - event_id % 2) / 2 AS BIGINT) * 13 % 30 ELSE 0 END AS j FROM events) b""",
    "gallery": """
SELECT label AS person_id, CAST(rn AS BIGINT) AS pose_idx, vec_id, embedding FROM
 (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) g WHERE rn <= 5""",
    "probes": """
SELECT vec_id, label AS true_label, embedding FROM
 (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) p WHERE rn > 5""",
}
#: What each adapter reads.
READS = {"detections": "events", "alerts": "events", "boxes": "events", "gallery": "embeddings", "probes": "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An observation table by its adapter's name."""
    if name == "site_zones":  # lists are written with commas
        x = spark.sql(ADAPTERS[name])
        point = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
        return x.withColumns({"events": F.split("events", ","), "classes": F.split("classes", ","), "days": F.split("days", ",").cast("array<int>"), "points": F.transform(F.split("points", ";"), point)})
    if name == "alert_rules":
        return spark.sql(ADAPTERS[name]).withColumn("kinds", F.filter(F.split("kinds", ","), lambda k: k != ""))
    if name not in READS:
        return spark.sql(ADAPTERS[name])
    return spark.sql(ADAPTERS[name].replace(f"FROM {READS[name]}", "FROM {source}"), source=table(spark, sf_dir, READS[name]))


def prelude(*names: str) -> str:
    """The same tables as common table expressions, for SQL over pre-registered tables."""
    return "WITH " + ", ".join(f"{n} AS ({ADAPTERS[n]})" for n in names)
