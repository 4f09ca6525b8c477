"""Protective equipment: violations of an item's rule by zone, track and item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Checks of a camera after which an item that wasn't looked at is forgotten.
KEPT_CHECKS = 300
KEYS = ["camera_id", "zone_id", "track_id", "item"]


def violations(checks: DataFrame, frames: int = 3, kept: int = KEPT_CHECKS) -> DataFrame:
    """KEYS and check_no at which an item has been absent so many checks in a row. checks: these and state, present or absent; any other is unclear.

    An unclear check neither counts nor starts anew, but keeps the item from being forgotten.
    """
    w = W.partitionBy(*KEYS).orderBy("check_no")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    x = checks.withColumn("_life", F.sum(F.when(F.col("check_no") - F.lag("check_no").over(w) > kept + 1, 1).otherwise(0)).over(so_far))
    x = x.where(F.col("state").isin("present", "absent"))
    x = x.withColumn("_seen", F.sum(F.when(F.col("state") == "present", 1).otherwise(0)).over(W.partitionBy(*KEYS, "_life").orderBy("check_no").rowsBetween(W.unboundedPreceding, 0)))
    x = x.where("state = 'absent'").withColumn("_age", F.row_number().over(W.partitionBy(*KEYS, "_life", "_seen").orderBy("check_no")))
    return x.where(F.col("_age") == frames).select(*KEYS, "check_no")
