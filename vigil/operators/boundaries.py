"""Boundary events in full, as windows over each track's own updates.

A track's first sight settles it: where it is then is no event. One born inside
at the frame's edge, after the first updates, begins outside and so can enter.
A new state counts after some observations in a row. A track that was at the
edge and is not seen for some updates of its camera's clock has left: if it was
inside, that is an exit. After many more updates without it, it is forgotten.

What a track does after such an absence begins from outside, whatever went
before. So absences cut a track's observations into stretches, and inside a
stretch everything is runs and their ages. Only how long a run of inside was
already, where an absence fell into it before it counted, goes on from stretch
to stretch: that number is folded over a track's stretches, not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A track unseen for so many updates at the frame's edge has left; after so many more its state is dropped.
LEFT_AFTER, EVICT_AFTER = 6, 300
KEYS = ["camera_id", "zone_id", "track_id"]


def stretches(observations: DataFrame, clock: DataFrame) -> DataFrame:
    """Observations with born (first sight, or after it was forgotten), life, stretch (numbers of both) and leaves (absent long enough after it, at the edge).

    clock: camera_id and newest, the newest update of each camera.
    """
    w = W.partitionBy(*KEYS).orderBy("update_no")
    x = observations.where(F.col("track_id").isNotNull()).join(clock, "camera_id")
    unseen = F.coalesce(F.lead("update_no").over(w) - 1, F.col("newest")) - F.col("update_no")
    x = x.withColumn("leaves", F.col("at_edge") & (unseen >= LEFT_AFTER)).drop("newest")
    before = F.lag("update_no").over(w)
    x = x.withColumn("born", before.isNull() | (F.col("update_no") - before > EVICT_AFTER + 1))
    starts = F.col("born") | F.coalesce(F.lag("leaves").over(w), F.lit(False))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("stretch", F.sum(starts.cast("int")).over(so_far)).withColumn("life", F.sum(F.col("born").cast("int")).over(so_far))


def pending(rows: DataFrame) -> DataFrame:
    """KEYS, stretch and carried: how old the run of inside is already with which a stretch begins, where that is not 0.

    rows: as aged() has them before, with need, run, place, settled.
    """
    own = [*KEYS, "life", "stretch"]
    last = F.max_by(F.struct("run", "inside", F.col("place").alias("n")), "update_no")
    counted = (F.col("run") > 1) & (F.col("place") >= F.col("need"))
    s = rows.groupBy(*own).agg(
        F.min_by("inside", "update_no").alias("inside"), F.max(F.when(F.col("run") == 1, F.col("place"))).alias("first"), F.max("settled").alias("settled"), F.max(F.when(F.col("run") == 1, F.col("need"))).alias("need"),
        F.max_by("inside", F.when(counted, F.col("update_no"))).alias("later"), last.alias("last"),
    )
    steps = F.sort_array(F.collect_list(F.struct("stretch", "inside", "first", "settled", "need", "later", "last")))

    def step(acc: Column, x: Column) -> Column:
        age = F.when(x["inside"] & ~x["settled"], acc["age"]).otherwise(0) + x["first"]
        sure = x["inside"] & (x["settled"] | (age >= x["need"]))  # the first run counts
        ends_inside = F.coalesce(x["later"], sure)
        open_ = F.when(x["last"]["run"] == 1, age).otherwise(x["last"]["n"])
        return F.struct(
            F.when(x["last"]["inside"] & ~ends_inside, open_).otherwise(0).cast("int").alias("age"),
            F.when(acc["age"] > 0, F.array_append(acc["out"], F.struct(x["stretch"].cast("long").alias("stretch"), acc["age"].alias("carried")))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("age"), F.array().cast("array<struct<stretch:bigint,carried:int>>").alias("out"))
    lives = s.groupBy(*KEYS, "life").agg(steps.alias("steps"), F.count("*").alias("n")).where("n > 1")
    return lives.select(*KEYS, F.explode(F.aggregate("steps", start, step)["out"]).alias("p")).select(*KEYS, "p.*")


def boundary_events(observations: DataFrame, frames: Column | int, clock: DataFrame | None = None) -> DataFrame:
    """Entries and exits (camera_id, zone_id, track_id, update_no, kind) of observations camera_id, zone_id, update_no, track_id, inside, at_edge.

    Updates are numbered by their camera, also those without observations; a null track marks an empty one. clock
    (camera_id, newest) says how far cameras have come; by default as far as what was observed. frames may differ by row.
    """
    if clock is None:
        clock = observations.groupBy("camera_id").agg(F.max("update_no").alias("newest"))
    x = stretches(observations, clock).withColumn("need", (frames if isinstance(frames, Column) else F.lit(frames)).cast("int"))
    inner = W.partitionBy(*KEYS, "stretch").orderBy("update_no")
    changed = F.coalesce(F.lag("inside").over(inner) != F.col("inside"), F.lit(True))
    x = x.withColumn("run", F.sum(changed.cast("int")).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("place", F.row_number().over(W.partitionBy(*KEYS, "stretch", "run").orderBy("update_no")))
    walked_in = F.col("inside") & F.col("at_edge") & (F.col("update_no") > LEFT_AFTER)
    x = x.withColumn("settled", F.max(F.col("born") & ~walked_in).over(W.partitionBy(*KEYS, "stretch")))
    # the first sight itself is no event, not even where one observation is enough
    first_sights = F.max(F.col("born") & walked_in).over(W.partitionBy(*KEYS, "stretch")) & (F.col("run") == 1)
    x = x.withColumn("need", F.when(first_sights, F.greatest("need", F.lit(2))).otherwise(F.col("need")))
    x = x.join(pending(x), [*KEYS, "stretch"], "left")
    ahead = F.when(F.col("settled"), F.col("need") - 1).when(F.col("inside"), F.coalesce("carried", F.lit(0))).otherwise(0)
    sure = F.col("place") == F.greatest(F.col("need") - F.when(F.col("run") == 1, ahead).otherwise(0), F.lit(1))
    known = F.last(F.when(sure, F.col("inside")), ignorenulls=True)
    before = known.over(inner.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("sure", sure).withColumn("before", F.coalesce(before, F.when(~F.col("settled"), F.lit(False)))).withColumn("now", F.coalesce(known.over(inner.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
    kind = F.when(F.col("inside"), "entry").otherwise("exit")
    turned = F.col("sure") & (F.col("before") != F.col("inside"))
    found = F.array(
        F.when(turned, F.struct(F.col("update_no").alias("update_no"), kind.alias("kind"))),
        F.when(F.col("leaves") & F.col("now"), F.struct((F.col("update_no") + LEFT_AFTER).alias("update_no"), F.lit("exit").alias("kind"))),
    )
    return x.select(*KEYS, F.explode(F.array_compact(found)).alias("e")).select(*KEYS, "e.*")
