"""Dataset analytics: provenance, confounds, sampling, track statistics, export."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.operators.dimensions import split_of, stem
from vigil.operators.sequences import with_running_sum


def guarded(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def manifest(rows: DataFrame, klass: str, domain: str, image: str) -> DataFrame:
    """Distinct images and instances by class and domain."""
    return rows.groupBy(klass, domain).agg(F.count_distinct(image).alias("images"), F.count("*").alias("instances"))


def attribution(rows: DataFrame, group: str, flag: Column, least: int, top: int = 15) -> DataFrame:
    """Groups of at least so many rows with a flagged one, the most flagged first."""
    x = rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    x = x.where((F.col("total") >= least) & (F.col("flagged") > 0)).withColumn("rate", F.round(F.col("flagged") / F.col("total"), 6))
    return x.orderBy(F.desc("flagged"), group).limit(top)


def effect_size(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Means and population deviations of two labels (0, 1), Cohen's d, and whether d alone would tell them apart."""
    part = lambda f, k: f(F.when(F.col(label) == k, F.col(value).cast("double")))
    x = rows.agg(part(F.avg, 0).alias("m0"), part(F.avg, 1).alias("m1"), part(F.stddev_pop, 0).alias("s0"), part(F.stddev_pop, 1).alias("s1"))
    pooled = F.sqrt((F.col("s0") ** 2 + F.col("s1") ** 2) / 2)
    d = guarded(F.abs(F.col("m0") - F.col("m1")), pooled)
    return x.select(*[F.round(c, 6).alias(c) for c in ("m0", "m1", "s0", "s1")], F.round(d, 6).alias("d"), (d > 1.2).alias("separable"))


def shares(rows: DataFrame, group: str, flag: Column) -> DataFrame:
    """Each group's share of flagged and of other rows, and the gap in percentage points."""
    w = W.partitionBy()
    x = rows.groupBy(group).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    x = x.withColumn("sa", guarded(100.0 * F.col("a"), F.sum("a").over(w))).withColumn("sb", guarded(100.0 * F.col("b"), F.sum("b").over(w)))
    return x.select(group, F.round("sa", 6).alias("share_flagged"), F.round("sb", 6).alias("share_other"), F.round(F.col("sa") - F.col("sb"), 6).alias("gap"))


def capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows a key, in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def file_places(names: DataFrame, name: str, number: Column) -> DataFrame:
    """name and its place, from 1, by the number in it (null last), then by name: places of numbers are sums over all smaller ones."""
    x = names.select(name, F.coalesce(number.cast("double"), F.lit(1e300)).alias("_key"))
    sizes = with_running_sum(x.groupBy("_key").agg(F.count("*").alias("_n")), "_key", F.col("_n"), "_up_to")
    own = F.row_number().over(W.partitionBy("_key").orderBy(name))
    y = x.withColumn("_own", own).join(sizes, "_key")
    return y.select(name, (F.col("_up_to") - F.col("_n") + F.col("_own")).cast("int").alias("place"))


def burst_filtered(rows: DataFrame, key: str, feature: str, references: DataFrame, least: float, keep: int, seed: str = "burst") -> DataFrame:
    """key of the rows that stay: those whose feature (an array) correlates with no reference above the bar, and a seeded choice of so many others.

    references: key and feature of a few named rows; without any, all stay.
    """
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    r = references.select(F.col(feature).cast("array<double>").alias("_r"))
    x = rows.select(key, F.col(feature).cast("array<double>").alias("_f")).join(r, F.lit(True), "left")  # a few references
    n, sx, sy = F.size("_f"), total(F.col("_f")), total(F.col("_r"))
    corr = (n * dot(F.col("_f"), F.col("_r")) - sx * sy) / F.sqrt((n * dot(F.col("_f"), F.col("_f")) - sx * sx) * (n * dot(F.col("_r"), F.col("_r")) - sy * sy))
    likeness = x.groupBy(key).agg(F.max(corr).alias("_corr"))
    flagged = F.coalesce(F.col("_corr") > least, F.lit(False))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    chosen = likeness.where(flagged).orderBy(draw, key).limit(keep).select(key)
    return likeness.where(~flagged).select(key).unionByName(chosen)


def track_stability(detections: DataFrame, fps: int) -> DataFrame:
    """Tracks of each camera: number, lengths, share of fragments, peak at a time, churn, and whether that is stable."""
    lengths = detections.groupBy("camera_id", "track_id").agg(F.count("*").alias("n"))
    short = max(2, round(fps))
    a = lengths.groupBy("camera_id").agg(F.count("*").alias("tracks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg(F.when(F.col("n") < short, 1.0).otherwise(0.0)).alias("fragments"))
    at_once = detections.groupBy("camera_id", "tick").agg(F.count_distinct("track_id").alias("k")).groupBy("camera_id").agg(F.max("k").alias("peak"))
    x = a.join(at_once, "camera_id").withColumn("churn", F.col("tracks") / F.col("peak"))
    return x.select("camera_id", "tracks", "shortest", "longest", "peak", F.round("fragments", 6).alias("fragments"), F.round("churn", 6).alias("churn"), ((F.col("churn") <= 3) & (F.col("fragments") <= 0.35)).alias("stable"))


def percentile_nearest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n and p95: the value at place int(0.95 n) from 0, not interpolated."""
    w = W.partitionBy(*keys)
    x = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100).cast("long"))
    return x.where(F.col("_i") == at).select(*keys, "n", F.col(value).alias("p95"))


def coco_annotations(boxes: DataFrame) -> DataFrame:
    """Numbered annotations with x, y, width, height and area, in the order of images and boxes."""
    image = W.partitionBy("image_id").orderBy("box_id")
    counts = with_running_sum(boxes.groupBy("image_id").agg(F.count("*").alias("_k")), "image_id", F.col("_k"), "_end")
    start = counts.select("image_id", (F.col("_end") - F.col("_k")).alias("_start"))
    x = boxes.withColumn("_n", F.row_number().over(image)).join(start, "image_id")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return x.select((F.col("_start") + F.col("_n")).alias("annotation_id"), "image_id", "box_id", "class_id", F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


def warped_box(strength: float, width: float, height: float) -> list[Column]:
    """Bounds of a box (x1, y1, x2, y2) after the frame's top is drawn together by this strength."""
    dx = width * strength
    s = (width - 2 * dx) / width

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        d = 1 + (s - 1) * y / height
        return (s * x + dx * (1 - y / height)) / d, s * y / d

    corners = [point(F.col(a), F.col(b)) for a in ("x1", "x2") for b in ("y1", "y2")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.round(F.least(*xs), 6), F.round(F.least(*ys), 6), F.round(F.greatest(*xs), 6), F.round(F.greatest(*ys), 6)]


def family_keys(name: Column) -> list[Column]:
    """What a file name says of its source, from fine to coarse: without extension and hash; without its number at the end; its first letters with the number after them; its first letters.

    The last two are the whole stem where it begins otherwise.
    """
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"(?<=.)\.[^.]+$", "")
    plain = F.regexp_replace(F.regexp_replace(stem, "(?i)_jpg$", ""), r"(?i)\.rf\.[0-9a-f]{16,}$", "")
    begins = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")), plain)
    return [plain, F.regexp_replace(plain, r"[-_][0-9]+$", ""), begins(r"^([A-Za-z]+[0-9]+)"), begins(r"^([A-Za-z]+)")]


def labelled(images: DataFrame, labels: DataFrame, path: str, label_path: str) -> DataFrame:
    """Images with the label of the same split and stem; what has no partner is left out."""
    i = images.withColumns({"_split": split_of(F.col(path)), "_stem": stem(F.col(path))})
    x = labels.withColumns({"_split": split_of(F.col(label_path)), "_stem": stem(F.col(label_path))})
    return i.join(x, ["_split", "_stem"]).drop("_split", "_stem")


def track_report(detections: DataFrame) -> DataFrame:
    """Tracks of each camera, their median length and how many there are at a time on average."""
    a = detections.groupBy("camera_id", "track_id").agg(F.count("*").alias("n")).groupBy("camera_id").agg(F.count("*").alias("tracks"), F.median("n").alias("median_len"))
    b = detections.groupBy("camera_id", "tick").agg(F.count_distinct("track_id").alias("k")).groupBy("camera_id").agg(F.round(F.avg("k"), 6).alias("mean_at_once"))
    return a.join(b, "camera_id")


def bench_report(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """keys, the median time and how many a second."""
    return rows.groupBy(*keys).agg(F.median(seconds).alias("median"), F.round(guarded(F.count("*"), F.sum(seconds)), 6).alias("fps"))


def manifest_of(rows: DataFrame, classes: DataFrame, klass: str, domain: str, image: str) -> DataFrame:
    """manifest() over every named class and domain, 0 where there is nothing."""
    every = classes.select(klass).join(rows.select(domain).distinct(), F.lit(True))  # names and domains are a few each
    c, m = every.alias("c"), manifest(rows, klass, domain, image).alias("m")
    same = F.col(f"c.{klass}").eqNullSafe(F.col(f"m.{klass}")) & F.col(f"c.{domain}").eqNullSafe(F.col(f"m.{domain}"))
    return c.join(m, same, "left").select(f"c.{klass}", f"c.{domain}", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("instances", F.lit(0)).alias("instances"))


def top_share(rows: DataFrame, group: str, top: int) -> DataFrame:
    """The share of all rows that the largest groups have."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    largest = n.orderBy(F.desc("n"), group).limit(top).agg(F.sum("n").alias("a"))
    return largest.join(n.agg(F.sum("n").alias("b")), F.lit(True)).select(guarded(F.col("a"), F.col("b")).alias("top_share"))


def modes(rows: DataFrame, value: str, top: int) -> DataFrame:
    """The most frequent values and how often they occur, the smaller of equally frequent ones first."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(top)


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, deviation of the population and number of distinct values."""
    return rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.count_distinct(value).alias("distinct"))


def band(rate: Column, raised: float, high: float) -> Column:
    return F.when(rate >= high, "high").when(rate >= raised, "raised").otherwise("low")


def flag_report(rows: DataFrame, keys: list[str], value: str, flagged: Column, raised: float, high: float) -> DataFrame:
    """keys, mean and median of a value, the share of flagged rows, and its band."""
    x = rows.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.median(value).alias("median"), guarded(F.count_if(flagged), F.count("*")).alias("rate"))
    return x.select(*keys, "mean", "median", F.round("rate", 6).alias("flag_rate"), band(F.col("rate"), raised, high).alias("band"))


def blanks(rows: DataFrame, image: str, blank: Column, unreadable: Column) -> DataFrame:
    """Distinct images that are blank, that can't be read, and all."""
    some = lambda c: F.count_distinct(F.when(c, F.col(image)))
    return rows.agg(some(blank).alias("blank"), some(unreadable).alias("unreadable"), F.count_distinct(image).alias("images"))


def union_of(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of some splits, with the split's name; columns that one lacks are null there."""
    out = None
    for name, rows in parts.items():
        x = rows.withColumn("split", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def drop_report(rows: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Published, consumed (one a slot, the latest) and dropped rows of each key, and the share that was dropped."""
    x = rows.groupBy(*keys).agg(F.count("*").alias("published"), F.count_distinct(slot).alias("consumed"))
    x = x.withColumn("dropped", F.col("published") - F.col("consumed"))
    return x.withColumn("drop_rate", F.round(guarded(F.col("dropped"), F.col("published")), 6))


def component_report(members: DataFrame, all_: int, top: int = 5) -> DataFrame:
    """Of components (id, component) among so many ids: how many, the share of ids that are repetitions, and the largest sizes."""
    n = members.groupBy("component").agg(F.count("*").alias("n"))
    largest = n.orderBy(F.desc("n"), "component").limit(top).agg(F.sort_array(F.collect_list("n"), asc=False).alias("largest"))
    total = n.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return total.join(largest, F.lit(True)).select("clusters", F.round(guarded(F.col("extra"), F.lit(all_)), 6).alias("duplicate_ratio"), "largest")


def above(values: Column, bar: Column) -> Column:
    """Up to 64 values as bits of a long, the first one highest: which lie above a bar."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > bar, 1).otherwise(0).cast("long")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def mean_bits(values: Column) -> Column:
    return bound(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values), lambda bar: above(values, bar))


def median_bits(values: Column) -> Column:
    n = F.size(values)
    middle = lambda x: (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2
    return bound(bound(F.sort_array(values), middle), lambda bar: above(values, bar))


def anchor_grid(spark: SparkSession, side: int, strides: tuple[int, ...]) -> DataFrame:
    """stride, x, y: the cells of a detector's grids over a square image."""
    s = spark.range(1).select(F.explode(F.array(*map(F.lit, strides))).alias("stride"))
    cells = F.sequence(F.lit(0), F.floor(F.lit(side) / F.col("stride")).cast("int") - 1)
    return s.select("stride", F.explode(cells).alias("x")).select("stride", "x", F.explode(cells).alias("y"))


def dct_matrix(n: int, keep: int) -> list[list[float]]:
    """The first rows of the orthonormal cosine transform of n values."""
    return [[math.cos((2 * x + 1) * u * math.pi / (2 * n)) * math.sqrt((1 if u == 0 else 2) / n) for x in range(n)] for u in range(keep)]


def dct_low(image: Column, n: int, keep: int) -> Column:
    """The keep x keep lowest frequencies of an image of n x n values (an array, row by row), as the product of the transform, the image and the transform again."""
    rows = F.array(*[F.array(*[F.lit(v) for v in r]) for r in dct_matrix(n, keep)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    lines = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.transform(rows, lambda c: dot(F.slice(image, x * n + 1, n), c)))
    columns = lambda y: F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda v: F.transform(y, lambda line: F.get(line, v)))
    return bound(lines, lambda y: bound(columns(y), lambda cs: F.flatten(F.transform(rows, lambda c: F.transform(cs, lambda column: dot(column, c))))))


def dct_bits(image: Column, n: int, keep: int) -> Column:
    """Which low frequencies lie above their median, as bits of a long, the first one highest."""
    return bound(dct_low(image, n, keep), median_bits)


def largest_angle_group(rows: DataFrame, key: str, angle: str, within: float, turn: float) -> DataFrame:
    """key and largest: most rows whose angles lie so near one row's, around a turn, by a range window over angles that go on past both ends."""
    x = rows.select(key, F.pmod(F.col(angle).cast("double"), F.lit(float(turn))).alias("_a"))
    x = x.select(key, F.explode(F.array(*[F.struct((F.col("_a") + k * turn).alias("_a"), F.lit(k == 0).alias("_own")) for k in (-1, 0, 1)])).alias("e")).select(key, "e.*")
    near = F.expr(f"count(*) OVER (PARTITION BY `{key}` ORDER BY _a RANGE BETWEEN {float(within)}D PRECEDING AND {float(within)}D FOLLOWING)")
    return x.withColumn("_n", near).where("_own").groupBy(key).agg(F.max("_n").alias("largest"))
