"""Similarity and clustering: suppression, matching, nearest identities, near duplicates, shots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.geometry import helmet_probability, iou
from vigil.operators.sequences import with_previous, with_running_sum


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


BOX = ["x1", "y1", "x2", "y2"]


def shared_part(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x1, y1, x2, y2; 0 where they don't meet."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero)
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    return F.when(w * h > 0, w * h / (area(a) + area(b) - w * h)).otherwise(zero)


def by_score(role: Column | None = None) -> Column:
    """The boxes of a group as an array, the best first, then by box_id."""
    box = F.struct((-F.col("score")).alias("s"), "box_id", F.col("class_id").cast("int").alias("class_id"), *[F.col(c).cast("double").alias(c) for c in BOX])
    return F.sort_array(F.collect_list(box if role is None else F.when(role, box)))


def suppress(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """box_id of the boxes that greedy suppression keeps: by score, what overlaps a kept box above the threshold goes.

    A key is one image (and class), so a group is what one frame holds; the fold is a SQL aggregate over its array.
    """
    if "class_id" not in boxes.columns:
        boxes = boxes.withColumn("class_id", F.lit(0))
    x = boxes.groupBy(*keys).agg(by_score().alias("b"))
    none = F.slice("b", 1, 0)
    kept = F.aggregate("b", none, lambda out, box: F.when(F.exists(out, lambda k: shared_part(k, box) > threshold), out).otherwise(F.concat(out, F.array(box))))
    return x.select(F.explode(kept).alias("k")).select("k.box_id")


def matches(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """box_id of predictions with the ground truth each one takes (null: none): by score, the best free one of its class.

    An image's boxes are one array; the fold over its predictions carries the truths that are taken.
    """
    x = boxes.groupBy("image_id").agg(by_score(F.col("role") == "pred").alias("p"), F.array_sort(F.collect_list(F.when(F.col("role") == "gt", F.struct("box_id", F.col("class_id").cast("int").alias("class_id"), *[F.col(c).cast("double").alias(c) for c in BOX])))).alias("g"))

    def step(done: Column, p: Column) -> Column:
        free = F.filter("g", lambda t: (t["class_id"] == p["class_id"]) & ~F.exists(done, lambda m: m["truth_id"].eqNullSafe(t["box_id"])))
        likeness = F.transform(free, lambda t: F.struct(shared_part(p, t).alias("o"), (-t["box_id"]).alias("t")))
        best = F.array_max(F.filter(likeness, lambda c: (c["o"] >= threshold) & (c["o"] > 0)))
        return F.concat(done, F.array(F.struct(p["box_id"].alias("box_id"), p["class_id"].alias("class_id"), (-best["t"]).alias("truth_id"))))

    none = F.array().cast("array<struct<box_id:bigint,class_id:int,truth_id:bigint>>")
    return x.select(F.explode(F.aggregate("p", none, step)).alias("m")).select("m.box_id", "m.class_id", "m.truth_id")


def precision_recall(boxes: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """class_id (and the columns by, which an image shares), tp, fp, fn, precision, recall; guarded divisions give 0."""
    keys = ["class_id", *(by or [])]
    found = matches(boxes, threshold)
    if by:
        found = found.join(boxes.select("box_id", *by), "box_id")
    m = found.groupBy(*keys).agg(F.count("truth_id").alias("tp"), F.count_if(F.col("truth_id").isNull()).alias("fp"))
    t = boxes.where("role = 'gt'").groupBy(*keys).agg(F.count("*").alias("truths"))
    x = t.join(m, keys, "full").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return x.select(*keys, "tp", "fp", (F.col("truths") - tp).alias("fn"), ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, F.col("truths")).alias("recall"))


def iou_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """Ground truth and predictions of one image and class that overlap at least so much."""
    g, p = boxes.where("role = 'gt'").alias("g"), boxes.where("role = 'pred'").alias("p")
    x = g.join(p, (F.col("g.image_id") == F.col("p.image_id")) & (F.col("g.class_id") == F.col("p.class_id")))
    return x.select(F.col("g.box_id").alias("gt_id"), F.col("p.box_id").alias("pred_id"), iou("g", "p").alias("iou")).where(F.col("iou") >= least)


#: Poses of a block; up to so many go to every task at once. Probes of a group, and of a product.
MAX_POSES, GROUP, PRODUCT = 16_384, 65_536, 1024


def nearest_identity(probes: DataFrame, gallery: DataFrame, threshold: float) -> DataFrame:
    """Each probe's most similar enrolled pose; known where that reaches the threshold; ties to the first person and pose.

    A small gallery goes to the probes as a matrix of checked size. A larger one lies in blocks by hash; groups of
    probes meet each block, and no part of it passes through the driver.
    """
    poses = gallery.where(F.exists("embedding", lambda v: v != 0)).select(F.col("person_id").cast("long").alias("person_id"), F.col("pose_idx").cast("long").alias("pose_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    some = probes.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    held = poses.limit(MAX_POSES + 1).toArrow()
    best = of_matrix(some, held) if held.num_rows <= MAX_POSES else of_blocks(some, poses)
    y = best.groupBy("vec_id").agg(F.max_by(F.struct("person_id", "similarity"), F.struct("similarity", -F.col("person_id"), -F.col("pose_idx"))).alias("b")).select("vec_id", "b.person_id", "b.similarity")
    known = F.col("similarity") >= threshold
    return y.select("vec_id", F.when(known, F.col("person_id")).alias("person_id"), F.round("similarity", 6).alias("similarity"), F.when(known, "known").otherwise("unknown_face").alias("status"))


BEST = "vec_id long, person_id long, pose_idx long, similarity double"


def vectors(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


class Gallery:
    """Poses in order, as unit vectors."""

    def __init__(self, poses: pa.Table):
        order = poses.sort_by([("person_id", "ascending"), ("pose_idx", "ascending")]) if poses.num_rows else poses
        self.person, self.pose = (order.column(c).to_numpy() for c in ("person_id", "pose_idx"))
        unit = vectors(order.column("v"), order.num_rows) if order.num_rows else np.zeros((0, 0))
        self.unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True)) if len(unit) else unit

    def nearest(self, ids: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The best pose of each probe that isn't zero, the first of equal ones."""
        for k in range(0, len(ids) if len(self.unit) else 0, PRODUCT):
            part, own = v[k : k + PRODUCT], ids[k : k + PRODUCT]
            size = np.sqrt((part * part).sum(axis=1))
            some = np.flatnonzero(size > 0)
            likeness = part[some] / size[some, None] @ self.unit.T
            at = likeness.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(self.person[at]), pa.array(self.pose[at]), pa.array(likeness[np.arange(len(some)), at])], names=["vec_id", "person_id", "pose_idx", "similarity"])


def of_matrix(probes: DataFrame, poses: pa.Table) -> DataFrame:
    gallery = Gallery(poses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from gallery.nearest(batch.column(0).to_numpy(), vectors(batch.column(1), batch.num_rows))

    return probes.mapInArrow(run, BEST)


def of_blocks(probes: DataFrame, poses: DataFrame) -> DataFrame:
    """The best pose of each block for each probe."""
    blocks, groups = -(-poses.count() // (MAX_POSES // 2)), max(1, -(-probes.count() // GROUP))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = probes.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("_group"), every(blocks).alias("_block"))
    g = poses.select("person_id", "pose_idx", "v", F.pmod(F.xxhash64("person_id", "pose_idx"), F.lit(blocks)).cast("int").alias("_of"), every(groups).alias("_for"))
    schema = pa.schema([("vec_id", pa.int64()), ("person_id", pa.int64()), ("pose_idx", pa.int64()), ("similarity", pa.float64())])

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        found = list(Gallery(block).nearest(some.column("vec_id").to_numpy(), vectors(some.column("v"), some.num_rows))) if some.num_rows and block.num_rows else []
        return pa.Table.from_batches([f.cast(schema) for f in found], schema)

    return p.groupBy("_block", "_group").cogroup(g.groupBy("_of", "_for")).applyInArrow(run, BEST)


def shots(frames: DataFrame, order: str, vector: str, least: float) -> DataFrame:
    """frames with shot: a new one where a frame's likeness to the one before falls below least."""
    x = with_previous(frames, order, vector, "_before")
    change = F.when(cosine(F.col(vector), F.col("_before")) < least, 1).otherwise(0)
    return with_running_sum(x, order, change, "shot").drop("_before")


#: Bits of a chunk of a hash.
CHUNK = 16


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of 64-bit hashes (id, h) at most so many bits apart.

    In one of the four chunks of 16 bits such a pair differs by a quarter of that at most. So one side lists, for each
    chunk, all values that near, the other its own, and pairs meet on equal ones: chunks are wide, so few meet by
    chance. A pair counts in the first chunk in which it is that near; then all bits decide.
    """
    parts, off = 64 // CHUNK, most // (64 // CHUNK)
    if off > 4:
        raise ValueError("at most 19 bits")
    masks = [sum(1 << i for i in c) for n in range(off + 1) for c in combinations(range(CHUNK), n)]
    chunk = lambda h, i: F.shiftrightunsigned(h, i * CHUNK).bitwiseAND((1 << CHUNK) - 1).cast("int")
    own = hashes.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), chunk(F.col("h"), i).alias("v")) for i in range(parts)])).alias("c")).select("b", "hb", "c.*")
    all_near = hashes.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.posexplode(F.array(*[chunk(F.col("h"), i) for i in range(parts)])).alias("i", "own"))
    all_near = all_near.select("a", "ha", "i", F.explode(F.transform(F.lit(masks), lambda m: F.col("own").bitwiseXOR(m))).alias("v"))
    apart = F.col("ha").bitwiseXOR(F.col("hb"))
    first = F.lit(True)
    for k in range(parts - 1):
        first = first & ((F.col("i") <= k) | (F.bit_count(chunk(apart, k)) > off))
    return all_near.join(own, ["i", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= most) & first).select("a", "b")


def neighbours(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, det_id and how many points of its key lie within the radius, itself too; cells of that size meet on equal keys."""
    cell = lambda c: F.floor(F.col(c) / radius)
    x = points.select(*keys, "det_id", "fx", "fy", cell("fx").alias("cx"), cell("fy").alias("cy"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    y = x.select(*keys, F.col("fx").alias("qx"), F.col("fy").alias("qy"), F.explode(around).alias("c")).select(*keys, "qx", "qy", "c.cx", "c.cy")
    near = (F.col("fx") - F.col("qx")) ** 2 + (F.col("fy") - F.col("qy")) ** 2 <= radius * radius
    return x.join(y, [*keys, "cx", "cy"]).where(near).groupBy(*keys, "det_id").agg(F.count("*").alias("n"))


def helmets(persons: DataFrame, heads: DataFrame, most: float, threshold: float) -> DataFrame:
    """box_id, head_id and p of each person with a head in the upper half of its box.

    Heads of which another class has a better box at the same place go first; of the rest the one nearest the middle
    stands for the person, and its class and score give the probability of a helmet.
    """
    h, o = heads.alias("h"), heads.alias("o")
    other = (F.col("h.image_id") == F.col("o.image_id")) & (F.col("h.class_id") != F.col("o.class_id")) & (F.col("o.score") > F.col("h.score"))
    kept = h.join(o, other & (iou("h", "o") > most), "left_anti").alias("h")
    p = persons.alias("p")
    mid = lambda t, a, z: (F.col(f"{t}.{a}") + F.col(f"{t}.{z}")) / 2
    inside = (F.col("p.image_id") == F.col("h.image_id")) & mid("h", "x1", "x2").between(F.col("p.x1"), F.col("p.x2")) & mid("h", "y1", "y2").between(F.col("p.y1"), mid("p", "y1", "y2"))
    rank = F.struct(F.abs(mid("h", "x1", "x2") - mid("p", "x1", "x2")), -F.col("h.score"), F.col("h.box_id"))
    best = p.join(kept, inside).groupBy("p.box_id").agg(F.min_by(F.struct("h.box_id", "h.class_id", "h.score"), rank).alias("b"))
    return best.select("box_id", F.col("b.box_id").alias("head_id"), F.round(helmet_probability(F.col("b.class_id"), F.col("b.score"), threshold), 6).alias("p"))
