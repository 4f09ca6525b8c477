"""Zones: membership, masks, sensitivity and the events of boundaries and crowds.

Zones are a small dimension of operator-drawn shapes, each of one camera, so
detections meet the zones of their camera by an equi-join on it; Spark
broadcasts the dimension when its size allows. Shapes here are rectangles
(x0, y0, x1, y1) or have ``sides`` (see functions.geometry.edges). Where zones
carry them, ``classes`` limits what a zone applies to (a mask without any masks
nothing), ``days``, ``from_s`` and ``to_s`` when, ``events`` and, for tripwires,
``direction`` which changes it reports, ``crowd_threshold`` and
``crowd_min_frames`` its crowds, and ``zone_order`` is the order of the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import geometry
from vigil.functions.schedule import is_active
from vigil.operators.sequences import confirmed_changes


def inside(x: Column, y: Column, zone: str = "z") -> Column:
    """Rectangle membership, edges included."""
    c = lambda n: F.col(f"{zone}.{n}")
    return (x >= c("x0")) & (x <= c("x1")) & (y >= c("y0")) & (y <= c("y1"))


def applies(zones: DataFrame, d: str = "d", z: str = "z") -> Column:
    """Same camera, and where zones say so a class and an hour that the zone applies to; a null list means all."""
    out = F.col(f"{d}.camera_id") == F.col(f"{z}.camera_id")
    if "classes" in zones.columns:
        out = out & (F.col(f"{z}.classes").isNull() | F.array_contains(f"{z}.classes", F.col(f"{d}.klass")))
    if "days" in zones.columns:
        out = out & (F.col(f"{z}.days").isNull() | is_active(F.col(f"{d}.ts"), F.col(f"{z}.days"), F.col(f"{z}.from_s"), F.col(f"{z}.to_s")))
    return out


def membership(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Each detection with each zone of its camera that applies to it, and whether its foot is inside."""
    d, z = detections.alias("d"), zones.alias("z")
    return d.join(z, applies(zones)).select("d.*", "z.zone_id", "z.severity", "z.min_frames", inside(F.col("d.fx"), F.col("d.fy")).alias("inside"))


def membership_polygon(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """The detections inside each zone of any shape (zone_id, camera_id, sides, and the box x0 to y1 around it, which is tested first)."""
    d, z = detections.alias("d"), zones.alias("z")
    x, y = F.col("d.fx"), F.col("d.fy")
    return d.join(z, applies(zones) & inside(x, y)).where(geometry.covers(F.col("z.sides"), x, y)).select("d.*", "z.zone_id")


def unmasked(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Detections that no exclusion zone which names their class covers; zones without a column of classes name all."""
    masks = zones.where("ztype = 'exclusion'")
    if "classes" in zones.columns:
        masks = masks.where(F.size("classes") > 0)
    d, z = detections.alias("d"), masks.alias("z")
    return d.join(z, applies(zones) & inside(F.col("d.fx"), F.col("d.fy")), "left_anti")


def reported(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Events (camera_id, zone_id, kind: entry or exit) that their zone's direction and list of events let through, with its severity.

    Only tripwires have a direction: a_to_b lets entries pass, b_to_a exits, both (or null) either.
    """
    e, z = events.drop("severity").alias("e"), zones.alias("z")
    x = e.join(z, (F.col("e.camera_id") == F.col("z.camera_id")) & (F.col("e.zone_id") == F.col("z.zone_id")))
    way = F.coalesce("z.direction", F.lit("both"))
    allowed = (F.col("z.ztype") != "tripwire") | (way == "both") | ((way == "a_to_b") & (F.col("e.kind") == "entry")) | ((way == "b_to_a") & (F.col("e.kind") == "exit"))
    return x.where(allowed & (F.col("z.events").isNull() | F.array_contains("z.events", F.col("e.kind")))).select("e.*", "z.severity")


def occupancy(states: DataFrame, zones: DataFrame, latest: DataFrame, within: int = 3) -> DataFrame:
    """camera_id, zone_id and n: tracks whose last confirmed state is inside and that were unseen for a few updates at most; 0 for empty zones.

    states: camera_id, zone_id, track_id, inside, last_seen; latest: camera_id and update_no, the newest update of a camera.
    """
    fresh = states.where("inside").join(latest, "camera_id").where(F.col("update_no") - F.col("last_seen") <= within)
    return zones.select("camera_id", "zone_id").join(fresh.select("camera_id", "zone_id", "track_id"), ["camera_id", "zone_id"], "left").groupBy("camera_id", "zone_id").agg(F.count("track_id").alias("n"))


def boundary_events(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Confirmed entries and exits of tracks: a new state counts after the zone's min_frames observations."""
    x = membership(detections, zones.where("ztype = 'polygon'")).withColumn("state", F.when(F.col("inside"), "entry").otherwise("exit"))
    events = confirmed_changes(x, ["camera_id", "zone_id", "track_id"], ["obs_no"], "state", F.coalesce("min_frames", F.lit(4)))
    return events.select("det_id", "camera_id", "zone_id", "track_id", "ts", F.col("state").alias("kind"), "severity", (F.col("fx") / 1000).alias("nx"), (F.col("fy") / 1000).alias("ny"))


def tripwire_events(detections: DataFrame, wire: tuple[float, float, float, float], frames: int) -> DataFrame:
    """Crossings of a line: into side b is an entry, into a an exit; on the line the last side holds."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("camera_id", "track_id").orderBy("obs_no").rowsBetween(W.unboundedPreceding, 0)
    side = geometry.side_of_line(*wire, F.col("fx"), F.col("fy"))
    x = detections.withColumn("side", F.coalesce(F.last(F.when(side != "on", side), ignorenulls=True).over(w), F.lit("a")))
    e = confirmed_changes(x, ["camera_id", "track_id"], ["obs_no"], "side", F.lit(frames))
    return e.select("det_id", "camera_id", "track_id", F.when(F.col("side") == "b", "entry").otherwise("exit").alias("kind"))


def tripwire_zone_events(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Crossings of each camera's tripwires (points of any number): the side of the nearest segment counts, on the line the last side holds."""
    from pyspark.sql.window import Window as W

    d, z = detections.alias("d"), zones.where("ztype = 'tripwire'").alias("z")
    keys = ["camera_id", "zone_id", "track_id"]
    side = geometry.side_of_polyline(F.col("z.points"), F.col("d.fx").cast("double"), F.col("d.fy").cast("double"))
    x = d.join(z, applies(zones)).select("d.det_id", "d.camera_id", "d.track_id", "d.obs_no", "d.ts", "z.zone_id", "z.severity", "z.min_frames", side.alias("side"))
    w = W.partitionBy(*keys).orderBy("obs_no").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("side", F.coalesce(F.last(F.when(F.col("side") != "on", F.col("side")), ignorenulls=True).over(w), F.lit("a")))
    e = confirmed_changes(x, keys, ["obs_no"], "side", F.coalesce("min_frames", F.lit(4)))
    return e.select("det_id", *keys, F.when(F.col("side") == "b", "entry").otherwise("exit").alias("kind"), "severity")


def fire_decisions(detections: DataFrame, zones: DataFrame, base: float, band: float = 0.1) -> DataFrame:
    """Unmasked fire and smoke with roi (the first zone in the order of the store), bar and verdict: accepted, near_miss or below.

    The bar is base plus the lowest delta of the regions of interest around a point, never above 0 nor below -0.5; a
    near miss is at most band under it.
    """
    d = unmasked(detections.where(F.col("klass").isin("fire", "smoke")), zones).alias("d")
    z = zones.where("ztype = 'fire_roi'").alias("z")
    order = F.col("z.zone_order") if "zone_order" in zones.columns else F.col("z.zone_id")
    roi = d.join(z, applies(zones) & inside(F.col("d.fx"), F.col("d.fy")), "left").groupBy("d.det_id", "d.camera_id", "d.tick", "d.klass", "d.score")
    x = roi.agg(F.min_by("z.zone_id", F.struct(order)).alias("roi"), F.min("z.conf_delta").alias("delta"))
    x = x.withColumn("bar", base + F.coalesce(F.greatest(F.least("delta", F.lit(0.0)), F.lit(-0.5)), F.lit(0.0))).drop("delta")
    verdict = F.when(F.col("score") >= F.col("bar"), "accepted").when(F.col("score") >= F.col("bar") - band, "near_miss").otherwise("below")
    return x.withColumn("verdict", verdict)


def fire_accepted(detections: DataFrame, zones: DataFrame, base: float) -> DataFrame:
    """Fire and smoke that pass their bar."""
    return fire_decisions(detections, zones, base).where("verdict = 'accepted'")


def strongest(detections: DataFrame) -> DataFrame:
    """The strongest detection of each camera, tick and class; the first of equal ones."""
    best = F.max_by(F.struct("det_id", "score"), F.struct("score", -F.col("det_id"))).alias("b")
    return detections.groupBy("camera_id", "tick", "klass").agg(best).select("camera_id", "tick", "klass", "b.det_id", "b.score")


def largest_cluster(points: DataFrame, keys: list[str], eps: float | Column, min_samples: int = 2) -> DataFrame:
    """keys and the size of their largest density cluster; eps may differ by row (of one key: the first one's).

    A key's points are those of one frame. Frames lie together in sorted partitions, and a task walks many a batch.
    """
    kinds = dict(points.dtypes)
    eps = eps if isinstance(eps, Column) else F.lit(float(eps))
    x = points.select(*keys, F.col("fx").cast("double").alias("fx"), F.col("fy").cast("double").alias("fy"), eps.cast("double").alias("eps"))

    def frames(part: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        n = len(keys)
        xy = np.stack((part.column(n).to_numpy(), part.column(n + 1).to_numpy()), axis=1)
        reach = part.column(n + 2).to_numpy()
        largest = [max(cluster_sizes(xy[a:b], reach[a], min_samples), default=0) for a, b in zip(starts, [*starts[1:], len(xy)], strict=True)]
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(n)), pa.array(largest, pa.int64())], names=[*keys, "largest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last frame, which may go on
        for batch in batches:
            y = pa.concat_batches([held, batch]) if held is not None else batch
            if not y.num_rows:
                continue
            change = np.zeros(y.num_rows, bool)
            change[0] = True
            for i in range(len(keys)):
                c = y.column(i).to_pandas().to_numpy()
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change).tolist()
            held = y.slice(starts[-1])
            if len(starts) > 1:
                yield frames(y.slice(0, starts[-1]), starts[:-1])
        if held is not None and held.num_rows:
            yield frames(held, [0])

    return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", largest long")


#: Distances at once.
DISTANCES = 1 << 20


def near(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Which points of a lie within a distance, given as its square, of which of b."""
    x, y = (a[:, None, i] - b[None, :, i] for i in (0, 1))
    return x**2 + y**2 <= square


def cluster_sizes(xy: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """Sizes of the density clusters of one frame: cores within eps of each other are one, border points join one of them.

    In order of their first cores; a border point joins the first it can. No list or matrix of all neighbours exists
    where that would be large.
    """
    xy = np.asarray(xy, np.float64).reshape(-1, 2)
    xy, eps = xy[np.isfinite(xy).all(axis=1)], abs(float(eps))
    if not len(xy) or not np.isfinite(eps):
        return []
    return (matrix_sizes if len(xy) ** 2 <= DISTANCES else cell_sizes)(xy, eps, min_samples)


def matrix_sizes(xy: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """cluster_sizes of few points."""
    by = near(xy, xy, eps * eps)
    core, free, sizes = by.sum(axis=1) >= min_samples, np.ones(len(xy), bool), []
    for start in np.flatnonzero(core).tolist():
        if free[start]:
            free[start], todo, size = False, [start], 1
            while len(todo):
                new = np.flatnonzero(by[todo].any(axis=0) & free)
                free[new], size = False, size + len(new)
                todo = new[core[new]]
            sizes.append(size)
    return sizes


def cell_sizes(xy: np.ndarray, eps: float, min_samples: int) -> list[int]:
    """cluster_sizes of many points.

    Cells are so small that the points of one lie within eps of each other. So a cell of min_samples is all cores and
    one cluster, others count what lies around them, and two cells are joined by one near pair of cores.
    """
    square = eps * eps
    cell = np.floor(xy / (eps / 1.5)) if eps > 0 else xy
    places, of = np.unique(cell, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    number = {tuple(c): k for k, c in enumerate(places.tolist())}
    off = sorted(((i, j) for i in range(-2, 3) for j in range(-2, 3) if i or j), key=lambda o: abs(o[0]) + abs(o[1])) if eps > 0 else []
    around = [[n for i, j in off if (n := number.get((x + i, y + j))) is not None] for x, y in places.tolist()]

    def pieces(parts: list[np.ndarray], rows: int) -> Iterator[np.ndarray]:
        whole, step = np.concatenate(parts) if parts else np.zeros(0, np.int64), max(1, DISTANCES // max(rows, 1))
        return (whole[k : k + step] for k in range(0, len(whole), step))

    core = np.zeros(len(xy), bool)
    for k, m in enumerate(members):
        seen = len(m)
        if seen < min_samples:
            seen = seen + sum(near(xy[m], xy[p], square).sum(axis=1) for p in pieces([members[n] for n in around[k]], len(m)))
        core[m] = seen >= min_samples
    cores, above = [m[core[m]] for m in members], list(range(len(members)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for k, a in enumerate(cores):
        for n in around[k] if len(a) else []:
            if n > k and len(cores[n]) and top(k) != top(n) and touch(xy[a], xy[cores[n]], eps):
                above[top(n)] = top(k)
    root = np.array([top(k) for k in range(len(members))])
    at = np.flatnonzero(core)
    roots, first, count = np.unique(root[of[at]], return_index=True, return_counts=True)
    first = at[first]  # a cluster goes by its first core
    begins = dict(zip(roots.tolist(), first.tolist(), strict=True))
    sizes = dict(sorted(zip(first.tolist(), count.tolist(), strict=True)))
    for k, m in enumerate(members):
        border = m[~core[m]]
        if len(border):
            best = np.full(len(border), len(xy))
            for n in [k, *around[k]]:
                for p in pieces([cores[n]], len(border)) if len(cores[n]) else []:
                    best = np.where(near(xy[border], xy[p], square).any(axis=1), np.minimum(best, begins[int(root[n])]), best)
            for b in best[best < len(xy)].tolist():
                sizes[b] += 1
    return list(sizes.values())


def touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of a lies within eps of one of b; a few are tried first, then all that reach the other's bounds, some at a time."""
    if near(a[:64], b[:64], eps * eps).any():
        return True
    reach = eps * (1 + 1e-9)
    a = a[((a >= b.min(axis=0) - reach) & (a <= b.max(axis=0) + reach)).all(axis=1)]
    if len(a):
        b = b[((b >= a.min(axis=0) - reach) & (b <= a.max(axis=0) + reach)).all(axis=1)]
    step = max(1, DISTANCES // max(len(b), 1))
    return len(b) > 0 and any(near(a[k : k + step], b, eps * eps).any() for k in range(0, len(a), step))


def crowd_reach(eps_px: Column, eps_share: Column, frame_height: Column) -> Column:
    """Radius of a crowd: a share of the frame's height where that is set, else pixels."""
    return F.coalesce(eps_share * frame_height, eps_px)


def clock(rows: DataFrame) -> DataFrame:
    """camera_id and every tick from a camera's first to its last, also those without rows."""
    ends = rows.groupBy("camera_id").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    return ends.select("camera_id", F.explode(F.sequence("a", "b")).alias("tick"))


def crowd_events(points: DataFrame, ticks: DataFrame, eps: float | Column, threshold: int, frames: int) -> DataFrame:
    """Crowds formed and dispersed, over every tick of a camera, also those without anyone."""
    largest = largest_cluster(points, ["camera_id", "tick"], eps)
    x = ticks.join(largest, ["camera_id", "tick"], "left").withColumn("size", F.coalesce("largest", F.lit(0)))
    x = x.withColumn("state", F.when(F.col("size") >= threshold, "formed").otherwise("dispersed"))
    e = confirmed_changes(x, ["camera_id"], ["tick"], "state", F.lit(frames), F.lit("dispersed"))
    return e.select("camera_id", "tick", F.col("state").alias("kind"), F.col("size").cast("long").alias("cluster_size"))


def zone_crowd_events(detections: DataFrame, zones: DataFrame, eps: float | Column, frames: int = 4) -> DataFrame:
    """Crowds formed and dispersed in each polygon with a crowd_threshold, over the camera's ticks at which the zone is on; crowd_min_frames, or frames, must agree.

    The largest cluster of who is inside counts, 0 where nobody is.
    """
    z = zones.where("ztype = 'polygon' AND crowd_threshold IS NOT NULL")
    keys = ["camera_id", "zone_id"]
    ticks = detections.groupBy("camera_id", "tick").agg(F.min("ts").alias("ts")).alias("d")  # a camera's own ticks
    on = ticks.join(z.alias("z"), applies(z.drop("classes"))).select("d.camera_id", "d.tick", "z.zone_id", "z.crowd_threshold", F.coalesce("z.crowd_min_frames", F.lit(frames)).alias("need"))
    d = detections.alias("d")
    within = d.join(z.alias("z"), applies(z) & inside(F.col("d.fx"), F.col("d.fy"))).select("d.camera_id", "z.zone_id", "d.tick", "d.fx", "d.fy")
    x = on.join(largest_cluster(within, [*keys, "tick"], eps), [*keys, "tick"], "left").withColumn("size", F.coalesce("largest", F.lit(0)))
    x = x.withColumn("state", F.when(F.col("size") >= F.col("crowd_threshold"), "formed").otherwise("dispersed"))
    e = confirmed_changes(x, keys, ["tick"], "state", F.col("need"), F.lit("dispersed"))
    return e.select(*keys, "tick", F.col("state").alias("kind"), F.col("size").cast("long").alias("cluster_size"))


def documents(zones: DataFrame, width: float) -> DataFrame:
    """zone_id and doc: a zone's rectangle as a JSON document with its corners as shares of the frame to five places, without what is null or the default."""
    v = lambda c: F.round(F.col(c) / width, 5)
    points = F.array(*[F.array(v(x), v(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    way = F.when(F.col("direction") != "both", F.col("direction"))
    return zones.select("zone_id", F.to_json(F.struct(F.col("zone_id").alias("id"), F.col("ztype").alias("type"), points.alias("points"), "min_frames", way.alias("direction"))).alias("doc"))


def densest(points: DataFrame, keys: list[str], radius: float, least: int) -> DataFrame:
    """keys, det_id, n and bounds of what lies within the radius of the point that most do, the first of equal ones, if at least so many do."""
    cell = lambda c: F.floor(F.col(c) / radius)
    x = points.select(*keys, "det_id", "fx", "fy", cell("fx").alias("cx"), cell("fy").alias("cy"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    y = x.select(*keys, F.col("fx").alias("qx"), F.col("fy").alias("qy"), F.explode(around).alias("c")).select(*keys, "qx", "qy", "c.cx", "c.cy")
    near = (F.col("fx") - F.col("qx")) ** 2 + (F.col("fy") - F.col("qy")) ** 2 <= radius * radius
    z = x.join(y, [*keys, "cx", "cy"]).where(near).groupBy(*keys, "det_id").agg(F.count("*").alias("n"), F.min("qx").alias("min_x"), F.max("qx").alias("max_x"), F.min("qy").alias("min_y"), F.max("qy").alias("max_y"))
    best = F.max_by(F.struct("det_id", "n", "min_x", "max_x", "min_y", "max_y"), F.struct("n", -F.col("det_id"))).alias("b")
    return z.groupBy(*keys).agg(best).where(F.col("b.n") >= least).select(*keys, "b.*")
