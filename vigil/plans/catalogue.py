"""Registered queries: each operator over the observation tables, with the same by plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.functions import geometry, schedule
from vigil.operators import alerts as A
from vigil.operators import datasets as D
from vigil.operators import sequences as S
from vigil.operators import similarity as M
from vigil.operators import validation as V
from vigil.operators import zones as Z
from vigil.sources.observations import prelude, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Register a function of (spark, sf_dir), and SQL over the named adapters."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{prelude(*tables)} {sql}" if tables else sql
        return f

    return add


def seconds(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


# -- scans, projections ---------------------------------------------------------------------------------------------

@query("scan_cadence_filter", "SELECT det_id, camera_id, obs_no FROM detections WHERE obs_no % 3 = 0 AND score >= 0.25", "detections")
def _(spark, d):
    return view(spark, d, "detections").where("obs_no % 3 = 0 AND score >= 0.25").select("det_id", "camera_id", "obs_no")


@query("latest_per_camera", "SELECT camera_id, max(det_id) AS det_id, count(*) - 1 AS dropped FROM detections GROUP BY camera_id", "detections")
def _(spark, d):
    return view(spark, d, "detections").groupBy("camera_id").agg(F.max("det_id").alias("det_id"), (F.count("*") - 1).alias("dropped"))


@query("resample_fractional", "SELECT det_id, obs_no FROM detections WHERE obs_no = 1 OR floor((obs_no - 1) / 2.5) > floor((obs_no - 2) / 2.5)", "detections")
def _(spark, d):
    return view(spark, d, "detections").where(S.resample(F.col("obs_no") - 1, 2.5)).select("det_id", "obs_no")


@query(
    "foot_point_projection",
    "SELECT det_id, fx AS foot_x, CASE WHEN fy >= 980 THEN 900.0 ELSE fy END AS foot_y, (fx - 20 <= 20 OR fy - 100 <= 20 OR fx + 20 >= 980 OR fy >= 980) AS at_edge, fx / 1000 AS nx FROM detections",
    "detections",
)
def _(spark, d):
    x, y = F.col("fx"), F.col("fy")
    fx, fy = geometry.foot(x - 20, x + 20, y)
    edge = geometry.touches_edge(x - 20, y - 100, x + 20, y, 1000, 1000)
    return view(spark, d, "detections").select("det_id", fx.alias("foot_x"), geometry.clamp_feet(fy, 1000).alias("foot_y"), edge.alias("at_edge"), (fx / 1000).alias("nx"))


IOU_SQL = """greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0)"""


@query(
    "iou_pairs",
    f"""SELECT gt_id, pred_id, round(i / (ga + pa - i), 6) AS iou FROM (SELECT g.box_id AS gt_id, p.box_id AS pred_id, {IOU_SQL} AS i, (g.x2 - g.x1) * (g.y2 - g.y1) AS ga, (p.x2 - p.x1) * (p.y2 - p.y1) AS pa
    FROM boxes g JOIN boxes p ON g.image_id = p.image_id AND g.class_id = p.class_id AND g.role = 'gt' AND p.role = 'pred') WHERE i / (ga + pa - i) >= 0.5""",
    "boxes",
)
def _(spark, d):
    return M.iou_pairs(view(spark, d, "boxes"), 0.5).withColumn("iou", F.round("iou", 6))


@query("letterbox_geometry", "SELECT p_partkey, round(least(416.0 / w, 416.0 / h), 6) AS ratio, CAST(floor(w * least(416.0 / w, 416.0 / h)) AS INT) AS w, CAST(floor(h * least(416.0 / w, 416.0 / h)) AS INT) AS h FROM (SELECT p_partkey, CAST(p_size * 32 AS DOUBLE) AS w, CAST(p_size * 16 + 64 AS DOUBLE) AS h FROM part)")
def _(spark, d):
    w, h = (F.col("p_size") * 32).cast("double"), (F.col("p_size") * 16 + 64).cast("double")
    r, a, b = geometry.letterbox(w, h, 416, 416)
    return table(spark, d, "part").select("p_partkey", F.round(r, 6).alias("ratio"), a.alias("w"), b.alias("h"))


@query(
    "anchor_grid",
    """, gt AS (SELECT s AS stride, floor((x1 + x2) / 2 / s) AS x, floor((y1 + y2) / 2 / s) AS y FROM boxes, (VALUES (8), (16), (32)) v(s) WHERE role = 'gt'),
    gr AS (SELECT s AS stride, x, y FROM (VALUES (8), (16), (32)) v(s), LATERAL (SELECT unnest(range(0, 416 // s)) AS x) a, LATERAL (SELECT unnest(range(0, 416 // s)) AS y) b)
    SELECT CAST(gr.stride AS INT) AS stride, CAST(count(*) AS BIGINT) AS n, CAST(sum(gr.x * gr.stride) AS BIGINT) AS sum_x, CAST(sum(gr.y * gr.stride) AS BIGINT) AS sum_y, CAST(count(c.k) AS BIGINT) AS used, CAST(coalesce(sum(c.k), 0) AS BIGINT) AS truths
    FROM gr LEFT JOIN (SELECT stride, x, y, count(*) AS k FROM gt GROUP BY stride, x, y) c ON c.stride = gr.stride AND c.x = gr.x AND c.y = gr.y GROUP BY gr.stride""",
    "boxes",
)
def _(spark, d):
    """The grid of anchors of each stride, with how many ground-truth boxes have their centre there."""
    grid = D.anchor_grid(spark, 416, (8, 16, 32))
    truths = view(spark, d, "boxes").where("role = 'gt'").select(F.explode(F.array(*[F.lit(s) for s in (8, 16, 32)])).alias("stride"), "x1", "y1", "x2", "y2")
    centre = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / F.col("stride")).cast("int")
    hits = truths.groupBy("stride", centre("x1", "x2").alias("x"), centre("y1", "y2").alias("y")).agg(F.count("*").alias("k"))
    g = grid.join(hits, ["stride", "x", "y"], "left")
    place = lambda c: F.sum(F.col(c).cast("long") * F.col("stride"))
    return g.groupBy("stride").agg(F.count("*").alias("n"), place("x").alias("sum_x"), place("y").alias("sum_y"), F.count("k").alias("used"), F.coalesce(F.sum("k"), F.lit(0)).alias("truths"))


@query("box_format_convert", "SELECT box_id, (x1 + x2) / 2 / 1000 AS cx, (y1 + y2) / 2 / 1000 AS cy, (x2 - x1) / 1000 AS w, (y2 - y1) / 1000 AS h FROM boxes", "boxes")
def _(spark, d):
    c = F.col
    return view(spark, d, "boxes").select("box_id", ((c("x1") + c("x2")) / 2 / 1000).alias("cx"), ((c("y1") + c("y2")) / 2 / 1000).alias("cy"), ((c("x2") - c("x1")) / 1000).alias("w"), ((c("y2") - c("y1")) / 1000).alias("h"))


WARP = [f"((0.8 * {x} + 100 * (1 - {y} / 1000)) / (1 - 0.2 * {y} / 1000))" for x in ("x1", "x2") for y in ("y1", "y2")]


@query("perspective_box_warp", f"SELECT box_id, round(least({', '.join(WARP)}), 6) AS wx1, round(least(0.8 * y1 / (1 - 0.2 * y1 / 1000), 0.8 * y2 / (1 - 0.2 * y2 / 1000)), 6) AS wy1, round(greatest({', '.join(WARP)}), 6) AS wx2, round(greatest(0.8 * y1 / (1 - 0.2 * y1 / 1000), 0.8 * y2 / (1 - 0.2 * y2 / 1000)), 6) AS wy2 FROM boxes".replace("0.8 ", "CAST(0.8 AS DOUBLE) ").replace("0.2 ", "CAST(0.2 AS DOUBLE) "), "boxes")
def _(spark, d):
    return view(spark, d, "boxes").select("box_id", *[c.alias(n) for c, n in zip(D.warped_box(0.1, 1000.0, 1000.0), ("wx1", "wy1", "wx2", "wy2"), strict=True)])


@query("class_remap", "SELECT box_id, CASE class_id WHEN 0 THEN 'helmet' WHEN 1 THEN 'vest' END AS klass FROM boxes WHERE class_id IN (0, 1)", "boxes")
def _(spark, d):
    names = spark.sql("SELECT * FROM (VALUES (0, 'helmet'), (1, 'vest')) AS m(class_id, klass)")
    return view(spark, d, "boxes").join(names, "class_id").select("box_id", "klass")


# -- predicates -----------------------------------------------------------------------------------------------------

@query("zone_membership", "SELECT zone_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(det_id) AS BIGINT) AS ids FROM detections JOIN zones ON zones.camera_id = detections.camera_id AND fx BETWEEN x0 AND x1 AND fy BETWEEN y0 AND y1 GROUP BY zone_id", "detections", "zones")
def _(spark, d):
    c = F.col
    corners = F.array(*[F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    shapes = view(spark, d, "zones").select("zone_id", "camera_id", "x0", "y0", "x1", "y1", geometry.edges(corners).alias("sides"))
    return Z.membership_polygon(view(spark, d, "detections"), shapes).groupBy("zone_id").agg(F.count("*").alias("n"), F.sum("det_id").alias("ids"))


@query("tripwire_side", "SELECT det_id, CASE WHEN c > 0 THEN 'a' WHEN c < 0 THEN 'b' ELSE 'on' END AS side FROM (SELECT det_id, (900 - 100) * (fy - 100) - (800 - 100) * (fx - 100) AS c FROM detections)", "detections")
def _(spark, d):
    return view(spark, d, "detections").select("det_id", geometry.side_of_line(100, 100, 900, 800, F.col("fx"), F.col("fy")).alias("side"))


@query(
    "schedule_active",
    """SELECT event_id, list_contains([0, 2, 4], wd) AND s >= 79200 OR list_contains([0, 2, 4], (wd + 6) % 7) AND s < 21600 AS overnight, list_contains([0, 1, 2, 3, 4], wd) AND s >= 32400 AND s < 61200 AS office
    FROM (SELECT event_id, CAST(isodow(ts) - 1 AS INT) AS wd, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS s FROM events)""",
)
def _(spark, d):
    days = lambda *n: F.array(*[F.lit(x) for x in n])
    night = schedule.is_active(F.col("ts"), days(0, 2, 4), F.lit(79200), F.lit(21600))
    office = schedule.is_active(F.col("ts"), days(0, 1, 2, 3, 4), F.lit(32400), F.lit(61200))
    return table(spark, d, "events").select("event_id", night.alias("overnight"), office.alias("office"))


@query("exclusion_antijoin", "SELECT camera_id, count(*) AS n FROM detections WHERE NOT (fx BETWEEN 600 AND 900 AND fy BETWEEN 600 AND 900) GROUP BY camera_id", "detections")
def _(spark, d):
    return Z.unmasked(view(spark, d, "detections"), view(spark, d, "zones")).groupBy("camera_id").agg(F.count("*").alias("n"))


@query(
    "fire_roi_acceptance",
    """SELECT camera_id, tick, klass, arg_max(det_id, score * 1e9 - det_id) AS det_id, max(score) AS score FROM detections WHERE klass IN ('fire', 'smoke') AND NOT (fx BETWEEN 600 AND 900 AND fy BETWEEN 600 AND 900)
    AND score >= CASE WHEN fx BETWEEN 100 AND 400 AND fy BETWEEN 100 AND 400 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END GROUP BY camera_id, tick, klass""",
    "detections",
)
def _(spark, d):
    return Z.strongest(Z.fire_accepted(view(spark, d, "detections"), view(spark, d, "zones"), 0.45))


@query(
    "polygon_validation",
    """SELECT p_partkey, round(CASE WHEN k IN (0, 3) THEN w * h WHEN k = 6 THEN 0.75e0 * w * h ELSE 0 END, 6) AS area, w * h > 0.8 AND k IN (0, 3) AS large,
    CASE k WHEN 1 THEN 'crosses itself; no area' WHEN 2 THEN 'too few points; no area' WHEN 3 THEN CASE WHEN w > 0.5 THEN 'outside 0 to 1' ELSE '' END WHEN 4 THEN 'crosses itself; no area' WHEN 5 THEN CASE WHEN w < 0.05 THEN 'too short' ELSE '' END ELSE '' END AS errors
    FROM (SELECT p_partkey, p_partkey % 7 AS k, CAST(p_size AS DOUBLE) / 50 AS w, CAST(1 AS DOUBLE) - CAST(p_size AS DOUBLE) / 100 AS h FROM part)""",
)
def _(spark, d):
    """Rectangles, bow ties, two points, shapes beyond the frame, doubled lines, tripwires and notched shapes."""
    k, w, h = F.col("p_partkey") % 7, F.col("p_size").cast("double") / 50, 1 - F.col("p_size").cast("double") / 100
    zero = F.lit(0.0)
    pts = lambda *p: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p])
    shape = (
        F.when(k == 1, pts((zero, zero), (w, h), (w, zero), (zero, h))).when(k == 2, pts((zero, zero), (w, h))).when(k == 3, pts((w, zero), (w + w, zero), (w + w, h), (w, h)))
        .when(k == 4, pts((zero, zero), (w, h), (zero, zero), (w / 2, h / 2))).when(k == 5, pts((zero, zero), (w, zero))).when(k == 6, pts((zero, zero), (w, zero), (w, h), (w / 2, h / 2), (zero, h)))
        .otherwise(pts((zero, zero), (w, zero), (w, h), (zero, h)))
    )
    x = table(spark, d, "part").select("p_partkey", k.alias("k"), shape.alias("shape"))
    errors = F.when(F.col("k") == 5, geometry.problems(F.col("shape"), "tripwire")).otherwise(geometry.problems(F.col("shape")))
    area = F.when(F.col("k") == 5, 0.0).otherwise(geometry.shoelace(F.col("shape")))
    return x.select("p_partkey", F.round(area, 6).alias("area"), (F.col("k").isin(0, 3) & V.area_warning(F.col("shape"))).alias("large"), F.concat_ws("; ", errors).alias("errors"))


# -- sequences ------------------------------------------------------------------------------------------------------

def changes_sql(source: str, keys: str, order: str, frames: str, initial: str | None = None) -> str:
    first = f"CASE WHEN run = 1 THEN 1 ELSE {frames} END" if initial is None else frames
    before = f"lag(state) OVER (PARTITION BY {keys} ORDER BY {order})"
    before = before if initial is None else f"coalesce({before}, {initial})"
    return f"""SELECT * FROM (SELECT *, {before} AS before FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, run ORDER BY {order}) AS age FROM
    (SELECT *, sum(chg) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY {keys} ORDER BY {order}) IS DISTINCT FROM state THEN 1 ELSE 0 END AS chg FROM {source}))) WHERE age = {first}) WHERE before <> state"""


BOUNDARY = changes_sql("(SELECT d.*, z.zone_id, z.min_frames, z.severity, CASE WHEN fx BETWEEN x0 AND x1 AND fy BETWEEN y0 AND y1 THEN 'entry' ELSE 'exit' END AS state FROM detections d JOIN zones z ON z.camera_id = d.camera_id WHERE ztype = 'polygon')", "camera_id, zone_id, track_id", "obs_no", "min_frames")


@query("boundary_events", f"SELECT det_id, camera_id, zone_id, track_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, state AS kind, severity, fx / 1000 AS nx, fy / 1000 AS ny FROM ({BOUNDARY})", "detections", "zones")
def boundary(spark, d):
    x = Z.boundary_events(view(spark, d, "detections"), view(spark, d, "zones"))
    return x.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


TRIP = changes_sql(
    "(SELECT *, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY camera_id, track_id ORDER BY obs_no ROWS UNBOUNDED PRECEDING), 'a') AS state FROM (SELECT *, CASE WHEN (900 - 100) * (fy - 100) - (800 - 100) * (fx - 100) > 0 THEN 'a' WHEN (900 - 100) * (fy - 100) - (800 - 100) * (fx - 100) < 0 THEN 'b' END AS side FROM detections))",
    "camera_id, track_id", "obs_no", "2",
)


@query("tripwire_events", f"SELECT det_id, camera_id, track_id, CASE state WHEN 'b' THEN 'entry' ELSE 'exit' END AS kind FROM ({TRIP})", "detections")
def _(spark, d):
    return Z.tripwire_events(view(spark, d, "detections"), (100, 100, 900, 800), 2)


OCCUPIED = f"""up AS (SELECT *, dense_rank() OVER (PARTITION BY camera_id ORDER BY tick) AS update_no FROM detections),
st AS (SELECT d.*, z.zone_id, z.min_frames, CASE WHEN fx BETWEEN x0 AND x1 AND fy BETWEEN y0 AND y1 THEN 'entry' ELSE 'exit' END AS state FROM up d JOIN zones z ON z.camera_id = d.camera_id WHERE ztype = 'polygon'),
rn AS (SELECT *, row_number() OVER (PARTITION BY camera_id, zone_id, track_id, run ORDER BY obs_no) AS age FROM (SELECT *, sum(chg) OVER (PARTITION BY camera_id, zone_id, track_id ORDER BY obs_no ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY camera_id, zone_id, track_id ORDER BY obs_no) IS DISTINCT FROM state THEN 1 ELSE 0 END AS chg FROM st))),
ls AS (SELECT camera_id, zone_id, track_id, arg_max(state, obs_no) FILTER (age >= CASE WHEN run = 1 THEN 1 ELSE min_frames END) = 'entry' AS i, max(update_no) AS seen FROM rn GROUP BY camera_id, zone_id, track_id),
nw AS (SELECT camera_id, count(DISTINCT tick) AS u FROM detections GROUP BY camera_id)
SELECT z.camera_id, z.zone_id, count(ls.track_id) AS n FROM (SELECT camera_id, zone_id FROM zones WHERE ztype = 'polygon') z JOIN nw ON nw.camera_id = z.camera_id LEFT JOIN ls ON ls.camera_id = z.camera_id AND ls.zone_id = z.zone_id AND ls.i AND ls.seen >= nw.u - 3 GROUP BY z.camera_id, z.zone_id"""


@query("zone_occupancy", f"{prelude('detections', 'zones')}, {OCCUPIED}")
def _(spark, d):
    zones, x = view(spark, d, "zones").where("ztype = 'polygon'"), view(spark, d, "detections")
    updates = x.select("camera_id", "tick").distinct()  # a camera's hours are its updates
    updates = updates.withColumn("update_no", F.row_number().over(W.partitionBy("camera_id").orderBy("tick")))
    x = x.join(updates, ["camera_id", "tick"])
    y = Z.membership(x, zones).withColumn("state", F.when(F.col("inside"), "entry").otherwise("exit"))
    r = S.runs(y, ["camera_id", "zone_id", "track_id"], ["obs_no"], "state")
    sure = F.col("age") >= F.when(F.col("run") == 1, 1).otherwise(F.col("min_frames"))
    states = r.groupBy("camera_id", "zone_id", "track_id").agg((F.max_by("state", F.when(sure, F.col("obs_no"))) == "entry").alias("inside"), F.max("update_no").alias("last_seen"))
    return Z.occupancy(states, zones, updates.groupBy("camera_id").agg(F.max("update_no").alias("update_no")))


def crowd_sql(reach: str, members: int, frames: int) -> str:
    """Clusters of two and more as reachability, then confirmed changes; rows: pts with reach as the square of each point's radius."""
    return f"""pr AS (SELECT a.camera_id, a.tick, a.det_id AS a, b.det_id AS b FROM pts a JOIN pts b ON a.camera_id = b.camera_id AND a.tick = b.tick AND (a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) <= {reach}),
    rc AS (SELECT * FROM pr UNION SELECT rc.camera_id, rc.tick, rc.a, pr.b FROM rc JOIN pr ON pr.camera_id = rc.camera_id AND pr.tick = rc.tick AND pr.a = rc.b),
    sz AS (SELECT camera_id, tick, max(k) AS size FROM (SELECT camera_id, tick, a, count(*) AS k FROM rc GROUP BY camera_id, tick, a) WHERE k >= 2 GROUP BY camera_id, tick),
    st AS (SELECT c.camera_id, t.tick, coalesce(sz.size, 0) AS size, CASE WHEN coalesce(sz.size, 0) >= {members} THEN 'formed' ELSE 'dispersed' END AS state FROM (SELECT camera_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM detections GROUP BY camera_id) t JOIN (SELECT DISTINCT camera_id FROM detections) c ON c.camera_id = t.camera_id LEFT JOIN sz ON sz.camera_id = t.camera_id AND sz.tick = t.tick)
    SELECT camera_id, tick, state AS kind, CAST(size AS BIGINT) AS cluster_size FROM ({changes_sql('st', 'camera_id', 'tick', str(frames), "'dispersed'")})"""


@query("crowd_events", f"WITH RECURSIVE {prelude('detections')[5:]}, pts AS (SELECT * FROM detections WHERE NOT (fx BETWEEN 600 AND 900 AND fy BETWEEN 600 AND 900)), {crowd_sql('14400', 3, 2)}")
def _(spark, d):
    x = view(spark, d, "detections")
    return Z.crowd_events(Z.unmasked(x, view(spark, d, "zones")), Z.clock(x), 120.0, 3, 2)


@query("eps_scaling_dbscan", f"WITH RECURSIVE {prelude('detections')[5:]}, pts AS (SELECT * FROM detections), {crowd_sql('CASE WHEN right(a.camera_id, 1) < chr(51) THEN 11664.0 ELSE 22500.0 END', 3, 2)}")
def _(spark, d):
    x = view(spark, d, "detections")
    share = F.when(F.col("camera_id").isin("cam_01", "cam_02"), 0.1)  # the other cameras have no share and use pixels
    return Z.crowd_events(x, Z.clock(x), Z.crowd_reach(F.lit(150.0), share, F.lit(1080.0)), 3, 2)


@query(
    "ppe_violations",
    """SELECT camera_id, track_id, obs_no FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, run ORDER BY obs_no) AS age FROM (SELECT *, sum(chg) OVER (PARTITION BY camera_id, track_id ORDER BY obs_no ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY camera_id, track_id ORDER BY obs_no) IS DISTINCT FROM state THEN 1 ELSE 0 END AS chg FROM (SELECT camera_id, track_id, obs_no, CASE WHEN score >= 0.65 THEN 'present' WHEN score <= 0.35 THEN 'absent' END AS state FROM detections) WHERE state IS NOT NULL))) WHERE state = 'absent' AND age = 3""",
    "detections",
)
def _(spark, d):
    state = F.when(F.col("score") >= 0.65, "present").when(F.col("score") <= 0.35, "absent")
    x = view(spark, d, "detections").withColumn("state", state).where("state IS NOT NULL")
    return S.runs(x, ["camera_id", "track_id"], ["obs_no"], "state").where("state = 'absent' AND age = 3").select("camera_id", "track_id", "obs_no")


def throttle_sql(rows: str, keys: list[str]) -> str:
    """rows: keys, t, i, gap. What a throttle lets pass, by recursion from each that passed to the next one late enough."""
    k = ", ".join(keys)
    same = " AND ".join(f"n.{c} = p.{c}" for c in keys)
    outer = ", ".join(f"p.{c}" for c in keys)
    return f"""rr AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY t, i) AS rn FROM rr),
    ps AS (SELECT {k}, t, i, gap, rn FROM o WHERE rn = 1 UNION ALL SELECT {outer}, n.t, n.i, n.gap, n.rn FROM ps p JOIN o n ON {same} AND n.rn = (SELECT min(m.rn) FROM o m WHERE {same.replace('n.', 'm.')} AND m.rn > p.rn AND m.t - p.t >= m.gap))"""


@query("fire_alarm_gap", f"WITH RECURSIVE {prelude('detections')[5:]}, {throttle_sql('SELECT camera_id, klass, CAST(epoch(ts) AS DOUBLE) AS t, det_id AS i, 21600.0 AS gap FROM detections WHERE klass IN (chr(102) || chr(105) || chr(114) || chr(101), chr(115) || chr(109) || chr(111) || chr(107) || chr(101)) AND score >= 0.45', ['camera_id', 'klass'])} SELECT camera_id, klass, i AS det_id FROM ps")
def _(spark, d):
    x = view(spark, d, "detections").where("klass IN ('fire', 'smoke') AND score >= 0.45").withColumn("at", seconds("ts")).withColumn("gap", F.lit(21600.0))
    return S.throttle(x, ["camera_id", "klass"], "at", "gap", "det_id")


ROUTED = """SELECT rule_id, camera_id, kind, coalesce(zone_id, '') AS zone, CAST(epoch(ts) AS DOUBLE) AS t, alert_id AS i, CAST(cooldown_s AS DOUBLE) AS gap, CASE WHEN subtype = 'exit' THEN 'plain' ELSE 'clip' END AS scope FROM alerts, alert_rules
 WHERE enabled AND (kinds = '' OR list_contains(string_split(kinds, ','), kind)) AND CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END >= CASE min_severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"""


@query("alert_cooldown", f"WITH RECURSIVE {prelude('alerts', 'alert_rules')[5:]}, {throttle_sql(ROUTED, ['rule_id', 'camera_id', 'kind', 'zone', 'scope'])} SELECT rule_id, camera_id, kind, zone, scope, i AS alert_id FROM ps")
def notified(spark, d):
    scope = F.when(F.col("subtype") == "exit", "plain").otherwise("clip")
    return A.notifications(view(spark, d, "alerts"), view(spark, d, "alert_rules"), scope)


@query("alert_follow_ups", f"WITH RECURSIVE {prelude('alerts', 'alert_rules')[5:]}, {throttle_sql(ROUTED, ['rule_id', 'camera_id', 'kind', 'zone', 'scope'])} SELECT p.rule_id, p.i AS alert_id FROM ps p JOIN alerts a ON a.alert_id = p.i JOIN alert_rules r ON r.rule_id = p.rule_id WHERE a.alert_id % 3 <> 0 AND (a.alert_id % 5 <> 0 OR r.min_severity = 'low')")
def _(spark, d):
    """Two thirds of all alerts come again with their clip, some as low by now; only those that went out are followed up."""
    later = view(spark, d, "alerts").where("alert_id % 3 <> 0").withColumn("severity", F.when(F.col("alert_id") % 5 == 0, "low").otherwise(F.col("severity")))
    return A.follow_ups(later, notified(spark, d), view(spark, d, "alert_rules"))


WELDING = """e AS (SELECT user_id % 4 AS camera, CAST(epoch(ts) AS DOUBLE) AS t, event_type = 'click' AS s, CAST(value AS DOUBLE) AS y FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY t, s, y) AS rn FROM e),
f AS (SELECT DISTINCT camera, CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS recent, FALSE AS latched, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS ly, FALSE AS fires, CAST(NULL AS DOUBLE) AS t FROM e UNION ALL
 SELECT camera, rn, rec, on_ OR fires, last, CASE WHEN ends THEN NULL WHEN s THEN y ELSE ly END, fires, t FROM (SELECT *, s AND NOT on_ AND coalesce(list_sum(rec), 0) >= 3 AS fires FROM
 (SELECT camera, rn, s, y, ly, t, last, ends, CASE WHEN ends THEN CAST([] AS INT[]) ELSE rec END AS rec, latched AND NOT ends AS on_ FROM (SELECT *, latched AND coalesce(t - last >= 1800, FALSE) AS ends FROM
 (SELECT f.camera, o.rn, f.latched, f.ly, o.t, o.s, o.y, CASE WHEN o.s THEN o.t ELSE f.last END AS last, list_append(CASE WHEN len(f.recent) >= 10 THEN f.recent[2:] ELSE f.recent END, CAST(o.s AND NOT coalesce(o.y - f.ly < -25, FALSE) AS INT)) AS rec
  FROM f JOIN o ON o.camera = f.camera AND o.rn = f.rn + 1)))))
SELECT camera, t AS started FROM f WHERE fires"""


@query("welding_episodes", f"WITH RECURSIVE {WELDING}")
def _(spark, d):
    x = table(spark, d, "events").select((F.col("user_id") % 4).alias("camera"), seconds("ts").alias("at"), (F.col("event_type") == "click").alias("spark"), "value")
    return S.episodes(x, ["camera"], "at", "spark", calm=1800.0, y="value")


@query("feed_gaps", "SELECT camera_id, unnest([{'kind': 'feed_lost', 'at': t}, {'kind': 'feed_restored', 'at': n}]).kind AS kind, unnest([t, n]) AS at, n - t AS gap_s FROM (SELECT camera_id, CAST(epoch(ts) AS DOUBLE) AS t, lead(CAST(epoch(ts) AS DOUBLE)) OVER (PARTITION BY camera_id ORDER BY ts) AS n FROM detections) WHERE n - t >= 7200", "detections")
def _(spark, d):
    return S.gaps(view(spark, d, "detections").select("camera_id", seconds("ts").alias("at")), ["camera_id"], "at", 7200)


@query("rolling_hits", "SELECT det_id, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id ORDER BY det_id ROWS 9 PRECEDING) AS hits FROM detections".replace("sum(", "CAST(sum(").replace("PRECEDING) AS", "PRECEDING) AS BIGINT) AS"), "detections")
def _(spark, d):
    return S.rolling_hits(view(spark, d, "detections"), ["camera_id"], ["det_id"], F.col("score") >= 0.5, 10).select("det_id", "hits")


@query("growth", "SELECT det_id, coalesce(lag(score, 2) OVER w < lag(score) OVER w AND lag(score) OVER w < score, FALSE) AS growing FROM detections WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY obs_no)", "detections")
def _(spark, d):
    return S.growing(view(spark, d, "detections"), ["camera_id", "track_id"], ["obs_no"], "score").select("det_id", "growing")


@query("ema_fold", "WITH RECURSIVE e AS (SELECT user_id % 16 AS k, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS rn, CAST(value AS DOUBLE) AS v FROM events), r AS (SELECT k, rn, v AS m FROM e WHERE rn = 1 UNION ALL SELECT r.k, r.rn + 1, CAST(0.9 AS DOUBLE) * r.m + CAST(0.1 AS DOUBLE) * e.v FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1) SELECT k, round(arg_max(m, rn), 6) AS ema FROM r GROUP BY k")
def _(spark, d):
    x = table(spark, d, "events").withColumn("k", F.col("user_id") % 16)
    return S.moving_average(x, ["k"], ["event_id"], "value").select("k", F.round("ema", 6).alias("ema"))


@query("backoff_schedule", "SELECT p_partkey, least(2.0 * pow(2.0, p_size % 10), 60.0) AS wait FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.backoff(F.col("p_size") % 10 + 1, 2, 60).alias("wait"))


# -- store ----------------------------------------------------------------------------------------------------------

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("recent_alerts", "SELECT alert_id, kind, zone_id FROM alerts WHERE kind = 'fire' ORDER BY ts DESC, alert_id DESC LIMIT 50", "alerts")
def _(spark, d):
    return A.recent(view(spark, d, "alerts"), 50, kind="fire").select("alert_id", "kind", "zone_id")


@query("live_then_filter", "SELECT alert_id FROM (SELECT * FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 50) WHERE camera_id = 'cam_01'", "alerts")
def _(spark, d):
    return A.live(view(spark, d, "alerts"), 50, "cam_01").select("alert_id")


@query("event_counts", "SELECT kind, count(*) AS n FROM alerts GROUP BY kind", "alerts")
def _(spark, d):
    return A.counts(view(spark, d, "alerts"))


@query("zone_entry_counts", "SELECT zone_id, count(*) AS n FROM alerts WHERE kind = 'boundary' AND subtype = 'entry' AND zone_id IS NOT NULL GROUP BY zone_id", "alerts")
def _(spark, d):
    return A.zone_entries(view(spark, d, "alerts"))


@query("alert_summary", "SELECT kind, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS today FROM alerts GROUP BY kind", "alerts")
def _(spark, d):
    return A.summary(view(spark, d, "alerts"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("alert_history_filter", "SELECT alert_id FROM alerts WHERE kind = 'boundary' AND camera_id = 'cam_02' AND ts >= TIMESTAMP '2024-01-10' AND identity_status = 'known'", "alerts")
def _(spark, d):
    return view(spark, d, "alerts").where("kind = 'boundary' AND camera_id = 'cam_02' AND ts >= TIMESTAMP_NTZ '2024-01-10' AND identity_status = 'known'").select("alert_id")


@query("recognition_log", "SELECT alert_id, identity_status FROM ((SELECT * FROM alerts WHERE identity_status = 'known' ORDER BY ts DESC, alert_id DESC LIMIT 40) UNION ALL (SELECT * FROM alerts WHERE identity_status = 'unknown_face' ORDER BY ts DESC, alert_id DESC LIMIT 40)) ORDER BY ts DESC, alert_id DESC LIMIT 40", "alerts")
def _(spark, d):
    x = view(spark, d, "alerts")
    both = A.recent(x, 40, identity_status="known").unionByName(A.recent(x, 40, identity_status="unknown_face"))
    return A.recent(both, 40).select("alert_id", "identity_status")


@query("retention_split", "SELECT camera_id, count(*) AS n FROM alerts WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY camera_id", "alerts")
def _(spark, d):
    return A.retention(view(spark, d, "alerts"), F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("camera_id").agg(F.count("*").alias("n"))


@query("evidence_merge", "SELECT track_id, count(*) AS attempts, arg_max(subtype, alert_id) FILTER (subtype IS NOT NULL) AS subtype, arg_max(zone_id, alert_id) FILTER (zone_id IS NOT NULL) AS zone_id FROM alerts GROUP BY track_id", "alerts")
def _(spark, d):
    return A.latest_state(view(spark, d, "alerts"), "track_id", "alert_id", ["subtype", "zone_id"])


@query(
    "alert_messages",
    """SELECT alert_id, CASE kind WHEN 'boundary' THEN who || CASE subtype WHEN 'entry' THEN ' entered ' ELSE ' left ' END || place WHEN 'crowd' THEN CASE subtype WHEN 'dispersed' THEN 'Crowd dispersed in ' ELSE 'Crowd formed in ' END || place WHEN 'ppe' THEN 'Missing ' || subtype || ' in ' || place
    WHEN 'access' THEN who || ' is not allowed in ' || place WHEN 'welding' THEN 'Welding started on ' || camera_id WHEN 'health' THEN CASE subtype WHEN 'feed_lost' THEN 'Feed lost on ' ELSE 'Feed restored on ' END || camera_id WHEN 'fire' THEN 'Fire detected on ' || camera_id ELSE 'Smoke detected on ' || camera_id END AS message,
    '[' || upper(severity) || '] ' || upper(kind[1]) || kind[2:] || ' - ' || camera_id AS subject
    FROM (SELECT * REPLACE (CASE alert_id % 12 WHEN 3 THEN 'access' WHEN 5 THEN 'welding' WHEN 7 THEN 'health' ELSE kind END AS kind, CASE alert_id % 12 WHEN 7 THEN 'feed_lost' ELSE subtype END AS subtype),
      CASE identity_status WHEN 'known' THEN 'A known person' WHEN 'unknown_face' THEN 'An unrecognised person' ELSE 'Someone' END AS who, coalesce(zone_id, 'the scene') AS place FROM alerts)""",
    "alerts",
)
def _(spark, d):
    k = F.col("alert_id") % 12  # the table has no alerts of three kinds
    x = view(spark, d, "alerts").withColumns({"kind": F.when(k == 3, "access").when(k == 5, "welding").when(k == 7, "health").otherwise(F.col("kind")), "subtype": F.when(k == 7, "feed_lost").otherwise(F.col("subtype"))})
    return A.message(x).join(A.subject(x), "alert_id")


@query("clip_policy", "SELECT alert_id, CASE kind WHEN 'boundary' THEN coalesce(identity_status <> 'known', TRUE) WHEN 'ppe' THEN FALSE ELSE TRUE END AS record, kind IN ('fire', 'smoke') AS urgent, CASE kind WHEN 'boundary' THEN CASE WHEN identity_status = 'known' THEN 'registered person' ELSE 'unregistered person' END WHEN 'ppe' THEN 'off' ELSE 'on' END AS reason FROM alerts", "alerts")
def _(spark, d):
    return A.clip_decision(view(spark, d, "alerts"), {"boundary": "unregistered", "ppe": "off"}, ("fire", "smoke"))


@query("evidence_presence", "SELECT alert_id, 'clips/' || camera_id || '/' || strftime(ts, '%Y-%m-%d') || '/' || alert_id || '.mp4' AS key FROM alerts", "alerts")
def _(spark, d):
    return A.evidence_key(view(spark, d, "alerts"))


@query(
    "identity_exit_asof",
    """SELECT alert_id, camera_id, track_id, identity FROM (SELECT *, last_value(CASE WHEN subtype = 'entry' THEN coalesce(identity_status, 'no_face') END IGNORE NULLS) OVER (PARTITION BY camera_id, track_id, visit ORDER BY t, alert_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS identity FROM
    (SELECT *, sum(CASE WHEN t - before > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, track_id ORDER BY t, alert_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS visit FROM (SELECT *, lag(t) OVER (PARTITION BY camera_id, track_id ORDER BY t, alert_id NULLS FIRST) AS before FROM
    (SELECT camera_id, track_id, CAST(epoch(ts) AS DOUBLE) AS t, alert_id, subtype, identity_status FROM alerts WHERE kind = 'boundary' UNION ALL SELECT camera_id, track_id, CAST(epoch(ts) AS DOUBLE), NULL, NULL, NULL FROM detections)))) WHERE subtype = 'exit'""",
    "alerts", "detections",
)
def _(spark, d):
    return A.exit_identities(view(spark, d, "alerts").where("kind = 'boundary'"), view(spark, d, "detections"), 21600.0)


@query(
    "access_control",
    """SELECT alert_id, camera_id, track_id, 'critical' AS severity FROM alerts WHERE kind = 'boundary' AND subtype = 'entry' AND zone_id IN ('zone_1', 'zone_3') AND NOT (identity_status = 'known' AND track_id % 10 IN (1, 3, 5))""",
    "alerts",
)
def _(spark, d):
    lists = spark.sql("SELECT * FROM (VALUES ('zone_1', array(1L, 3L, 5L)), ('zone_2', array()), ('zone_3', array(1L, 3L, 5L))) AS z(zone_id, persons)")
    return A.access_violations(view(spark, d, "alerts").withColumn("person_id", F.col("track_id") % 10), lists)


@query("dedup_alerts", "SELECT DISTINCT camera_id, kind, subtype, severity FROM alerts", "alerts")
def _(spark, d):
    return view(spark, d, "alerts").select("camera_id", "kind", "subtype", "severity").dropDuplicates()


@query("camera_reconcile", "SELECT camera_id, CASE WHEN a AND b THEN 'keep' WHEN a THEN 'stop' ELSE 'start' END AS action FROM (SELECT camera_id, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT DISTINCT camera_id, 1 AS s FROM alerts WHERE camera_id <> 'cam_01' UNION ALL SELECT DISTINCT camera_id, 2 FROM alerts WHERE camera_id <> 'cam_04') GROUP BY camera_id)", "alerts")
def _(spark, d):
    c = view(spark, d, "alerts").select("camera_id").distinct()
    running, wanted = c.where("camera_id <> 'cam_01'"), c.where("camera_id <> 'cam_04'")
    part = lambda x, action: x.withColumn("action", F.lit(action))
    return part(running.intersect(wanted), "keep").unionByName(part(running.exceptAll(wanted), "stop")).unionByName(part(wanted.exceptAll(running), "start"))


@query("disk_budget_prune", "SELECT o_orderkey FROM (SELECT o_orderkey, sum(c) OVER (PARTITION BY o_custkey) - coalesce(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)) WHERE rest > 50000000")
def _(spark, d):
    x = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return A.prune_to_budget(x, ["o_orderdate", "o_orderkey"], "cents", 50_000_000, ["o_custkey"]).select("o_orderkey")


@query("snapshot_nearest", "SELECT alert_id, arg_min(det_id, struct_pack(d := gap, i := det_id)) AS det_id FROM (SELECT a.alert_id, d.det_id, abs(epoch(a.ts) - epoch(d.ts)) AS gap FROM (SELECT * FROM alerts WHERE kind = 'crowd') a JOIN detections d ON a.camera_id = d.camera_id AND d.klass = 'person' AND d.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR) GROUP BY alert_id", "alerts", "detections")
def _(spark, d):
    return A.nearest_frames(view(spark, d, "alerts").where("kind = 'crowd'"), view(spark, d, "detections").where("klass = 'person'"), 3600)


# -- similarity -----------------------------------------------------------------------------------------------------

COS = "list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"


@query("identity_nearest", f"SELECT vec_id, CASE WHEN s >= 0.2 THEN CAST(person_id AS VARCHAR) ELSE '' END AS person_id, round(s, 6) AS similarity, CASE WHEN s >= 0.2 THEN 'known' ELSE 'unknown_face' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, person_id, pose_idx) AS r FROM (SELECT vec_id, person_id, pose_idx, {COS} / sqrt({COS.replace('b[i]', 'a[i]')} * {COS.replace('a[i]', 'b[i]').replace('len(a)', 'len(b)')}) AS s FROM (SELECT p.vec_id, g.person_id, g.pose_idx, p.embedding AS a, g.embedding AS b FROM probes p, gallery g WHERE g.person_id <> 9))) WHERE r = 1", "probes", "gallery")
def _(spark, d):
    left = spark.sql("SELECT 9 AS person_id")  # a person who is no longer active
    x = M.nearest_identity(view(spark, d, "probes"), view(spark, d, "gallery").join(left, "person_id", "left_anti"), 0.2)
    return x.withColumn("person_id", F.coalesce(F.col("person_id").cast("string"), F.lit("")))


def share_sql(a: str, b: str) -> str:
    """Intersection over union of two structs or rows."""
    w, h = (f"greatest(least({a}.{c}2, {b}.{c}2) - greatest({a}.{c}1, {b}.{c}1), 0)" for c in "xy")
    area = lambda q: f"({q}.x2 - {q}.x1) * ({q}.y2 - {q}.y1)"
    return f"(CASE WHEN {w} * {h} > 0 THEN {w} * {h} / ({area(a)} + {area(b)} - {w} * {h}) ELSE 0 END)"


@query(
    "nms_class_aware",
    f"""WITH RECURSIVE {prelude('boxes')[5:]}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, box_id) AS rn FROM boxes),
    k AS (SELECT image_id, class_id, rn, [struct_pack(id := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT k.image_id, k.class_id, o.rn, CASE WHEN len(list_filter(k.kept, lambda q: {share_sql('q', 'o')} > 0.45)) > 0 THEN k.kept ELSE list_append(k.kept, struct_pack(id := o.box_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) END FROM k JOIN o ON o.image_id = k.image_id AND o.class_id = k.class_id AND o.rn = k.rn + 1)
    SELECT unnest(kept).id AS box_id FROM (SELECT arg_max(kept, rn) AS kept FROM k GROUP BY image_id, class_id)""",
)
def _(spark, d):
    return M.suppress(view(spark, d, "boxes"), ["image_id", "class_id"], 0.45)


MATCHED = f"""p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rn FROM boxes WHERE role = 'pred'), g AS (SELECT * FROM boxes WHERE role = 'gt'),
    m AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS INT) AS class_id, CAST(NULL AS BIGINT) AS truth FROM p UNION ALL
    SELECT image_id, rn, CASE WHEN truth IS NULL THEN taken ELSE list_append(taken, truth) END, class_id, truth FROM (SELECT p.image_id, p.rn, m.taken, p.class_id,
    (SELECT arg_max(g.box_id, struct_pack(o := {share_sql('p', 'g')}, t := -g.box_id)) FROM g WHERE g.image_id = p.image_id AND g.class_id = p.class_id AND NOT list_contains(m.taken, g.box_id) AND {share_sql('p', 'g')} >= 0.5) AS truth
    FROM m JOIN p ON p.image_id = m.image_id AND p.rn = m.rn + 1))"""


@query(
    "precision_recall",
    f"""WITH RECURSIVE {prelude('boxes')[5:]}, {MATCHED}, c AS (SELECT class_id, count(truth) AS tp, count(*) - count(truth) AS fp FROM m WHERE rn > 0 GROUP BY class_id), t AS (SELECT class_id, count(*) AS truths FROM g GROUP BY class_id)
    SELECT class_id, tp, fp, truths - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN truths > 0 THEN tp / truths ELSE 0.0 END AS recall
    FROM (SELECT class_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(truths, 0) AS truths FROM c FULL JOIN t USING (class_id))""",
)
def _(spark, d):
    return M.precision_recall(view(spark, d, "boxes"))


@query(
    "precision_recall_by_domain",
    f"""WITH RECURSIVE {prelude('boxes')[5:]}, {MATCHED}, c AS (SELECT class_id, image_id % 3 AS domain, count(truth) AS tp, count(*) - count(truth) AS fp FROM m WHERE rn > 0 GROUP BY ALL), t AS (SELECT class_id, image_id % 3 AS domain, count(*) AS truths FROM g GROUP BY ALL)
    SELECT class_id, domain, tp, fp, truths - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN truths > 0 THEN tp / truths ELSE 0.0 END AS recall
    FROM (SELECT class_id, domain, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(truths, 0) AS truths FROM c FULL JOIN t USING (class_id, domain))""",
)
def _(spark, d):
    return M.precision_recall(view(spark, d, "boxes").withColumn("domain", F.col("image_id") % 3), by=["domain"])


NEAR = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END)) <= 15"


@query("near_dup_pairs", NEAR)
def _(spark, d):
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))
    return M.near_hashes(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("h")), 15)


@query("neighbour_cluster", "SELECT a.camera_id, a.tick, a.det_id, count(*) AS n FROM detections a JOIN detections b ON a.camera_id = b.camera_id AND a.tick = b.tick AND (a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) <= 14400 GROUP BY a.camera_id, a.tick, a.det_id", "detections")
def _(spark, d):
    return M.neighbours(view(spark, d, "detections"), ["camera_id", "tick"], 120.0)


@query("largest_box", "SELECT image_id, arg_max(box_id, struct_pack(a := (x2 - x1) * (y2 - y1), i := -box_id)) AS box_id FROM boxes GROUP BY image_id", "boxes")
def _(spark, d):
    a = geometry.area(*[F.col(c) for c in M.BOX])
    return view(spark, d, "boxes").groupBy("image_id").agg(F.max_by("box_id", F.struct(a, -F.col("box_id"))).alias("box_id"))


# -- datasets -------------------------------------------------------------------------------------------------------

@query("manifest_counts", "SELECT lang, source, count(DISTINCT doc_id) AS images, count(*) AS instances FROM documents GROUP BY lang, source")
def _(spark, d):
    return D.manifest(table(spark, d, "documents"), "lang", "source", "doc_id")


@query("source_attribution", "SELECT source, count(*) AS total, count(*) FILTER (n_chars < 1000) AS flagged, round(count(*) FILTER (n_chars < 1000) / count(*), 6) AS rate FROM documents GROUP BY source HAVING count(*) >= 10 AND count(*) FILTER (n_chars < 1000) > 0 ORDER BY flagged DESC, source LIMIT 15")
def _(spark, d):
    return D.attribution(table(spark, d, "documents"), "source", F.col("n_chars") < 1000, 10)


@query("confound_effect_size", "SELECT round(m0, 6) AS m0, round(m1, 6) AS m1, round(s0, 6) AS s0, round(s1, 6) AS s1, round(abs(m0 - m1) / sqrt((s0 * s0 + s1 * s1) / 2), 6) AS d, abs(m0 - m1) / sqrt((s0 * s0 + s1 * s1) / 2) > 1.2 AS separable FROM (SELECT avg(n_chars) FILTER (quality = 0) AS m0, avg(n_chars) FILTER (quality = 1) AS m1, stddev_pop(n_chars) FILTER (quality = 0) AS s0, stddev_pop(n_chars) FILTER (quality = 1) AS s1 FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    return D.effect_size(table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id"), "quality", "n_chars")


@query("share_gap", "SELECT source, round(100.0 * a / sum(a) OVER (), 6) AS share_flagged, round(100.0 * b / sum(b) OVER (), 6) AS share_other, round(100.0 * a / sum(a) OVER () - 100.0 * b / sum(b) OVER (), 6) AS gap FROM (SELECT source, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (NOT lang = 'en') AS b FROM documents GROUP BY source)")
def _(spark, d):
    return D.shares(table(spark, d, "documents"), "source", F.col("lang") == "en")


@query("shot_sampling", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def _(spark, d):
    return D.capped(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("doc_id")


@query("track_stability", "SELECT camera_id, tracks, shortest, longest, peak, round(frag, 6) AS fragments, round(tracks / peak, 6) AS churn, tracks / peak <= 3 AND frag <= 0.35 AS stable FROM (SELECT camera_id, count(*) AS tracks, min(n) AS shortest, max(n) AS longest, avg(CASE WHEN n < 8 THEN 1.0 ELSE 0.0 END) AS frag FROM (SELECT camera_id, track_id, count(*) AS n FROM detections GROUP BY camera_id, track_id) GROUP BY camera_id) JOIN (SELECT camera_id, max(k) AS peak FROM (SELECT camera_id, tick, count(DISTINCT track_id) AS k FROM detections GROUP BY camera_id, tick) GROUP BY camera_id) USING (camera_id)", "detections")
def _(spark, d):
    return D.track_stability(view(spark, d, "detections"), 8)


@query("bench_percentiles", "SELECT camera_id, n, score AS p95 FROM (SELECT camera_id, score, row_number() OVER (PARTITION BY camera_id ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY camera_id) AS n FROM detections) WHERE i = least(n - 1, CAST(floor(n * 95 / 100) AS BIGINT))", "detections")
def _(spark, d):
    return D.percentile_nearest(view(spark, d, "detections"), ["camera_id"], "score")


@query("coco_export_ids", "SELECT row_number() OVER (ORDER BY image_id, box_id) AS annotation_id, image_id, box_id, class_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area FROM boxes", "boxes")
def _(spark, d):
    return D.coco_annotations(view(spark, d, "boxes"))


@query("overlap_rate", "SELECT class_id, round(avg(CASE WHEN EXISTS (SELECT 1 FROM boxes p WHERE p.image_id = g.image_id AND p.role = 'pred' AND (g.x1 + g.x2) / 2 BETWEEN p.x1 AND p.x2 AND (g.y1 + g.y2) / 2 BETWEEN p.y1 AND p.y2) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM boxes g WHERE role = 'gt' GROUP BY class_id", "boxes")
def _(spark, d):
    b = view(spark, d, "boxes")
    g, p = b.where("role = 'gt'").alias("g"), b.where("role = 'pred'").alias("p")
    mid = lambda a, z: (F.col(f"g.{a}") + F.col(f"g.{z}")) / 2
    hit = (F.col("g.image_id") == F.col("p.image_id")) & mid("x1", "x2").between(F.col("p.x1"), F.col("p.x2")) & mid("y1", "y2").between(F.col("p.y1"), F.col("p.y2"))
    x = g.join(p, hit, "left").groupBy("g.box_id", "g.class_id").agg(F.max(F.when(F.col("p.box_id").isNotNull(), 1.0).otherwise(0.0)).alias("in_one"))
    return x.groupBy("class_id").agg(F.round(F.avg("in_one"), 6).alias("rate"))
