"""Third set of registered queries: zones with rules, validation, upkeep of dimensions, tiles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import geometry
from vigil.operators import alerts as A
from vigil.operators import datasets as D
from vigil.operators import dimensions as M
from vigil.operators import ppe as P
from vigil.operators import sequences as S
from vigil.operators import similarity as X
from vigil.operators import tracking as T
from vigil.operators import validation as V
from vigil.operators import zones as Z
from vigil.plans.catalogue import changes_sql, query, seconds, share_sql
from vigil.sources.observations import prelude, table, view
from vigil.streaming import stateful

C = F.col
HELD = "(z.classes IS NULL OR list_contains(string_split(z.classes, ','), d.klass))"
WD, SEC = "(isodow(d.ts) - 1)", "(hour(d.ts) * 3600 + minute(d.ts) * 60 + second(d.ts))"
DAYS = "list_transform(string_split(z.days, ','), lambda x: CAST(x AS INT))"
ON = f"(z.days IS NULL OR CASE WHEN z.from_s <= z.to_s THEN list_contains({DAYS}, {WD}) AND {SEC} >= z.from_s AND {SEC} < z.to_s ELSE list_contains({DAYS}, {WD}) AND {SEC} >= z.from_s OR list_contains({DAYS}, ({WD} + 6) % 7) AND {SEC} < z.to_s END)"
MEETS = f"d.camera_id = z.camera_id AND {HELD} AND {ON}"
IN = "d.fx BETWEEN z.x0 AND z.x1 AND d.fy BETWEEN z.y0 AND z.y1"
FREE = f"un AS (SELECT * FROM detections d WHERE NOT EXISTS (SELECT 1 FROM site_zones z WHERE z.ztype = 'exclusion' AND z.classes IS NOT NULL AND {MEETS} AND {IN}))"


# -- zones with cameras, classes, hours, events and directions ---------------------------------------------------------

@query("exclusion_by_rules", f"SELECT camera_id, klass, count(*) AS n FROM detections d WHERE NOT EXISTS (SELECT 1 FROM site_zones z WHERE z.ztype = 'exclusion' AND z.classes IS NOT NULL AND {MEETS} AND {IN}) GROUP BY camera_id, klass", "detections", "site_zones")
def _(spark, d):
    return Z.unmasked(view(spark, d, "detections"), view(spark, d, "site_zones")).groupBy("camera_id", "klass").agg(F.count("*").alias("n"))


SITE = changes_sql(f"(SELECT d.*, z.zone_id, z.min_frames, CASE WHEN {IN} THEN 'entry' ELSE 'exit' END AS state FROM detections d JOIN site_zones z ON {MEETS} WHERE z.ztype = 'polygon')", "camera_id, zone_id, track_id", "obs_no", "min_frames")


#: Sides of tripwires by their nearest segment, the first of equally near ones.
WIRES = f"""sg AS (SELECT z.*, i, CAST(string_split(p[i], ',')[1] AS DOUBLE) AS ax, CAST(string_split(p[i], ',')[2] AS DOUBLE) AS ay, CAST(string_split(p[i + 1], ',')[1] AS DOUBLE) AS bx, CAST(string_split(p[i + 1], ',')[2] AS DOUBLE) AS cy
 FROM (SELECT *, string_split(points, ';') AS p, unnest(range(1, len(string_split(points, ';')))) AS i FROM site_zones WHERE ztype = 'tripwire') z),
ds AS (SELECT d.det_id, d.camera_id, d.track_id, d.obs_no, z.zone_id, z.min_frames, z.i, z.ax, z.ay, z.bx, z.cy, d.fx, d.fy, greatest(0.0, least(1.0, ((d.fx - z.ax) * (z.bx - z.ax) + (d.fy - z.ay) * (z.cy - z.ay)) / ((z.bx - z.ax) * (z.bx - z.ax) + (z.cy - z.ay) * (z.cy - z.ay)))) AS t FROM detections d JOIN sg z ON {MEETS}),
nr AS (SELECT *, (fx - (ax + t * (bx - ax))) * (fx - (ax + t * (bx - ax))) + (fy - (ay + t * (cy - ay))) * (fy - (ay + t * (cy - ay))) AS dist, (bx - ax) * (fy - ay) - (cy - ay) * (fx - ax) AS c FROM ds),
sd AS (SELECT det_id, camera_id, track_id, obs_no, zone_id, min_frames, CASE WHEN c > 0 THEN 'a' WHEN c < 0 THEN 'b' END AS side FROM nr QUALIFY row_number() OVER (PARTITION BY det_id, zone_id ORDER BY dist, i) = 1)"""
CROSSED = changes_sql("(SELECT *, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY camera_id, zone_id, track_id ORDER BY obs_no ROWS UNBOUNDED PRECEDING), 'a') AS state FROM sd)", "camera_id, zone_id, track_id", "obs_no", "min_frames")


@query(
    "event_direction_filter",
    f""", {WIRES} SELECT e.det_id, e.camera_id, e.zone_id, e.track_id, e.kind, z.severity FROM (SELECT det_id, camera_id, zone_id, track_id, state AS kind FROM ({SITE}) UNION ALL SELECT det_id, camera_id, zone_id, track_id, CASE state WHEN 'b' THEN 'entry' ELSE 'exit' END FROM ({CROSSED})) e JOIN site_zones z ON z.zone_id = e.zone_id
    WHERE (z.ztype <> 'tripwire' OR z.direction IS NULL OR z.direction = 'both' OR z.direction = 'a_to_b' AND e.kind = 'entry' OR z.direction = 'b_to_a' AND e.kind = 'exit') AND (z.events IS NULL OR list_contains(string_split(z.events, ','), e.kind))""",
    "detections", "site_zones",
)
def _(spark, d):
    zones = view(spark, d, "site_zones")
    x, columns = view(spark, d, "detections"), ["det_id", "camera_id", "zone_id", "track_id", "kind", "severity"]
    return Z.reported(Z.boundary_events(x, zones).select(columns).unionByName(Z.tripwire_zone_events(x, zones).select(columns)), zones).select(columns)


@query("tripwire_zone_events", f", {WIRES} SELECT det_id, camera_id, zone_id, track_id, CASE state WHEN 'b' THEN 'entry' ELSE 'exit' END AS kind FROM ({CROSSED})", "detections", "site_zones")
def _(spark, d):
    return Z.tripwire_zone_events(view(spark, d, "detections"), view(spark, d, "site_zones")).drop("severity")


CROWDED = """cz AS (SELECT z.*, t.crowd_threshold, t.crowd_min_frames FROM site_zones z JOIN (VALUES ('yard', 3, 2), ('dock', 4, NULL), ('night', 2, 1)) AS t(zone_id, crowd_threshold, crowd_min_frames) ON t.zone_id = z.zone_id)"""


@query(
    "zone_crowd_events",
    f"""WITH RECURSIVE {prelude('detections', 'site_zones')[5:]}, {CROWDED},
    hr AS (SELECT camera_id, tick, min(ts) AS ts, 'any' AS klass FROM detections GROUP BY camera_id, tick),
    tk AS (SELECT d.camera_id, d.tick, z.zone_id, z.crowd_threshold, coalesce(z.crowd_min_frames, 4) AS need FROM hr d JOIN cz z ON d.camera_id = z.camera_id AND {ON}),
    pt AS (SELECT d.camera_id, z.zone_id, d.tick, d.det_id, d.fx, d.fy FROM detections d JOIN cz z ON {MEETS} AND {IN}),
    pr AS (SELECT a.camera_id, a.zone_id, a.tick, a.det_id AS a, b.det_id AS b FROM pt a JOIN pt b ON a.camera_id = b.camera_id AND a.zone_id = b.zone_id AND a.tick = b.tick AND (a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) <= 22500),
    rc AS (SELECT * FROM pr UNION SELECT rc.camera_id, rc.zone_id, rc.tick, rc.a, pr.b FROM rc JOIN pr ON pr.camera_id = rc.camera_id AND pr.zone_id = rc.zone_id AND pr.tick = rc.tick AND pr.a = rc.b),
    sz AS (SELECT camera_id, zone_id, tick, max(k) AS size FROM (SELECT camera_id, zone_id, tick, a, count(*) AS k FROM rc GROUP BY camera_id, zone_id, tick, a) WHERE k >= 2 GROUP BY camera_id, zone_id, tick),
    st AS (SELECT tk.camera_id, tk.zone_id, tk.tick, tk.need, coalesce(sz.size, 0) AS size, CASE WHEN coalesce(sz.size, 0) >= crowd_threshold THEN 'formed' ELSE 'dispersed' END AS state FROM tk LEFT JOIN sz ON sz.camera_id = tk.camera_id AND sz.zone_id = tk.zone_id AND sz.tick = tk.tick)
    SELECT camera_id, zone_id, tick, state AS kind, CAST(size AS BIGINT) AS cluster_size FROM ({changes_sql('st', 'camera_id, zone_id', 'tick', 'need', "'dispersed'")})""",
)
def _(spark, d):
    limits = spark.sql("SELECT * FROM (VALUES ('yard', 3, 2), ('dock', 4, NULL), ('night', 2, 1)) AS t(zone_id, crowd_threshold, crowd_min_frames)")
    zones = view(spark, d, "site_zones").join(limits, "zone_id", "left")
    return Z.zone_crowd_events(view(spark, d, "detections"), zones, 150.0)


@query(
    "ppe_violations_by_zone",
    """, ck AS (SELECT d.camera_id, z.zone_id, d.track_id, i.item, d.det_id AS check_no, CASE WHEN (d.score * 100 + i.k) % 100 >= 65 THEN 'present' WHEN (d.score * 100 + i.k) % 100 <= 55 THEN 'absent' ELSE 'unclear' END AS state
     FROM detections d JOIN zones z ON z.camera_id = d.camera_id AND z.ztype = 'polygon' CROSS JOIN (VALUES ('helmet', 0), ('vest', 40)) AS i(item, k)),
    lf AS (SELECT *, sum(CASE WHEN check_no - prev > 3001 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, zone_id, track_id, item ORDER BY check_no) AS life FROM (SELECT *, lag(check_no) OVER (PARTITION BY camera_id, zone_id, track_id, item ORDER BY check_no) AS prev FROM ck)),
    sn AS (SELECT *, sum(CASE WHEN state = 'present' THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, zone_id, track_id, item, life ORDER BY check_no) AS seen FROM lf WHERE state <> 'unclear')
    SELECT camera_id, zone_id, track_id, item, check_no FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, zone_id, track_id, item, life, seen ORDER BY check_no) AS age FROM sn WHERE state = 'absent') WHERE age = 3""",
    "detections", "zones",
)
def _(spark, d):
    """Two items of every person in every zone; a camera's checks are numbered by its detections."""
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(k).alias("k")) for i, k in (("helmet", 0), ("vest", 40))]))
    x = Z.membership(view(spark, d, "detections"), view(spark, d, "zones").where("ztype = 'polygon'")).select("*", items.alias("i"))
    clear = (C("score") * 100 + C("i.k")) % 100
    state = F.when(clear >= 65, "present").when(clear <= 55, "absent").otherwise("unclear")
    return P.violations(x.select("camera_id", "zone_id", "track_id", "i.item", C("det_id").alias("check_no"), state.alias("state")), 3, 3000)


FIRE = f"""{FREE}, fd AS (SELECT d.det_id, d.camera_id, d.tick, d.klass, d.score, arg_min(z.zone_id, z.zone_order) AS roi, CAST(0.45 AS DOUBLE) + coalesce(greatest(least(min(z.conf_delta), 0), -0.5), 0) AS bar
 FROM un d LEFT JOIN site_zones z ON z.ztype = 'fire_roi' AND {MEETS} AND {IN} WHERE d.klass IN ('fire', 'smoke') GROUP BY d.det_id, d.camera_id, d.tick, d.klass, d.score)"""


@query(
    "fire_full_composition",
    f""", {FIRE} SELECT camera_id, tick, klass, arg_max(det_id, score * 1e9 - det_id) AS det_id, arg_max(coalesce(roi, ''), score * 1e9 - det_id) AS roi, max(score) AS score FROM fd WHERE score >= bar GROUP BY camera_id, tick, klass""",
    "detections", "site_zones",
)
def _(spark, d):
    x = Z.fire_decisions(view(spark, d, "detections"), view(spark, d, "site_zones"), 0.45).where("verdict = 'accepted'")
    best = F.max_by(F.struct("det_id", "roi", "score"), F.struct("score", -C("det_id"))).alias("b")
    return x.groupBy("camera_id", "tick", "klass").agg(best).select("camera_id", "tick", "klass", "b.det_id", F.coalesce("b.roi", F.lit("")).alias("roi"), "b.score")


@query(
    "fire_near_misses",
    f", {FIRE} SELECT camera_id, klass, count(*) FILTER (score >= bar) AS accepted, count(*) FILTER (score < bar AND score >= bar - 0.1e0) AS near_miss, count(*) FILTER (score < bar - 0.1e0) AS below FROM fd GROUP BY camera_id, klass",
    "detections", "site_zones",
)
def _(spark, d):
    x = Z.fire_decisions(view(spark, d, "detections"), view(spark, d, "site_zones"), 0.45)
    n = lambda v: F.count_if(C("verdict") == v).alias(v)
    return x.groupBy("camera_id", "klass").agg(n("accepted"), n("near_miss"), n("below"))


@query("event_box_join", "SELECT a.alert_id, d.fx - 20 AS x1, d.fy AS y2 FROM alerts a JOIN detections d ON d.camera_id = a.camera_id AND d.track_id = a.track_id AND d.ts = a.ts WHERE a.kind = 'boundary'", "alerts", "detections")
def _(spark, d):
    a, b = view(spark, d, "alerts").where("kind = 'boundary'"), view(spark, d, "detections")
    return a.join(b, ["camera_id", "track_id", "ts"]).select("alert_id", (C("fx") - 20).alias("x1"), C("fy").alias("y2"))


@query("confirmed_tracks", "SELECT det_id FROM (SELECT det_id, CASE WHEN obs_no < 3 THEN -1 ELSE track_id END AS t FROM detections) WHERE t >= 0", "detections")
def _(spark, d):
    return T.confirmed(view(spark, d, "detections").withColumn("track_id", F.when(C("obs_no") < 3, -1).otherwise(C("track_id")))).select("det_id")


@query("track_labels", "SELECT det_id, CASE WHEN m THEN 'MASKED' WHEN small THEN 'SMALL' ELSE '#' || track_id END AS label FROM (SELECT det_id, track_id, camera_id = 'cam_01' AND klass = 'person' AND fx BETWEEN 500 AND 900 AND fy BETWEEN 500 AND 900 AS m, fy < 100 AS small FROM detections WHERE camera_id IN ('cam_01', 'cam_02'))", "detections")
def _(spark, d):
    x = view(spark, d, "detections").where("camera_id IN ('cam_01', 'cam_02')")
    clear = Z.unmasked(x, view(spark, d, "site_zones")).select("det_id", F.lit(False).alias("no"))
    y = x.join(clear, "det_id", "left")
    return y.select("det_id", T.label(C("no").isNull(), C("fy") < 100, C("track_id")).alias("label"))


@query(
    "zone_documents",
    """, z AS (SELECT camera_id || '_' || klass AS zone_id, min(fx) / 1000 AS x0, min(fy) / 1000 AS y0, max(fx) / 1000 AS x1, max(fy) / 1000 AS y1, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) % 5 AS INT) END AS m FROM detections WHERE score >= 0.9 GROUP BY camera_id, klass)
    SELECT zone_id, '{"id":"' || zone_id || '","type":"polygon","points":[[' || round(x0, 5) || ',' || round(y0, 5) || '],[' || round(x1, 5) || ',' || round(y0, 5) || '],[' || round(x1, 5) || ',' || round(y1, 5) || '],[' || round(x0, 5) || ',' || round(y1, 5) || ']]' || CASE WHEN m IS NULL THEN '' ELSE ',"min_frames":' || m END || '}' AS doc FROM z""",
    "detections",
)
def _(spark, d):
    """A zone around the sure detections of each class and camera."""
    x = view(spark, d, "detections").where("score >= 0.9").groupBy("camera_id", "klass").agg(F.min("fx").alias("x0"), F.min("fy").alias("y0"), F.max("fx").alias("x1"), F.max("fy").alias("y1"), F.count("*").alias("n"))
    x = x.select(F.concat_ws("_", "camera_id", "klass").alias("zone_id"), F.lit("polygon").alias("ztype"), "x0", "y0", "x1", "y1", F.when(C("n") % 2 == 0, (C("n") % 5).cast("int")).alias("min_frames"), F.lit("both").alias("direction"))
    return Z.documents(x, 1000.0)


# -- validation --------------------------------------------------------------------------------------------------------

#: Parts of zone documents by a number of their own, of which any may be wrong at once.
ZONE_PARTS = """p_partkey AS n, CASE WHEN p_partkey % 23 = 7 THEN '  ' WHEN p_partkey % 29 = 3 THEN 'same' ELSE 'z' || CAST(p_partkey AS VARCHAR) END AS id,
 CASE p_partkey % 8 WHEN 0 THEN 'circle' WHEN 1 THEN ' Exclusion' WHEN 2 THEN 'fire_roi' WHEN 3 THEN NULL ELSE 'polygon' END AS type, CASE WHEN p_size % 9 = 0 THEN 'urgent' WHEN p_size % 9 < 5 THEN 'HIGH' END AS severity,
 CASE p_partkey % 11 WHEN 0 THEN 'in' WHEN 1 THEN 'a_to_b' END AS direction, CASE p_size % 7 WHEN 0 THEN 'entry,jump' WHEN 1 THEN 'Exit' END AS events, CASE p_partkey % 9 WHEN 2 THEN 'person,cat' WHEN 3 THEN 'Fire' END AS detect,
 CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS min_frames, CASE p_size % 5 WHEN 0 THEN 'person,dust' WHEN 1 THEN 'smoke' END AS applies_to, CASE p_partkey % 12 WHEN 0 THEN 'Monday,fri' WHEN 1 THEN 'mon,noday' END AS days,
 CASE p_size % 11 WHEN 0 THEN '22:00' WHEN 1 THEN '8:61' WHEN 2 THEN '07:30' WHEN 3 THEN '06:00' END AS start, CASE p_size % 11 WHEN 0 THEN '06:00' WHEN 1 THEN '10:00' WHEN 2 THEN '07:30:00' END AS stop,
 CASE p_partkey % 13 WHEN 0 THEN 0 WHEN 1 THEN 5 END AS crowd_threshold, CASE p_partkey % 17 WHEN 0 THEN -1 END AS crowd_min_frames, CASE p_partkey % 10 WHEN 4 THEN 'helmet,hat' WHEN 5 THEN 'Vest' END AS ppe_required"""
NOT_IN = lambda c, allowed: f"len(list_filter(string_split({c}, ','), lambda x: NOT list_contains({list(allowed)}, lower(trim(x))))) > 0"


@query(
    "zone_validation",
    f"""WITH z AS (SELECT {ZONE_PARTS}, p_partkey % 15 AS shape FROM part), k AS (SELECT *, coalesce(lower(trim(type)), 'polygon') AS kind, count(*) OVER (PARTITION BY id) AS same FROM z)
    SELECT n, concat_ws('; ', CASE WHEN trim(id) = '' THEN 'no id' END, CASE WHEN kind NOT IN ('polygon', 'exclusion', 'fire_roi') THEN 'unknown type' END, CASE WHEN severity = 'urgent' THEN 'unknown severity' END, CASE WHEN direction = 'in' THEN 'unknown direction' END,
     CASE WHEN {NOT_IN('events', V.EVENTS)} THEN 'unknown event' END, CASE WHEN {NOT_IN('detect', V.CLASSES)} THEN 'unknown class to detect' END, CASE WHEN min_frames < 1 THEN 'min_frames below 1' END, CASE WHEN {NOT_IN('applies_to', V.CLASSES)} THEN 'unknown class to apply to' END,
     CASE WHEN kind IN ('exclusion', 'fire_roi') AND applies_to IS NULL THEN 'applies to nothing' END, CASE WHEN crowd_threshold < 1 THEN 'crowd_threshold below 1' END, CASE WHEN crowd_min_frames < 1 THEN 'crowd_min_frames below 1' END, CASE WHEN {NOT_IN('ppe_required', V.ITEMS)} THEN 'unknown item' END,
     CASE WHEN days = 'mon,noday' THEN 'unknown day' END, CASE WHEN start = '06:00' THEN 'one of two times' END, CASE WHEN start = '8:61' THEN 'bad time' END, CASE WHEN start = '07:30' THEN 'times are the same' END,
     CASE shape WHEN 1 THEN 'no points' WHEN 2 THEN 'crosses itself; no area' WHEN 3 THEN 'outside 0 to 1' END, CASE WHEN same > 1 THEN 'duplicate id' END) AS errors FROM k""",
)
def _(spark, d):
    """Documents with any of their parts wrong, several at once; a doubled point is no fault."""
    pts = lambda *p: geometry.polygon(list(p))
    k = C("p_partkey") % 15
    shape = F.when(k == 1, None).when(k == 2, pts((0, 0), (1, 1), (1, 0), (0, 1))).when(k == 3, pts((0, 0), (2, 0), (0, 1))).when(k == 4, pts((0, 0), (0, 0), (1, 0), (1, 1), (0, 1))).otherwise(pts((0, 0), (1, 0), (1, 1), (0, 1)))
    x = spark.sql("SELECT p_partkey, " + ZONE_PARTS.replace("VARCHAR", "STRING") + " FROM {source}", source=table(spark, d, "part")).withColumn("points", shape)
    listed = lambda c: F.split(c, ",").alias(c)
    z = F.struct("id", "type", "points", "severity", "direction", listed("events"), listed("detect"), "min_frames", listed("applies_to"), listed("days"), C("start").alias("from"), C("stop").alias("to"), "crowd_threshold", "crowd_min_frames", listed("ppe_required"))
    y = V.checked(x.select("n", "id", z.alias("z")), "id", V.zone_errors("z"))
    return y.select("n", F.concat_ws("; ", "errors").alias("errors"))


@query("zones_keep_last_good", "SELECT p_partkey, p_brand, v FROM (SELECT *, max(v) FILTER (ok) OVER (PARTITION BY p_brand) AS newest FROM (SELECT p_partkey, p_brand, p_size % 5 AS v, bool_and(p_size % 35 <> 4) OVER (PARTITION BY p_brand, p_size % 5) AS ok FROM part)) WHERE v = newest")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_brand", (C("p_size") % 5).alias("v"), V.messages((C("p_size") % 35 == 4, "bad")).alias("errors"))
    return V.last_good(x, "p_brand", "v").select("p_partkey", "p_brand", "v")


@query(
    "config_validation",
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 5 = 1 THEN 'bad id' END, CASE WHEN c_custkey % 7 = 2 THEN 'no source' END, CASE WHEN c_acctbal <= 0 THEN 'fps not above 0' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown module' END) AS camera,
    concat_ws('; ', CASE WHEN c_custkey % 13 = 0 THEN 'unknown type' END, CASE WHEN c_custkey % 6 = 0 THEN 'unknown severity' END, CASE WHEN c_custkey % 10 = 3 THEN 'cooldown is no number' END, CASE WHEN c_custkey % 10 = 4 OR c_custkey % 10 > 4 AND c_acctbal < 0 THEN 'cooldown out of range' END,
     CASE WHEN c_custkey % 4 = 0 THEN 'no recipient' END, CASE WHEN c_custkey % 4 = 1 THEN 'bad recipient' END, CASE WHEN c_custkey % 7 = 5 THEN 'unknown kind' END) AS rule,
    concat_ws('; ', CASE WHEN c_custkey % 9 = 4 THEN 'bad name' END, CASE WHEN c_custkey % 8 = 3 THEN 'unknown role' END, CASE WHEN c_custkey % 3 = 0 THEN 'short password' END) AS account FROM customer""",
)
def _(spark, d):
    n = C("c_custkey")
    x = table(spark, d, "customer")
    modules = F.array(F.when(C("c_mktsegment") == "MACHINERY", "laser").otherwise("crowd"))
    camera = V.camera_errors(F.when(n % 5 == 1, "Bad Id").otherwise(F.concat(F.lit("cam_"), n.cast("string"))), F.when(n % 7 == 2, "  ").otherwise("rtsp://x"), C("c_acctbal"), modules, ("boundary", "crowd", "ppe", "fire"))
    to = F.when(n % 4 == 0, F.array(F.lit(" "))).when(n % 4 == 1, F.array(F.lit("a@b.example"), F.lit("b@c.example,d@e.example"))).otherwise(F.array(F.lit("a@b.example")))
    wait = F.when(n % 10 == 3, "soon").when(n % 10 == 4, "604801").when(n % 10 > 4, C("c_acctbal").cast("string")).when(n % 10 == 2, "604800")
    kinds = F.when(n % 7 == 5, F.array(F.lit("fire"), F.lit("flood"))).when(n % 7 == 6, F.array(F.lit(" Crowd "), F.lit("")))
    x = x.withColumn("rule", F.struct(F.when(n % 13 == 0, "pager").otherwise("SMTP").alias("type"), F.when(n % 6 == 0, "loud").when(n % 6 == 1, "Low").alias("min_severity"), wait.alias("cooldown_seconds"), to.alias("to"), kinds.alias("kinds")))
    rule = V.rule_errors("rule")
    user = V.user_errors(F.when(n % 9 == 4, "x").otherwise(C("c_name")), F.when(n % 8 == 3, "guest").otherwise("viewer"), F.when(n % 3 == 0, "short").otherwise("long enough"))
    return x.select("c_custkey", *[F.concat_ws("; ", e).alias(a) for e, a in ((camera, "camera"), (rule, "rule"), (user, "account"))])


@query("module_implication", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'boundary,crowd' WHEN 'BUILDING' THEN 'boundary,fire,ppe' ELSE 'fire' END AS modules FROM customer")
def _(spark, d):
    chosen = F.when(C("c_mktsegment") == "MACHINERY", F.array(F.lit("crowd"))).when(C("c_mktsegment") == "BUILDING", F.array(F.lit("ppe"), F.lit("fire"))).otherwise(F.array(F.lit("fire")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(V.with_implied(chosen), ",").alias("modules"))


# -- upkeep of dimensions ----------------------------------------------------------------------------------------------

@query("camera_registry", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("draft").alias("c_mktsegment"), F.lit(1).alias("_seq"), F.lit(False).alias("_removed"))
    second = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("changed").alias("c_mktsegment"), F.lit(2).alias("_seq"), F.lit(False).alias("_removed"))
    third = c.where("c_custkey % 10 = 0").select("c_custkey", "c_mktsegment", F.lit(3).alias("_seq"), F.lit(True).alias("_removed"))
    return M.upsert(c, first.unionByName(second).unionByName(third), "c_custkey")


@query("camera_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _(spark, d):
    return M.cascade(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal >= 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("person_enrolment", "SELECT person_id, count(*) AS n FROM (SELECT label AS person_id FROM embeddings WHERE label NOT IN (2, 3, 5) UNION ALL SELECT 5 FROM range(0, 5) UNION ALL SELECT label FROM embeddings WHERE label = 3) GROUP BY person_id")
def _(spark, d):
    """Person 5 enrols with the five poses, person 3 with four and one twice, and person 2 is deleted."""
    old = table(spark, d, "embeddings").select(C("label").cast("long").alias("person_id"), F.lit("front").alias("pose"))
    poses = [(5, p) for p in M.POSES] + [(3, p) for p in ("front", "front", "left", "right", "up")]
    new = spark.sql("SELECT * FROM (VALUES " + ", ".join(f"({i}L, '{p}')" for i, p in poses) + ") AS p(person_id, pose)")
    return M.gallery_after(old, new, spark.sql("SELECT 2L AS person_id")).groupBy("person_id").agg(F.count("*").alias("n"))


@query("partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_acctbal > 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'secret' ELSE c_name END AS c_name FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(C("c_acctbal") > 0, "NEW").alias("c_mktsegment"), F.when(C("c_custkey") % 3 == 0, "secret").otherwise("  ").alias("c_name"))
    return M.merged(c, new, "c_custkey", ["c_mktsegment"], ["c_name"])


@query("settings_precedence", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'env' WHEN c_custkey % 3 = 0 THEN 'file' WHEN c_custkey % 5 = 0 THEN 'site' ELSE 'default' END AS value FROM customer")
def _(spark, d):
    given = lambda n, v: F.when(C("c_custkey") % n == 0, v).otherwise("")
    return table(spark, d, "customer").select("c_custkey", M.setting(given(2, "env"), given(3, "file"), F.when(C("c_custkey") % 5 == 0, "site"), F.lit("default")).alias("value"))


@query("event_camera_names", "SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey")
def _(spark, d):
    names = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(C("c_custkey").alias("o_custkey"), "c_name")
    return M.with_names(table(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "c_name").select("o_orderkey", "c_name")


@query("camera_health", "SELECT camera_id, CASE WHEN l IS NULL THEN 'down' WHEN epoch(TIMESTAMP '2024-01-30') - epoch(l) > 36000 THEN 'stale' ELSE 'up' END AS status FROM (SELECT 'cam_0' || unnest(range(1, 7)) AS camera_id) LEFT JOIN (SELECT camera_id, max(ts) AS l FROM detections WHERE ts < TIMESTAMP '2024-01-30' AND (camera_id <> 'cam_02' OR ts < TIMESTAMP '2024-01-20') GROUP BY camera_id) USING (camera_id)", "detections")
def _(spark, d):
    cameras = spark.range(1, 7).select(F.concat(F.lit("cam_0"), C("id").cast("string")).alias("camera_id"))
    x = view(spark, d, "detections").where("ts < TIMESTAMP_NTZ '2024-01-30' AND (camera_id <> 'cam_02' OR ts < TIMESTAMP_NTZ '2024-01-20')")
    return M.health(cameras, x.groupBy("camera_id").agg(F.max("ts").alias("last_ts")), 36000, F.lit("2024-01-30").cast("timestamp_ntz"))


@query("upload_listing", "SELECT 'upload_' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 ORDER BY o_orderdate DESC, name LIMIT 50")
def _(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    good = F.format_string('{"name": "upload_%d", "uploaded_at": "%s"}', C("o_orderkey"), stamp)
    json = F.when(C("o_orderkey") % 7 == 0, F.lit('{"name": "broken')).when(C("o_orderkey") % 11 == 0, F.lit('{"name": "no date"}')).otherwise(good)
    return M.uploads(table(spark, d, "orders").select(json.alias("json"))).limit(50).select("name", F.date_format("uploaded_at", "yyyy-MM-dd").alias("day"))


@query("upload_expiry", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def _(spark, d):
    return A.expired(table(spark, d, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 30).select("o_orderkey")


@query("split_discovery", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'train' WHEN page_id % 5 IN (1, 2) THEN 'val' WHEN page_id % 5 = 3 THEN 'test' ELSE 'all' END AS split, 'img.' || page_id AS stem FROM pages")
def _(spark, d):
    n = C("page_id") % 5
    folder = F.when(n == 0, "data/train/images/").when(n == 1, "data/valid/").when(n == 2, "val/").when(n == 3, "x/test/").otherwise("data/training/")
    x = table(spark, d, "pages").select("page_id", F.concat(folder, F.lit("img."), C("page_id").cast("string"), F.lit(".jpg")).alias("path"))
    return x.select("page_id", M.split_of(C("path")).alias("split"), M.stem(C("path")).alias("stem"))


@query("label_image_join", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 <> 1")
def _(spark, d):
    n = C("doc_id")
    path = lambda folder, ext: F.concat(F.when(n % 2 == 0, f"train/{folder}/").otherwise(f"valid/{folder}/"), n.cast("string"), F.lit(ext))
    images = table(spark, d, "documents").select("doc_id", path("images", ".jpg").alias("path"))
    marks = table(spark, d, "labels").select("quality", F.when(n % 4 == 1, F.regexp_replace(path("labels", ".txt"), "valid", "test")).otherwise(path("labels", ".txt")).alias("label_path"))
    return D.labelled(images, marks, "path", "label_path").select("doc_id", "quality")


@query("filename_order", "SELECT name, CAST(row_number() OVER (ORDER BY n IS NULL, n, name) AS INT) AS place FROM (SELECT name, CAST(nullif(regexp_extract(name, '([0-9]+)', 1), '') AS BIGINT) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, ' ', '_') || chr(CAST(97 + p_partkey % 26 AS INT)) ELSE 'frame' || (p_partkey * 7919 % 1000) || '_' || p_brand END AS name FROM part) GROUP BY name)")
def _(spark, d):
    n = C("p_partkey")
    name = F.when(n % 9 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.char(97 + n % 26))).otherwise(F.concat(F.lit("frame"), (n * 7919 % 1000).cast("string"), F.lit("_"), C("p_brand")))
    x = table(spark, d, "part").select(name.alias("name")).distinct()
    return D.file_places(x, "name", F.nullif(F.regexp_extract("name", "([0-9]+)", 1), F.lit("")).cast("long"))


#: File names as they come: with a hash, without, in capitals, with a short hash, with digits first.
NAMES = """CASE page_id % 7 WHEN 0 THEN 'shop-' || page_id || '_jpg.rf.' || md5(CAST(page_id AS VARCHAR)) || '.jpg' WHEN 1 THEN 'shop' || page_id || '.png' WHEN 2 THEN '0' || page_id || '.JPG' WHEN 3 THEN 'Yard_' || page_id || '_JPG.jpg'
 WHEN 4 THEN 'gate-' || page_id || '.RF.' || upper(md5(CAST(page_id AS VARCHAR))) || '.jpg' WHEN 5 THEN 'a/frame-' || page_id || '.rf.0a1b.jpg' ELSE 'b/lane' || page_id END"""


@query(
    "family_keys",
    f"""SELECT page_id, plain, regexp_replace(plain, '[-_][0-9]+$', '') AS fine, coalesce(nullif(regexp_extract(plain, '^[A-Za-z]+[0-9]+'), ''), plain) AS token, coalesce(nullif(regexp_extract(plain, '^[A-Za-z]+'), ''), plain) AS coarse FROM
    (SELECT page_id, regexp_replace(regexp_replace(parse_filename(name, true), '_jpg$', '', 'i'), '\\.rf\\.[0-9a-f]{{16,}}$', '', 'i') AS plain FROM (SELECT page_id, {NAMES} AS name FROM pages))""",
)
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", F.expr(NAMES.replace("VARCHAR", "STRING")).alias("name"))
    return x.select("page_id", *[k.alias(n) for k, n in zip(D.family_keys(C("name")), ("plain", "fine", "token", "coarse"), strict=True)])


@query("event_time_coercion", "SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC' ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(spark, d):
    given = F.when(C("event_id") % 2 == 0, (C("event_id") + 1700000000).cast("double"))
    return table(spark, d, "events").select("event_id", F.date_format(M.utc(given, C("ts")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("row_projection", "SELECT page_id, 'rtsp://***@cam.example/' || page_id || CASE WHEN page_id % 2 = 0 THEN '?***' ELSE '' END AS url FROM pages")
def _(spark, d):
    n = C("page_id")
    url = F.concat(F.lit("rtsp://admin:pa:ss@cam.example/"), n.cast("string"), F.when(n % 2 == 0, "?token=abc").otherwise(""))
    return table(spark, d, "pages").withColumns({"url": url, "password": F.lit("secret")}).withColumn("url", M.redacted(C("url"))).drop("password", "html")


# -- tiles, totals and reports -----------------------------------------------------------------------------------------

@query("dashboard_tiles", "SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS today, count(*) FILTER (kind = 'boundary') AS boundary, count(*) FILTER (kind IN ('fire', 'smoke')) AS fire, count(*) AS total, count(*) FILTER (identity_status = 'known') AS recognised, count(*) FILTER (identity_status = 'unknown_face') AS unrecognised FROM alerts", "alerts")
def _(spark, d):
    return A.tiles(view(spark, d, "alerts"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("evidence_present", "SELECT alert_id FROM alerts WHERE alert_id % 3 = 0 OR alert_id % 5 = 0", "alerts")
def _(spark, d):
    x = view(spark, d, "alerts").select("alert_id", F.when(C("alert_id") % 3 == 0, "a.mp4").alias("clip"), F.when(C("alert_id") % 5 == 0, "a.jpg").alias("snapshot"))
    return A.with_evidence(x, ["clip", "snapshot"]).select("alert_id")


@query("alert_dedup_by_text", "SELECT min(alert_id) AS alert_id FROM (SELECT alert_id, date_trunc('hour', ts) AS h, kind, camera_id FROM alerts) GROUP BY h, kind, camera_id", "alerts")
def _(spark, d):
    x = view(spark, d, "alerts").select("alert_id", F.date_trunc("hour", "ts").alias("ts"), "kind", C("camera_id").alias("message"))
    return A.seen_once(x, ["ts", "kind", "message"], "alert_id").select("alert_id")


@query("incremental_cursor", "SELECT alert_id, kind FROM (SELECT alert_id, kind, row_number() OVER (PARTITION BY alert_id ORDER BY kind) AS r FROM (SELECT alert_id, kind FROM alerts UNION ALL SELECT alert_id, kind FROM alerts WHERE alert_id % 4 = 0) WHERE alert_id >= 100) WHERE r = 1", "alerts")
def _(spark, d):
    x = view(spark, d, "alerts").select("alert_id", "kind")
    return A.since(x.unionByName(x.where("alert_id % 4 = 0")), "alert_id", 100)


@query("overlay_ttl", "SELECT det_id, coalesce(tick - last_value(CASE WHEN score >= 0.9 THEN tick END IGNORE NULLS) OVER (PARTITION BY camera_id, track_id ORDER BY obs_no ROWS UNBOUNDED PRECEDING) <= 24, FALSE) AS marked FROM detections", "detections")
def _(spark, d):
    return S.marked(view(spark, d, "detections"), ["camera_id", "track_id"], ["obs_no"], C("score") >= 0.9, "tick", 24).select("det_id", "marked")


@query("clip_fps", "SELECT track_id, CASE WHEN n < 2 THEN NULL WHEN span <= 0 THEN 10.0 ELSE round((n - 1) / span, 6) END AS fps FROM (SELECT track_id, count(*) AS n, CAST(epoch(max(ts)) AS DOUBLE) - CAST(epoch(min(ts)) AS DOUBLE) AS span FROM detections GROUP BY track_id)", "detections")
def _(spark, d):
    x = view(spark, d, "detections").groupBy("track_id").agg(F.count("*").alias("n"), (F.max(seconds("ts")) - F.min(seconds("ts"))).alias("span"))
    return x.select("track_id", F.round(S.clip_rate(C("n"), C("span")), 6).alias("fps"))


@query("cadence_by_module", "SELECT obs_no % 2 = 0 AS person, obs_no % 5 = 3 AS fire, obs_no % 2 = 0 AND (obs_no // 2) % 3 = 0 AS ppe, count(*) AS n FROM detections GROUP BY ALL", "detections")
def _(spark, d):
    due = S.cadence(C("obs_no"), 2, 5, 3, 3)
    return view(spark, d, "detections").select(*[c.alias(n) for n, c in due.items()]).groupBy("person", "fire", "ppe").agg(F.count("*").alias("n"))


@query("ring_buffer", "SELECT det_id, count(*) OVER (PARTITION BY camera_id ORDER BY epoch(ts) RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS held FROM detections", "detections")
def _(spark, d):
    return S.held(view(spark, d, "detections").withColumn("at", seconds("ts")), ["camera_id"], "at", 7200.0).select("det_id", "held")


@query("clip_ring_join", "SELECT a.alert_id, count(d.det_id) AS frames FROM (SELECT * FROM alerts WHERE kind = 'fire') a LEFT JOIN detections d ON d.camera_id = a.camera_id AND epoch(d.ts) BETWEEN epoch(a.ts) + 1800 - 5400 AND epoch(a.ts) + 1800 GROUP BY a.alert_id", "alerts", "detections")
def _(spark, d):
    return A.clip_counts(view(spark, d, "alerts").where("kind = 'fire'"), view(spark, d, "detections"), 5400, 1800)


@query("track_report", "SELECT camera_id, tracks, median_len, round(mean_at_once, 6) AS mean_at_once FROM (SELECT camera_id, count(*) AS tracks, median(n) AS median_len FROM (SELECT camera_id, track_id, count(*) AS n FROM detections GROUP BY ALL) GROUP BY camera_id) JOIN (SELECT camera_id, avg(k) AS mean_at_once FROM (SELECT camera_id, tick, count(DISTINCT track_id) AS k FROM detections GROUP BY ALL) GROUP BY camera_id) USING (camera_id)", "detections")
def _(spark, d):
    return D.track_report(view(spark, d, "detections"))


@query("bench_report", "SELECT camera_id, median(score) AS median, round(count(*) / sum(score), 6) AS fps FROM detections GROUP BY camera_id", "detections")
def _(spark, d):
    return D.bench_report(view(spark, d, "detections"), ["camera_id"], "score")


@query("manifest_with_gaps", "SELECT k.lang, s.source, count(DISTINCT doc_id) AS images, count(doc_id) AS instances FROM (SELECT unnest(['en', 'xx', 'de']) AS lang) k CROSS JOIN (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.lang = k.lang AND d.source IS NOT DISTINCT FROM s.source GROUP BY k.lang, s.source")
def _(spark, d):
    x = table(spark, d, "documents")
    names = spark.sql("SELECT * FROM (VALUES ('en'), ('xx'), ('de')) AS t(lang)")
    return D.manifest_of(x, names, "lang", "source", "doc_id")


@query("attribution_top_share", "SELECT round(sum(f) FILTER (r <= 5) / sum(f), 6) AS top5_share FROM (SELECT source, count(*) FILTER (n_chars < 1000) AS f, row_number() OVER (ORDER BY count(*) FILTER (n_chars < 1000) DESC, source) AS r FROM documents GROUP BY source)")
def _(spark, d):
    return D.top_share(table(spark, d, "documents").where("n_chars < 1000"), "source", 5).select(F.round("top_share", 6).alias("top5_share"))


@query("confound_modes", "SELECT n_chars // 500 AS bucket, count(*) AS n FROM documents GROUP BY bucket ORDER BY n DESC, bucket LIMIT 3")
def _(spark, d):
    return D.modes(table(spark, d, "documents").select(F.floor(C("n_chars") / 500).alias("bucket")), "bucket", 3)


@query("confound_spread", "SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, count(DISTINCT n_chars) AS distinct FROM documents GROUP BY lang")
def _(spark, d):
    return D.spread(table(spark, d, "documents"), ["lang"], "n_chars")


@query("two_signal_bands", "SELECT lang, mean, median, round(rate, 6) AS flag_rate, CASE WHEN rate >= 0.15 THEN 'high' WHEN rate >= 0.1 THEN 'raised' ELSE 'low' END AS band FROM (SELECT lang, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, count(*) FILTER (n_chars < 500) / count(*) AS rate FROM documents GROUP BY lang)")
def _(spark, d):
    return D.flag_report(table(spark, d, "documents"), ["lang"], "n_chars", C("n_chars") < 500, 0.1, 0.15)


@query("blank_images", "SELECT count(DISTINCT doc_id) FILTER (n_chars < 200) AS blank, count(DISTINCT doc_id) FILTER (n_chars IS NULL) AS unreadable, count(DISTINCT doc_id) AS images FROM documents JOIN (VALUES (1), (2)) AS t(copy) ON true")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    return D.blanks(x.unionByName(x), "doc_id", C("n_chars") < 200, C("n_chars").isNull())


@query("curated_totals", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def _(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("dataset_union", "SELECT split, count(*) AS n FROM (SELECT 'a' AS split FROM documents UNION ALL SELECT 'b' FROM labels) GROUP BY split")
def _(spark, d):
    return D.union_of({"a": table(spark, d, "documents").select("doc_id"), "b": table(spark, d, "labels").select("doc_id", "toxic")}).groupBy("split").agg(F.count("*").alias("n"))


@query("drop_rate", "SELECT camera_id, count(*) AS published, count(DISTINCT tick) AS consumed, count(*) - count(DISTINCT tick) AS dropped, round((count(*) - count(DISTINCT tick)) / count(*), 6) AS drop_rate FROM detections GROUP BY camera_id", "detections")
def _(spark, d):
    return D.drop_report(view(spark, d, "detections"), ["camera_id"], "tick")


@query("zones_per_camera", "SELECT c.camera_id, CAST(count(z.zone_id) AS BIGINT) AS n FROM (SELECT DISTINCT 'cam_0' || CAST(1 + user_id % 6 AS VARCHAR) AS camera_id FROM events) c LEFT JOIN (SELECT camera_id, zone_id FROM site_zones) z ON z.camera_id = c.camera_id GROUP BY c.camera_id", "site_zones")
def _(spark, d):
    """Six cameras that have events, of which four have zones."""
    cameras = table(spark, d, "events").select(F.concat(F.lit("cam_0"), (1 + C("user_id") % 6).cast("string")).alias("camera_id")).distinct()
    return M.counted(cameras, view(spark, d, "site_zones"), "camera_id", "zone_id")


@query("active_admins", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").agg(F.count("*").alias("n"))


@query("active_persons", "SELECT label AS person_id, count(*) AS poses FROM embeddings WHERE label % 4 <> 1 GROUP BY label")
def _(spark, d):
    x = table(spark, d, "embeddings").withColumn("active", C("label") % 4 != 1)
    return x.where("active").groupBy(C("label").alias("person_id")).agg(F.count("*").alias("poses"))


@query("shot_burst_caps", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source, n_chars // 200 ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1) WHERE r <= 10")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.floor(C("n_chars") / 200).alias("shot"))
    return D.capped(D.capped(x, ["source", "shot"], [F.desc("n_chars"), "doc_id"], 1), ["source"], [F.desc("n_chars"), "doc_id"], 10).select("doc_id")


@query(
    "burst_filter",
    """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT e AS g FROM f WHERE vec_id IN (0, 7)),
    c AS (SELECT vec_id, max((64 * sxy - sx * sy) / sqrt((64 * sxx - sx * sx) * (64 * syy - sy * sy))) AS corr FROM (SELECT vec_id, list_sum(e) AS sx, list_sum(g) AS sy, list_sum(list_transform(range(1, 65), lambda i: e[i] * g[i])) AS sxy, list_sum(list_transform(e, lambda x: x * x)) AS sxx, list_sum(list_transform(g, lambda x: x * x)) AS syy FROM f, r) GROUP BY vec_id)
    SELECT vec_id FROM c WHERE NOT corr > 0.1 UNION ALL (SELECT vec_id FROM c WHERE corr > 0.1 ORDER BY md5('burst:' || vec_id), vec_id LIMIT 20)""",
)
def _(spark, d):
    x = table(spark, d, "embeddings")
    return D.burst_filtered(x, "vec_id", "embedding", x.where("vec_id IN (0, 7)"), 0.1, 20)


# -- boxes -------------------------------------------------------------------------------------------------------------

@query(
    "yolox_decode",
    """SELECT box_id, round(((x1 / 100 + CAST(box_id % 52 AS DOUBLE)) * 8 - exp(y1 / 100) * 4) / 0.5e0, 6) AS x1, round(((y2 / 100 + CAST(box_id % 40 AS DOUBLE)) * 8 + exp(x2 / 200) * 4) / 0.5e0, 6) AS y2, 0.8e0 * greatest(score * 0.9e0, score * 0.5e0) AS score, CAST(0 AS INT) AS klass FROM boxes""",
    "boxes",
)
def _(spark, d):
    x = view(spark, d, "boxes")
    out = geometry.decode(C("x1") / 100, C("y2") / 100, C("y1") / 100, C("x2") / 200, C("box_id") % 52, C("box_id") % 40, F.lit(8), F.lit(0.8), F.array(C("score") * 0.9, C("score") * 0.5), F.lit(0.5))
    return x.select("box_id", out.alias("o")).select("box_id", F.round("o.x1", 6).alias("x1"), F.round("o.y2", 6).alias("y2"), "o.score", "o.klass")


@query(
    "crop_boxes_full",
    """SELECT box_id, CAST(floor(greatest(x1 - 0.1e0 * (x2 - x1), 0)) AS INT) AS px1, CAST(floor(greatest(y1 - 0.2e0 * (y2 - y1), 0)) AS INT) AS py1, CAST(floor(least(x2 + 0.1e0 * (x2 - x1), 640)) AS INT) AS px2, CAST(floor(least(y2 + 0.2e0 * (y2 - y1), 480)) AS INT) AS py2,
    CAST(floor(greatest(x1, 0)) AS INT) AS fx1, CAST(floor(least(y1 + 0.35e0 * (y2 - y1), 480)) AS INT) AS fy2, round(greatest(x1 - 0.15e0 * (x2 - x1), 0), 6) AS ex1, round(greatest(y1 - 0.15e0 * (y2 - y1), 0), 6) AS ey1, round(least(x2 + 0.15e0 * (x2 - x1), 640), 6) AS ex2, round(least(y2 + 0.15e0 * (y2 - y1), 480), 6) AS ey2 FROM boxes""",
    "boxes",
)
def _(spark, d):
    box = [C(c) for c in ("x1", "y1", "x2", "y2")]
    whole = lambda c: F.floor(c).cast("int")
    p, f, e = geometry.padded(*box, 0.1, 0.2, 640, 480), geometry.face(*box, 640, 480), geometry.padded(*box, 0.15, 0.15, 640, 480)
    return view(spark, d, "boxes").select(
        "box_id", *[whole(c).alias(n) for c, n in zip(p, ("px1", "py1", "px2", "py2"), strict=True)], whole(f[0]).alias("fx1"), whole(f[3]).alias("fy2"), *[F.round(c, 6).alias(n) for c, n in zip(e, ("ex1", "ey1", "ex2", "ey2"), strict=True)]
    )


@query("helmet_probability", "SELECT box_id, round(CASE class_id WHEN 0 THEN 0.65e0 + 0.35e0 * least(greatest((score - 0.4e0) / 0.6e0, 0), 1) WHEN 1 THEN 0.35e0 * (1 - least(greatest((score - 0.4e0) / 0.6e0, 0), 1)) ELSE 0.5e0 END, 6) AS p FROM boxes", "boxes")
def _(spark, d):
    return view(spark, d, "boxes").select("box_id", F.round(geometry.helmet_probability(C("class_id"), C("score"), 0.4), 6).alias("p"))


@query(
    "speck_cluster",
    """SELECT camera_id, tick, n, min_x, max_x FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, tick ORDER BY n DESC, det_id) AS r FROM (SELECT a.camera_id, a.tick, a.det_id, count(*) AS n, min(b.fx) AS min_x, max(b.fx) AS max_x FROM detections a JOIN detections b ON a.camera_id = b.camera_id AND a.tick = b.tick AND (a.fx - b.fx) * (a.fx - b.fx) + (a.fy - b.fy) * (a.fy - b.fy) <= 40000 GROUP BY a.camera_id, a.tick, a.det_id)) WHERE r = 1 AND n >= 3""",
    "detections",
)
def _(spark, d):
    return Z.densest(view(spark, d, "detections"), ["camera_id", "tick"], 200.0, 3).select("camera_id", "tick", "n", "min_x", "max_x")


@query("snapshot_keys", "SELECT alert_id, kind || '/' || camera_id || '/' || strftime(ts, '%Y-%m-%d') || '/' || alert_id || CASE WHEN kind IN ('fire', 'smoke') THEN '.mp4' ELSE '.jpg' END AS key FROM alerts", "alerts")
def _(spark, d):
    ext = F.when(C("kind").isin("fire", "smoke"), ".mp4").otherwise(".jpg")
    return A.stored_as(view(spark, d, "alerts"), C("kind"), ext)


# -- added to the above ------------------------------------------------------------------------------------------------

@query(
    "live_resample",
    """WITH RECURSIVE o AS (SELECT user_id % 4 AS k, event_id, CAST(epoch(ts) AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT k, rn, t - 1800.0 AS planned, event_id AS pub FROM o WHERE rn = 1
     UNION ALL SELECT r.k, o.rn, CASE WHEN o.t >= r.planned THEN greatest(r.planned + 1800.0, o.t - 1800.0) ELSE r.planned END, CASE WHEN o.t >= r.planned THEN o.event_id END FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
    SELECT k, pub AS event_id FROM r WHERE pub IS NOT NULL""",
)
def _(spark, d):
    x = table(spark, d, "events").select((C("user_id") % 4).alias("k"), "event_id", seconds("ts").alias("at"))
    return S.scheduled(x, ["k"], "at", 1800.0, "event_id")


@query("slot_resample", "SELECT min(det_id) AS det_id FROM detections GROUP BY camera_id, floor(epoch(ts) / 5400)", "detections")
def _(spark, d):
    return S.paced(view(spark, d, "detections").withColumn("at", seconds("ts")), ["camera_id"], "at", 1 / 5400, "det_id").select("det_id")


@query("alert_config_read", "SELECT alert_id FROM alerts WHERE ts >= TIMESTAMP '2024-01-12' AND severity IN ('high', 'critical')", "alerts")
def _(spark, d):
    config = spark.sql("SELECT * FROM (VALUES ('global', TIMESTAMP_NTZ '2024-01-12', array('high', 'critical')), ('other', TIMESTAMP_NTZ '2025-01-01', array())) AS c(id, since, severities)")
    return A.by_config(view(spark, d, "alerts"), config, "global").select("alert_id")


@query("mail_body", "SELECT alert_id, 'Kind: ' || kind || chr(10) || 'Camera: ' || camera_id || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' || CASE WHEN zone_id IS NULL THEN '' ELSE chr(10) || 'Zone: ' || zone_id END AS body FROM alerts", "alerts")
def _(spark, d):
    return A.mail_body(view(spark, d, "alerts"))


@query("hash_bits", "SELECT vec_id, list_sum(list_transform(embedding, lambda v: CASE WHEN v > list_avg(embedding) THEN 1 ELSE 0 END)) AS over_mean, list_sum(list_transform(embedding, lambda v: CASE WHEN v > list_median(embedding) THEN 1 ELSE 0 END)) AS over_median FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def _(spark, d):
    v = C("embedding").cast("array<double>")
    ones = lambda bits: F.bit_count(bits).cast("long")
    return table(spark, d, "embeddings").select("vec_id", ones(D.mean_bits(v)).alias("over_mean"), ones(D.median_bits(v)).alias("over_median"))


@query(
    "dct_hash_bits",
    """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    c AS (SELECT vec_id, u, v, sum(e[8 * x + y + 1] * cos((2 * x + 1) * u * pi() / 16) * cos((2 * y + 1) * v * pi() / 16)) * CASE WHEN u = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END * CASE WHEN v = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END AS k
     FROM f, range(0, 4) AS a(u), range(0, 4) AS b(v), range(0, 8) AS p(x), range(0, 8) AS q(y) GROUP BY vec_id, u, v)
    SELECT vec_id, sum(CASE WHEN k > md THEN 1 ELSE 0 END)::BIGINT AS ones, sum(CASE WHEN k > md THEN CAST(pow(2, 15 - 4 * u - v) AS BIGINT) ELSE 0 END)::BIGINT AS bits FROM (SELECT *, median(k) OVER (PARTITION BY vec_id) AS md FROM c) GROUP BY vec_id""",
)
def _(spark, d):
    """Each vector as an image of 8 by 8."""
    bits = D.dct_bits(C("embedding").cast("array<double>"), 8, 4)
    return table(spark, d, "embeddings").select("vec_id", F.bit_count(bits).cast("long").alias("ones"), bits.alias("bits"))


@query("urgent_lanes", "SELECT alert_id, kind IN ('fire', 'smoke') AS urgent FROM alerts", "alerts")
def _(spark, d):
    fast, rest = stateful.lanes(view(spark, d, "alerts"), C("kind").isin("fire", "smoke"))
    part = lambda x, v: x.select("alert_id", F.lit(v).alias("urgent"))
    return part(fast, True).unionByName(part(rest, False))


@query("event_time_source", "SELECT event_id, strftime(CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-03-01' + to_seconds(event_id) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def _(spark, d):
    pos = F.when(C("event_id") % 3 == 0, C("event_id").cast("double"))
    at = stateful.event_time(pos, C("ts"), F.lit("2024-03-01").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


HEADS = "h AS (SELECT * FROM boxes o WHERE role = 'pred' AND NOT EXISTS (SELECT 1 FROM boxes p WHERE p.role = 'pred' AND p.image_id = o.image_id AND p.class_id <> o.class_id AND p.score > o.score AND %s > 0.5))" % share_sql("o", "p")


@query(
    "helmet_pipeline",
    f""", {HEADS} SELECT box_id, head_id, round(CASE class_id WHEN 0 THEN 0.65e0 + 0.35e0 * a WHEN 1 THEN 0.35e0 * (1 - a) ELSE 0.5e0 END, 6) AS p FROM (SELECT box_id, head_id, class_id, least(greatest((score - 0.4e0) / 0.6e0, 0), 1) AS a FROM
    (SELECT p.box_id, h.box_id AS head_id, h.class_id, h.score, row_number() OVER (PARTITION BY p.box_id ORDER BY abs((h.x1 + h.x2) / 2 - (p.x1 + p.x2) / 2), h.score DESC, h.box_id) AS r FROM boxes p JOIN h ON p.image_id = h.image_id AND p.role = 'gt' AND (h.x1 + h.x2) / 2 BETWEEN p.x1 AND p.x2 AND (h.y1 + h.y2) / 2 BETWEEN p.y1 AND (p.y1 + p.y2) / 2) WHERE r = 1)""",
    "boxes",
)
def _(spark, d):
    b = view(spark, d, "boxes")
    return X.helmets(b.where("role = 'gt'"), b.where("role = 'pred'"), 0.5, 0.4)
