"""Second set of registered queries: the smaller operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vigil.functions import geometry
from vigil.operators import alerts as A
from vigil.operators import boundaries as B
from vigil.operators import datasets as D
from vigil.operators import graph
from vigil.operators import sequences as S
from vigil.operators import similarity as M
from vigil.operators import tracking as T
from vigil.operators import zones as Z
from vigil.plans.catalogue import COS, NEAR, query, seconds
from vigil.sources import files
from vigil.sources.observations import prelude, table, view

C = F.col


def with_box(df):
    return df.withColumns({"x1": C("fx") - 20, "y1": C("fy") - 100, "x2": C("fx") + 20, "y2": C("fy")})


@query("detector_prefilter", "SELECT box_id FROM boxes WHERE class_id IN (0, 2) AND score >= 0.3 AND y2 - y1 >= 50", "boxes")
def _(spark, d):
    return view(spark, d, "boxes").where(C("class_id").isin(0, 2) & (C("score") >= 0.3) & (C("y2") - C("y1") >= 50)).select("box_id")


@query("decode_anchor_rows", "SELECT box_id, (x1 / 100 + CAST(box_id % 52 AS DOUBLE)) * 8 AS cx, round(exp(y1 / 100) * 8, 6) AS w, greatest(score * 0.9e0, score * 0.5e0) AS score, CAST(CASE WHEN score * 0.9e0 >= score * 0.5e0 THEN 0 ELSE 1 END AS INT) AS klass FROM boxes", "boxes")
def _(spark, d):
    scores = F.array(C("score") * 0.9, C("score") * 0.5)
    best = F.array_max(scores)
    return view(spark, d, "boxes").select("box_id", ((C("x1") / 100 + C("box_id") % 52) * 8).alias("cx"), F.round(F.exp(C("y1") / 100) * 8, 6).alias("w"), best.alias("score"), (F.array_position(scores, best) - 1).cast("int").alias("klass"))


@query("clip_to_frame", "SELECT box_id, least(greatest(x1, 0), 399) AS x1, least(greatest(y1, 0), 299) AS y1, least(greatest(x2, 0), 399) AS x2, least(greatest(y2, 0), 299) AS y2 FROM boxes", "boxes")
def _(spark, d):
    clip = lambda c, hi: F.least(F.greatest(C(c), F.lit(0.0)), F.lit(float(hi))).alias(c)
    return view(spark, d, "boxes").select("box_id", clip("x1", 399), clip("y1", 299), clip("x2", 399), clip("y2", 299))


@query("normalise_roundtrip", "SELECT box_id, round(x1 / 640 * 640, 6) AS x1, round((x2 - x1) * (y2 - y1), 3) AS area FROM boxes", "boxes")
def _(spark, d):
    n = view(spark, d, "boxes").withColumns({c: C(c) / s for c, s in (("x1", 640), ("x2", 640), ("y1", 480), ("y2", 480))})
    return n.select("box_id", F.round(C("x1") * 640, 6).alias("x1"), F.round(geometry.area(C("x1"), C("y1"), C("x2"), C("y2")) * 640 * 480, 3).alias("area"))


@query("crop_boxes", "SELECT box_id, CAST(floor(greatest(x1 - 0.1e0 * (x2 - x1), 0)) AS INT) AS px1, CAST(floor(least(x2 + 0.1e0 * (x2 - x1), 640)) AS INT) AS px2, y1 + 0.35e0 * (y2 - y1) AS face_y2, greatest(x1 - 0.15e0 * (x2 - x1), 0) AS ex1 FROM boxes", "boxes")
def _(spark, d):
    w, h = C("x2") - C("x1"), C("y2") - C("y1")
    low = lambda p: F.greatest(C("x1") - p * w, F.lit(0.0))
    return view(spark, d, "boxes").select("box_id", F.floor(low(0.1)).cast("int").alias("px1"), F.floor(F.least(C("x2") + 0.1 * w, F.lit(640.0))).cast("int").alias("px2"), (C("y1") + 0.35 * h).alias("face_y2"), low(0.15).alias("ex1"))


@query("helmet_probability_bands", "SELECT box_id, p, CASE WHEN p >= 0.65 THEN 'present' WHEN p <= 0.35 THEN 'absent' ELSE 'indeterminate' END AS state FROM (SELECT box_id, CASE class_id WHEN 0 THEN 0.65e0 + 0.35e0 * score WHEN 1 THEN 0.35e0 * (1 - score) ELSE 0.5e0 END AS p FROM boxes)", "boxes")
def _(spark, d):
    p = F.when(C("class_id") == 0, 0.65 + 0.35 * C("score")).when(C("class_id") == 1, 0.35 * (1 - C("score"))).otherwise(0.5)
    state = F.when(C("p") >= 0.65, "present").when(C("p") <= 0.35, "absent").otherwise("indeterminate")
    return view(spark, d, "boxes").select("box_id", p.alias("p")).withColumn("state", state)


SAME = "h.image_id = o.image_id AND h.class_id <> o.class_id AND o.score > h.score AND least(h.x2, o.x2) > greatest(h.x1, o.x1) AND least(h.y2, o.y2) > greatest(h.y1, o.y1)"
INTER = "(least(h.x2, o.x2) - greatest(h.x1, o.x1)) * (least(h.y2, o.y2) - greatest(h.y1, o.y1))"


@query("cross_class_suppression", f"SELECT box_id FROM boxes h WHERE NOT EXISTS (SELECT 1 FROM boxes o WHERE {SAME} AND {INTER} / ((h.x2 - h.x1) * (h.y2 - h.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {INTER}) > 0.5)", "boxes")
def _(spark, d):
    h, o = view(spark, d, "boxes").alias("h"), view(spark, d, "boxes").alias("o")
    other = (C("h.image_id") == C("o.image_id")) & (C("h.class_id") != C("o.class_id")) & (C("o.score") > C("h.score"))
    return h.join(o, other & (geometry.iou("h", "o") > 0.5), "left_anti").select("box_id")


@query("helmet_selection", "SELECT p.box_id, arg_min(h.box_id, struct_pack(d := abs((h.x1 + h.x2) / 2 - (p.x1 + p.x2) / 2), s := -h.score, i := h.box_id)) AS head_id FROM boxes p JOIN boxes h ON p.image_id = h.image_id AND p.role = 'gt' AND h.role = 'pred' AND (h.x1 + h.x2) / 2 BETWEEN p.x1 AND p.x2 AND (h.y1 + h.y2) / 2 BETWEEN p.y1 AND (p.y1 + p.y2) / 2 GROUP BY p.box_id", "boxes")
def _(spark, d):
    b = view(spark, d, "boxes")
    p, h = b.where("role = 'gt'").alias("p"), b.where("role = 'pred'").alias("h")
    mid = lambda t, a, z: (C(f"{t}.{a}") + C(f"{t}.{z}")) / 2
    hit = (C("p.image_id") == C("h.image_id")) & mid("h", "x1", "x2").between(C("p.x1"), C("p.x2")) & mid("h", "y1", "y2").between(C("p.y1"), mid("p", "y1", "y2"))
    rank = F.struct(F.abs(mid("h", "x1", "x2") - mid("p", "x1", "x2")), -C("h.score"), C("h.box_id"))
    return p.join(h, hit).groupBy("p.box_id").agg(F.min_by("h.box_id", rank).alias("head_id"))


@query("ppe_item_sets", "SELECT doc_id, list_sort(list_intersect(a, b)) AS both_of, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM (SELECT doc_id, [lang, source] AS a, ['en', 'src1', 'src2'] AS b FROM documents)")
def _(spark, d):
    a, b = F.array("lang", "source"), F.array(F.lit("en"), F.lit("src1"), F.lit("src2"))
    return table(spark, d, "documents").select("doc_id", F.sort_array(F.array_intersect(a, b)).alias("both_of"), F.sort_array(F.array_except(a, b)).alias("only_a"))


@query("config_validation", "SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'price too low' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'unknown status' END], lambda x: x IS NOT NULL) AS errors FROM orders")
def _(spark, d):
    errors = F.array_compact(F.array(F.when(C("o_totalprice") < 1000, "price too low"), F.when(~C("o_orderstatus").isin("O", "F"), "unknown status")))
    return table(spark, d, "orders").select("o_orderkey", errors.alias("errors"))


@query("image_class_presence", "SELECT image_id FROM boxes GROUP BY image_id HAVING bool_or(class_id = 0) AND NOT bool_or(class_id = 2 AND score > 0.9)", "boxes")
def _(spark, d):
    b = view(spark, d, "boxes")
    have = b.select("image_id").distinct().join(b.where("class_id = 0"), "image_id", "left_semi")
    return have.join(b.where("class_id = 2 AND score > 0.9"), "image_id", "left_anti")


@query("domain_default_join", "SELECT box_id, coalesce(l.lang, 'unknown') AS domain FROM boxes LEFT JOIN documents l ON l.doc_id = box_id AND l.lang <> 'en'", "boxes")
def _(spark, d):
    names = table(spark, d, "documents").where("lang <> 'en'").select(C("doc_id").alias("box_id"), "lang")
    return view(spark, d, "boxes").join(names, "box_id", "left").select("box_id", F.coalesce("lang", F.lit("unknown")).alias("domain"))


@query("two_signal_flag", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 500 AND length(source) < 5) AS flagged, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars FROM documents GROUP BY lang")
def _(spark, d):
    both = (C("n_chars") < 500) & (F.length("source") < 5)
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(both).alias("flagged"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


@query("angle_groups", "WITH q AS (SELECT p_brand, p_partkey, (p_size * 7 % 180) + (p_partkey % 4) * 0.25e0 AS a FROM part) SELECT p_brand, max(k) AS largest FROM (SELECT a.p_brand, a.p_partkey, count(*) AS k FROM q a JOIN q b ON a.p_brand = b.p_brand AND least(abs(a.a - b.a), 180 - abs(a.a - b.a)) <= 10.25 GROUP BY a.p_brand, a.p_partkey) GROUP BY p_brand")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", (C("p_size") * 7 % 180 + C("p_partkey") % 4 * 0.25).alias("angle"))
    return D.largest_angle_group(p, "p_brand", "angle", 10.25, 180).select("p_brand", "largest")


@query("histogram_corr", "SELECT vec_id, round(corr, 6) AS corr FROM (SELECT vec_id, (64 * sxy - sx * sy) / sqrt((64 * sxx - sx * sx) * (64 * syy - sy * sy)) AS corr FROM (SELECT vec_id, list_sum(a) AS sx, list_sum(b) AS sy, list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) AS sxy, list_sum(list_transform(a, lambda x: x * x)) AS sxx, list_sum(list_transform(b, lambda x: x * x)) AS syy FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lag(embedding) OVER (ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)) WHERE sy IS NOT NULL)")
def _(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("a"))
    x = S.with_previous(x, "vec_id", "a", "b").where("b IS NOT NULL")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y)
    sx, sy = total(C("a")), total(C("b"))
    corr = (64 * M.dot(C("a"), C("b")) - sx * sy) / F.sqrt((64 * M.dot(C("a"), C("a")) - sx * sx) * (64 * M.dot(C("b"), C("b")) - sy * sy))
    return x.select("vec_id", F.round(corr, 6).alias("corr"))


@query("shot_segmentation", f"SELECT vec_id, CAST(sum(CASE WHEN {COS} / sqrt({COS.replace('b[i]', 'a[i]')} * {COS.replace('a[i]', 'b[i]').replace('len(a)', 'len(b)')}) < 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shot FROM (SELECT vec_id, embedding AS a, lag(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)")
def _(spark, d):
    return M.shots(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 0.05).select("vec_id", "shot")


@query("counters_and_totals", "SELECT o_orderstatus, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round(C("o_totalprice") * 100)).cast("long").alias("cents"), F.count_distinct("o_custkey").alias("customers"))


@query("redact_and_labels", "SELECT page_id, regexp_replace(url, '[?].*$', '?***') AS url, regexp_extract(url, '([0-9]+)', 1) AS number, regexp_extract(url, '^[a-z]+://([a-z]+)', 1) AS family FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?].*$", "?***").alias("url"), F.regexp_extract("url", r"([0-9]+)", 1).alias("number"), F.regexp_extract("url", r"^[a-z]+://([a-z]+)", 1).alias("family"))


@query("hash_order_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM documents) WHERE r <= 20")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", (C("doc_id") * 2654435761 % 4294967296).alias("h"))
    return D.capped(x, ["lang"], ["h", "doc_id"], 20).select("doc_id")


@query("cursor_dedup", "SELECT kind, severity, min(alert_id) AS alert_id FROM alerts WHERE alert_id >= 100 GROUP BY kind, severity", "alerts")
def _(spark, d):
    return view(spark, d, "alerts").where("alert_id >= 100").groupBy("kind", "severity").agg(F.min("alert_id").alias("alert_id"))


@query("zone_state_map", "SELECT zone_id, camera_id, list_sort(list(track_id)) AS tracks FROM (SELECT zone_id, d.camera_id, track_id, arg_max(fx BETWEEN x0 AND x1 AND fy BETWEEN y0 AND y1, obs_no) AS i FROM detections d JOIN zones ON zones.camera_id = d.camera_id WHERE ztype = 'polygon' GROUP BY zone_id, d.camera_id, track_id) WHERE i GROUP BY zone_id, camera_id", "detections", "zones")
def _(spark, d):
    last = Z.membership(view(spark, d, "detections"), view(spark, d, "zones").where("ztype = 'polygon'")).groupBy("zone_id", "camera_id", "track_id").agg(F.max_by("inside", "obs_no").alias("i"))
    return last.where("i").groupBy("zone_id", "camera_id").agg(F.sort_array(F.collect_list("track_id")).alias("tracks"))


@query("delivery_state", "SELECT track_id, count(*) AS attempts, arg_max(severity, alert_id) AS severity FROM alerts GROUP BY track_id", "alerts")
def _(spark, d):
    return view(spark, d, "alerts").groupBy("track_id").agg(F.count("*").alias("attempts"), F.max_by("severity", "alert_id").alias("severity"))


@query("duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("clip_window_join", "SELECT a.alert_id, count(d.det_id) AS frames FROM (SELECT * FROM alerts WHERE kind = 'fire') a JOIN detections d ON d.camera_id = a.camera_id AND d.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR GROUP BY a.alert_id", "alerts", "detections")
def _(spark, d):
    # an hour to both sides is what a ring of two hours holds an hour later; alerts without frames are no rows
    return A.clip_counts(view(spark, d, "alerts").where("kind = 'fire'"), view(spark, d, "detections"), 7200, 3600).where("frames > 0")


@query("kofn_gate")
def _(spark, d):
    fire = with_box(view(spark, d, "detections").where("klass IN ('fire', 'smoke')"))
    return T.k_of_n(fire, 2, 48, 0.1)


@query("track_association")
def _(spark, d):
    """People of all cameras, frame by frame: each walks on by 60 and 40 pixels, in boxes of 300 by 200, and turns at the edges."""
    x = view(spark, d, "detections").select("camera_id", "det_id", "score", C("obs_no").alias("tick"), (C("fx") - 150).alias("x1"), (C("fy") - 200).alias("y1"), (C("fx") + 150).alias("x2"), C("fy").alias("y2"))
    return T.track(x, high=0.3, lost_after=6)


#: Boundary events as a recursion over each track's observations: state after each, and what happens in the gap that follows.
FULL_BOUNDARY = """
seen AS (SELECT d.camera_id, z.zone_id, d.tick AS u, d.track_id, arg_max(d.fx BETWEEN z.x0 AND z.x1 AND d.fy BETWEEN z.y0 AND z.y1, d.obs_no) AS inside,
 arg_max(d.fx - 20 <= 20 OR d.fy - 100 <= 20 OR d.fx + 20 >= 980 OR d.fy >= 980, d.obs_no) AS edge FROM detections d JOIN zones z ON z.camera_id = d.camera_id WHERE z.ztype = 'polygon' GROUP BY d.camera_id, z.zone_id, d.tick, d.track_id),
o AS (SELECT *, row_number() OVER w AS k, coalesce(lead(u) OVER w, (SELECT max(u) FROM seen) + 1) AS nx FROM seen WINDOW w AS (PARTITION BY camera_id, zone_id, track_id ORDER BY u)),
m AS (SELECT camera_id, zone_id, track_id, k, u, nx, edge, CASE WHEN inside AND edge AND u > 6 THEN false ELSE inside END AS conf, inside AS cand, CAST(CASE WHEN inside AND edge AND u > 6 THEN 1 ELSE 2 END AS BIGINT) AS age, CAST(NULL AS VARCHAR) AS kind FROM o WHERE k = 1
 UNION ALL SELECT camera_id, zone_id, track_id, k, u, nx, edge, CASE WHEN born THEN CASE WHEN inside AND edge AND u > 6 THEN false ELSE inside END WHEN age >= 2 THEN inside ELSE conf END, inside, CASE WHEN born AND NOT (inside AND edge AND u > 6) THEN 2 ELSE age END,
  CASE WHEN NOT born AND age >= 2 AND inside <> conf THEN CASE WHEN inside THEN 'entry' ELSE 'exit' END END
  FROM (SELECT o.camera_id, o.zone_id, o.track_id, o.k, o.u, o.nx, o.edge, o.inside, o.u - m.u > 301 AS born, m.conf AND NOT (m.edge AND m.nx - 1 - m.u >= 6) AS conf,
   CASE WHEN o.u - m.u > 301 THEN 1 WHEN o.inside = (m.cand AND NOT (m.conf AND m.edge AND m.nx - 1 - m.u >= 6)) THEN m.age + 1 ELSE 1 END AS age
   FROM m JOIN o ON o.camera_id = m.camera_id AND o.zone_id = m.zone_id AND o.track_id = m.track_id AND o.k = m.k + 1) s)
SELECT camera_id, zone_id, track_id, u AS update_no, kind FROM m WHERE kind IS NOT NULL
UNION ALL SELECT camera_id, zone_id, track_id, u + 6, 'exit' FROM m WHERE conf AND edge AND nx - 1 - u >= 6"""


@query("boundary_events_full", f"WITH RECURSIVE {prelude('detections', 'zones')[5:]}, {FULL_BOUNDARY}")
def _(spark, d):
    x = Z.membership(with_box(view(spark, d, "detections")), view(spark, d, "zones").where("ztype = 'polygon'"))
    edge = geometry.touches_edge(C("x1"), C("y1"), C("x2"), C("y2"), 1000, 1000)
    seen = x.groupBy("camera_id", "zone_id", C("tick").alias("update_no"), "track_id").agg(F.max_by("inside", "obs_no").alias("inside"), F.max_by(edge, "obs_no").alias("at_edge"))
    # every camera's clock has come as far as the newest hour
    newest = seen.agg(F.max("update_no").alias("newest"))
    return B.boundary_events(seen, 2, seen.select("camera_id").distinct().join(newest, F.lit(True)))


REACHED = f"pr AS ({NEAR}), e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT a AS id, a AS t FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.t), c AS (SELECT id, min(t) AS component FROM r GROUP BY id)"


def near_components(spark, d):
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))
    hashes = table(spark, d, "embeddings").select(C("vec_id").alias("id"), bits.alias("h"))
    return graph.components(M.near_hashes(hashes, 15))


@query("near_dup_components", f"WITH RECURSIVE {REACHED} SELECT id, component FROM c")
def _(spark, d):
    return near_components(spark, d)


@query("near_dup_report", f"WITH RECURSIVE {REACHED} SELECT count(DISTINCT component) AS clusters, round(coalesce(count(*) - count(DISTINCT component), 0) / (SELECT count(*) FROM embeddings), 6) AS duplicate_ratio, (SELECT list(n ORDER BY n DESC) FROM (SELECT count(*) AS n, component FROM c GROUP BY component ORDER BY n DESC, component LIMIT 5)) AS largest FROM c")
def _(spark, d):
    return D.component_report(near_components(spark, d), table(spark, d, "embeddings").count())


# -- recorder, stored alerts, files -------------------------------------------------------------------------------------

#: Written frames as a recursion over each camera's frames.
RECORDED = """o AS (SELECT camera_id, det_id, CAST(epoch(ts) AS DOUBLE) AS t, row_number() OVER w AS k, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 10800, false) AS cut FROM detections WINDOW w AS (PARTITION BY camera_id ORDER BY ts, det_id)),
m AS (SELECT camera_id, det_id, k, true AS hit, t AS lw, t AS sg, t AS sl, true AS still FROM o WHERE k = 1
 UNION ALL SELECT camera_id, det_id, k, hit, CASE WHEN hit THEN t ELSE lw END, CASE WHEN NOT hit THEN sg WHEN sg IS NULL OR t - sg >= 259200 THEN t ELSE sg END,
  CASE WHEN hit AND t - sl >= 172800 THEN t ELSE sl END, hit AND t - sl >= 172800
  FROM (SELECT o.camera_id, o.det_id, o.k, o.t, o.t - m.lw >= 7200 AS hit, m.lw, CASE WHEN o.cut THEN NULL ELSE m.sg END AS sg, m.sl FROM m JOIN o ON o.camera_id = m.camera_id AND o.k = m.k + 1) s)
SELECT camera_id, det_id, sg AS segment, still FROM m WHERE hit"""


@query("recorder_segments", f"WITH RECURSIVE {prelude('detections')[5:]}, {RECORDED}")
def _(spark, d):
    """Every camera's frames, one in 2 hours; segments of 3 days, stills 2 days apart, the feed lost after 3 hours."""
    x = view(spark, d, "detections").select("camera_id", "det_id", seconds("ts").alias("at"))
    return S.recorded(x, ["camera_id"], "at", "det_id", 7200.0, 259200.0, 172800.0, 10800.0)


@query("event_insert", """SELECT alert_id, camera_id, strftime(CASE WHEN alert_id % 4 = 1 THEN TIMESTAMP '2024-06-01' ELSE ts END, '%Y-%m-%d %H:%M') AS at, CASE WHEN alert_id % 3 = 2 THEN 'medium' ELSE severity END AS severity,
 zone_id, subtype, CAST(NULL AS VARCHAR) AS zone_name, false AS delivered, 0 AS delivery_attempts FROM alerts""", "alerts")
def _(spark, d):
    """Every fourth alert comes without a time and every third without a severity; no alert has a zone's name."""
    x = view(spark, d, "alerts").withColumn("message", C("kind"))
    x = x.withColumns({"ts": F.when(C("alert_id") % 4 != 1, C("ts")), "severity": F.when(C("alert_id") % 3 != 2, C("severity"))})
    stored = A.inserted(x, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return stored.select("alert_id", "camera_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "severity", "zone_id", "subtype", "zone_name", "delivered", "delivery_attempts")


@query("label_text_scan", """SELECT image_id, class_id, count(*) AS n, round(sum(x1), 3) AS x1, round(sum(y1), 3) AS y1, round(sum(x2), 3) AS x2, round(sum(y2), 3) AS y2
 FROM boxes WHERE box_id % 7 <> 3 AND box_id % 11 <> 5 GROUP BY image_id, class_id""", "boxes")
def _(spark, d):
    """Boxes as label lines and back to corners; some lines lack a field, some name no class."""
    mid = lambda a, z, size: (C(a) + C(z)) / 2 / size
    share = lambda a, z, size: (C(z) - C(a)) / size
    fields = [F.when(C("box_id") % 11 == 5, "x").otherwise(C("class_id").cast("string")), mid("x1", "x2", 640), mid("y1", "y2", 480), share("x1", "x2", 640)]
    line = F.concat_ws(" ", *[f.cast("string") for f in fields], F.when(C("box_id") % 7 != 3, share("y1", "y2", 480).cast("string")))
    x = files.corners(files.label_lines(view(spark, d, "boxes").select(C("image_id").alias("stem"), line.alias("value"))), 640, 480)
    return x.groupBy(C("stem").alias("image_id"), "class_id").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("manifest_scan", """SELECT image_id AS image, role AS source, class_id AS klass, count(*) AS n, count(*) FILTER (score >= 0.5) AS sure FROM boxes WHERE image_id % 9 <> 4 GROUP BY image_id, role, class_id""", "boxes")
def _(spark, d):
    """A manifest written from the boxes, with blank and broken lines, and read again."""
    instance = F.struct(C("class_id").cast("string").alias("class"), F.when(C("score") >= 0.5, "sure").alias("domain"))
    x = view(spark, d, "boxes").groupBy("image_id", "role").agg(F.collect_list(instance).alias("instances"))
    text = F.to_json(F.struct(C("image_id").cast("string").alias("image"), C("role").alias("source"), "instances"))
    path = os.path.join(graph.shared_folder(spark), "vigil", f"manifest-{uuid.uuid4().hex}")
    x.select(F.when(C("image_id") % 9 != 4, text).when(C("image_id") % 2 == 0, "").otherwise(F.concat(F.lit("cut "), text)).alias("value")).write.text(path)
    return files.manifest(spark, path).groupBy(C("image").cast("long").alias("image"), "source", C("class").cast("int").alias("klass")).agg(F.count("*").alias("n"), F.count("domain").alias("sure"))


@query("box_format_back", "SELECT box_id, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round((x2 - x1) * (y2 - y1), 3) AS area FROM boxes", "boxes")
def _(spark, d):
    """Normalised centre boxes as corners, and these as corner, size and area."""
    b = view(spark, d, "boxes").select(C("box_id").alias("stem"), "class_id", ((C("x1") + C("x2")) / 2 / 640).alias("cx"), ((C("y1") + C("y2")) / 2 / 480).alias("cy"), ((C("x2") - C("x1")) / 640).alias("w"), ((C("y2") - C("y1")) / 480).alias("h"))
    c, w, h = files.corners(b, 640, 480), C("x2") - C("x1"), C("y2") - C("y1")
    return c.select(C("stem").alias("box_id"), F.round("x1", 6).alias("x"), F.round("y1", 6).alias("y"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"), F.round(w * h, 3).alias("area"))
