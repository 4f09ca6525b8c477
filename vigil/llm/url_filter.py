"""URL filters by a temporal list join, in SQL functions only.

A list is a history of dated entries (pattern, action, listed): ``block`` and
``allow`` take effect on their day, ``remove`` ends what was in effect. Each
entry is valid until the pattern's next one, so of each pattern at most one
entry is in effect on a day. A capture meets the patterns that its URL falls
under (host, parent domains, host with first path segment) on equal keys, and
those valid when it was fetched decide: the most specific, longest pattern.

Defined results: a null URL, one without a host, or a null fetch day matches
nothing and is kept with action ``none``; entries with a null field don't
count; of entries of one pattern on one day the last by action name counts
(remove, then block, then allow); repeated captures each get their row; with an
empty list everything is kept; other columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.llm.common import table

#: So many ways the captures of one key are spread; the list is repeated as often.
SALTS = 8
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(h != "", h)


def keys_of(host: Column, segment: Column) -> Column:
    """Patterns that can match: the host and its parents of two labels or more, and host/segment."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(segment != "", F.array_append(parents, F.concat(host, F.lit("/"), segment))).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: still valid) of the entries in effect for some day."""
    x = entries.where(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("listed").isNotNull())
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "block", 1).otherwise(2)
    x = x.groupBy("pattern", "listed").agg(F.max(F.struct(rank.alias("r"), "action")).alias("e"))
    x = x.select("pattern", F.col("e.action").alias("action"), F.col("listed").alias("valid_from"), F.lead("listed").over(W.partitionBy("pattern").orderBy("listed")).alias("valid_to"))
    return x.where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """key, url, fetched of each capture with host, n_active, pattern, action and kept."""
    apart = captures.select("url", "fetched").distinct()
    host = apart.withColumn("host", host_of(F.col("url"))).withColumn("segment", F.lower(F.regexp_extract("url", SEGMENT, 1)))
    host = host.withColumn("salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)))
    keyed = host.select("url", "fetched", "salt", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("key"))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    k, v = keyed.alias("k"), listed.alias("v")
    valid = (F.col("k.key") == F.col("v.pattern")) & (F.col("k.salt") == F.col("v.salt")) & (F.col("k.fetched") >= F.col("v.valid_from"))
    valid = valid & (F.col("v.valid_to").isNull() | (F.col("k.fetched") < F.col("v.valid_to")))
    hit = F.struct(F.length("v.pattern").alias("n"), F.col("v.pattern").alias("pattern"), F.col("v.action").alias("action"))
    found = k.join(v, valid).groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.max(hit).alias("best"))
    c, f = captures.select("key", "url", "fetched", host_of(F.col("url")).alias("host")).alias("c"), found.alias("f")
    both = c.join(f, (F.col("c.url") == F.col("f.url")) & (F.col("c.fetched") == F.col("f.fetched")), "left")
    action = F.coalesce(F.col("best.action"), F.lit("none"))
    return both.select("key", "c.url", "c.fetched", "host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("best.pattern").alias("pattern"), action.alias("action"), (action != "block").alias("kept"))


def history(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and domains of pages, by a fixed rule on the first page of each (the tables hold none)."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("h")).where("h IS NOT NULL")
    host = hosts.groupBy(F.col("h").alias("pattern")).agg(F.min("page_id").alias("m"))
    domain = hosts.groupBy(F.substring_index("h", ".", -2).alias("pattern")).agg(F.min("page_id").alias("m")).withColumn("m", F.col("m") * 3)
    every = host.unionByName(domain)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    m = F.col("m")
    start = m * 11 % 200
    rules = F.array(
        F.struct(F.when(m % 3 == 0, "block").alias("action"), day(start).alias("listed")),
        F.struct(F.when(m % 3 == 0, "remove").alias("action"), day(start + 30 + m * 7 % 120).alias("listed")),
        F.struct(F.when(m % 12 == 0, "block").alias("action"), day(start + 160).alias("listed")),
        F.struct(F.when(m % 5 == 0, "allow").alias("action"), day(m * 13 % 300).alias("listed")),
    )
    e = every.select("pattern", F.explode(rules).alias("e")).select("pattern", "e.action", "e.listed")
    return e.where("action IS NOT NULL")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; their day of fetching is set by a fixed rule, as the tables hold none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    captures = pages.select(F.col("page_id").alias("key"), "url", fetched.alias("fetched"))
    out = evaluate(captures, history(pages))
    return out.select(F.col("key").alias("page_id"), "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "pattern", "action", "kept")


ORACLE = r"""
WITH u AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)), '') AS host,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1)) AS seg, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS t FROM pages),
hs AS (SELECT host AS pattern, min(page_id) AS m FROM u WHERE host IS NOT NULL GROUP BY host),
dm AS (SELECT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS pattern, 3 * min(page_id) AS m
  FROM u WHERE host IS NOT NULL GROUP BY 1),
ev AS (SELECT * FROM hs UNION ALL SELECT * FROM dm),
en AS (SELECT pattern, 'block' AS action, DATE '2024-01-01' + CAST(m * 11 % 200 AS INTEGER) AS d, 1 AS r FROM ev WHERE m % 3 = 0
  UNION ALL SELECT pattern, 'remove', DATE '2024-01-01' + CAST(m * 11 % 200 + 30 + m * 7 % 120 AS INTEGER), 0 FROM ev WHERE m % 3 = 0
  UNION ALL SELECT pattern, 'block', DATE '2024-01-01' + CAST(m * 11 % 200 + 160 AS INTEGER), 1 FROM ev WHERE m % 12 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + CAST(m * 13 % 300 AS INTEGER), 2 FROM ev WHERE m % 5 = 0),
one AS (SELECT pattern, d, max(r) AS r FROM en GROUP BY pattern, d),
iv AS (SELECT pattern, r, d AS f, lead(d) OVER (PARTITION BY pattern ORDER BY d) AS e FROM one),
ky AS (SELECT page_id, host, t, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    CASE WHEN seg <> '' THEN [host || '/' || seg] ELSE [] END)) AS k FROM u WHERE host IS NOT NULL),
h AS (SELECT page_id, pattern, r FROM ky JOIN iv ON k = pattern AND t >= f AND (e IS NULL OR t < e) WHERE r > 0),
b AS (SELECT page_id, count(*) AS n, first(pattern ORDER BY length(pattern) DESC, pattern DESC) AS pattern, first(r ORDER BY length(pattern) DESC, pattern DESC) AS r FROM h GROUP BY page_id)
SELECT u.page_id, host, strftime(t, '%Y-%m-%d') AS fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_active, pattern,
  CASE r WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS action, coalesce(r, 0) <> 1 AS kept
FROM u LEFT JOIN b ON b.page_id = u.page_id
"""
