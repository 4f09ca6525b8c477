"""Upkeep of the small tables: cameras and their zones, persons and their poses, settings, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The poses that an enrolment has, once each.
POSES = ("front", "left", "right", "up", "down")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with those of changes (same columns) in place of equal keys, the last of a key by its column _seq; removed ones (_removed) go."""
    columns = rows.columns
    newest = changes.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_seq")))).where("_n = 1")
    old = rows.join(newest.select(key), key, "left_anti")
    return old.select(*columns).unionByName(newest.where("NOT _removed").select(*columns))


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there, so that none comes back with a reused key."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def merged(old: DataFrame, new: DataFrame, key: str, fields: list[str], secrets: list[str]) -> DataFrame:
    """Rows after a partial update: fields that are given override, and a blank secret keeps the old one."""
    o, n = old.alias("o"), new.alias("n")
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"n.{c}")), F.lit("")) if c in secrets else F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"o.{key}").alias(key), *[value(c) for c in [*fields, *secrets]])


def setting(environment: Column, file: Column, site: Column, default: Column) -> Column:
    """A setting by precedence: environment, then the file beside it, then the site's configuration, then the default; blanks don't count."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (environment, file, site)], default)


def enrolments(poses: DataFrame) -> DataFrame:
    """person_id, n and accepted: whether a person's poses are the required ones, each once."""
    x = poses.groupBy("person_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pose")).alias("_poses"))
    return x.select("person_id", "n", ((F.col("n") == len(POSES)) & (F.col("_poses") == F.sort_array(F.array(*map(F.lit, POSES))))).alias("accepted"))


def gallery_after(gallery: DataFrame, enrolled: DataFrame, deleted: DataFrame) -> DataFrame:
    """The gallery with accepted enrolments in place of a person's old poses, and without deleted persons."""
    accepted = enrolments(enrolled).where("accepted").select("person_id")
    kept = gallery.join(accepted, "person_id", "left_anti").unionByName(enrolled.join(accepted, "person_id", "left_semi"))
    return kept.join(deleted.select("person_id"), "person_id", "left_anti")


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the name of their key, or the key itself."""
    return rows.join(names.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.col(key).cast("string")))


def health(cameras: DataFrame, running: DataFrame, stale_s: float, now: Column) -> DataFrame:
    """camera_id and status: up, stale (no frame for stale_s seconds) or down (no pipeline); running: camera_id, last_ts."""
    x = cameras.select("camera_id").join(running, "camera_id", "left")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / F.lit(1e6)
    return x.select("camera_id", F.when(F.col("last_ts").isNull(), "down").when(age > stale_s, "stale").otherwise("up").alias("status"))


def uploads(lines: DataFrame) -> DataFrame:
    """name and uploaded_at of upload records (column json), the newest first; records that don't parse or have no date are left out."""
    r = F.from_json("json", "name string, uploaded_at timestamp_ntz")
    return lines.select(r.alias("r")).where("r.uploaded_at IS NOT NULL AND r.name IS NOT NULL").select("r.name", "r.uploaded_at").orderBy(F.desc("uploaded_at"), "name")


def split_of(path: Column) -> Column:
    """train, test or val by a folder of a path, valid counting as val; all where no folder says."""
    part = F.regexp_extract(path, r"(?:^|/)(train|test|val|valid)(?:/|$)", 1)
    return F.when(part == "", "all").when(part == "valid", "val").otherwise(part)


def stem(path: Column) -> Column:
    """A file's name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def number_key(name: Column) -> Column:
    """Sorts names by their first number, those without one by the name: struct (has none, number, name)."""
    n = F.regexp_extract(name, r"([0-9]+)", 1)
    return F.struct((n == "").alias("none"), F.when(n != "", n.cast("decimal(38,0)")).alias("number"), name.alias("name"))


def utc(epoch_s: Column, stamp: Column) -> Column:
    """An event's time: seconds since 1970 if given, else its stamp, which is UTC if it says nothing."""
    return F.coalesce(F.timestamp_micros((epoch_s * 1_000_000).cast("long")), stamp.cast("timestamp"))


def redacted(url: Column) -> Column:
    """A URL without the name and password in it."""
    return F.regexp_replace(F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1***@"), r"[?].*$", "?***")


def counted(owners: DataFrame, rows: DataFrame, key: str, member: str) -> DataFrame:
    """key and n of every owner: how many members it has, 0 where it has none."""
    return owners.select(key).distinct().join(rows.select(key, member), key, "left").groupBy(key).agg(F.count(member).alias("n"))
