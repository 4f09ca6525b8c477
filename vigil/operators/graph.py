"""Connected components of link tables: local union-find in every task, alternating stars between tasks, over written tables."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that a task contracts at once.
CHUNK = 1 << 18
#: Drops the shuffle files of a write once it has ended, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a new one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vigil-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, name: str = "table", deal: bool = True) -> DataFrame:
    """written(), dealt into as many buckets by a column as a shuffle has partitions: joins on that column move their other side alone.

    What comes out of a join or grouping on that column need not be dealt again.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"spark_catalog.default.vigil_{uuid.uuid4().hex}"
    with cleaned(spark):
        (df.repartition(n, by) if deal else df).write.format("parquet").bucketBy(n, by).option("path", new_path(spark, name)).saveAsTable(named)
    out = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # the name alone: the files lie outside the warehouse and stay
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), "vigil", f"{name}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on for what is written meanwhile."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def remove(df: DataFrame) -> None:
    """Delete what written() or bucketed() wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/vigil/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task, chunk by chunk, as links of each id to the smallest id that its chunk connects it with."""

    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while (above := up.get(x, x)) != top:
                up[x], x = top, above
            return top

        for u, v in pairs:
            a, b = root(u), root(v)
            low, high = (a, b) if a < b else (b, a)
            up[low], up[high] = low, low
            up.setdefault(u, low)
            up.setdefault(v, low)
        out = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        while len(held) > CHUNK:
            yield stars(held[:CHUNK])
            held = held[CHUNK:]
    if held:
        yield stars(held)


def contracted(links: DataFrame, rows: int) -> DataFrame:
    """links (u, v), of which there are so many, as stars of as few tasks as chunks suffice for."""
    return links.coalesce(max(1, -(-rows // CHUNK))).mapInArrow(local_stars, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, component (smallest reachable id) of the ids in edges (a, b).

    What fits one chunk is done by one union-find of bounded size. Beyond that, rounds of large and small stars, each
    followed by the union-find of every task, end when every id has one link and nothing links to it.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    n, old = e.count(), None
    while True:
        done = n <= CHUNK
        e = written(contracted(e, n), name)
        if old is not None:
            remove(old)
        if done or are_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        old = written(large.alias("e").join(low, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct(), name)
        remove(e)
        e, n = old, old.count()
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component")).distinct()
    return found.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def are_stars(links: DataFrame) -> bool:
    """Whether every id that links to a smaller one has one such link, and nothing links to it."""
    ends = links.distinct().select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
    bad = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least")).where("out > 1 OR (out = 1 AND least = 0)")
    return bad.isEmpty()
