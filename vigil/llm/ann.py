"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random orthogonal directions, shifted, and put
in the order of a Hilbert curve, CURVES times. Spark range-partitions each
order; a query meets the vectors at most ``reach`` places from it in some
order, block by block, and the nearest of all blocks are merged and ranked by
the exact inner product. The reach is fitted, alike at every size: a bounded
sample of queries is searched exactly, and the shortest reach that finds TARGET
of their neighbours serves all; every vector is indexed. On clustered data that
is about a cluster. Random directions in many dimensions have no order that a
curve could follow; there the reach becomes a share of the table.

Equal vectors are searched once. Of equal vectors only the K + 1 with the
smallest ids can be among anyone's K nearest, so only those are candidates.

Defined results: vectors that are null, zero, or hold a null or a component
that isn't finite take no part, nor do vectors of another length than most;
ties go to the smaller id; with fewer candidates than K all are returned;
rows of one id with other vectors count as different, rows equal in both once; an
empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.llm.common import materialise, table

K = 20
CURVES, DIRECTIONS, BITS, BLOCK = 8, 8, 7, 2048
#: Queries and vectors of the fit, the share of true neighbours that it asks for, and the least reach.
FIT_QUERIES, FIT_VECTORS, TARGET, LEAST_REACH = 96, 4096, 0.94, 32
#: Queries that meet a block in one task, about.
BLOCK_QUERIES = 4096
SALTS = 32
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point (rows; coordinates of so many bits) on the Hilbert curve."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections, from the coarsest bit
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def directions(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve the directions (dim x DIRECTIONS) and the shifts (in cells)."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(CURVES):
        m = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(DIRECTIONS, dim)]
        out.append((m, rng.random(m.shape[1])))
    return out


def curve_keys(x: np.ndarray, curves: list, spread: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Keys (rows x CURVES); cells hold about equally many vectors of a bell-shaped projection."""
    keys = np.empty((len(x), len(curves)), np.int64)
    for c, ((m, shift), (mean, std)) in enumerate(zip(curves, spread, strict=True)):
        y = 1 / (1 + np.exp(np.clip(-1.702 * (x @ m - mean) / std, -50, 50)))
        cells = np.floor(y * ((1 << BITS) - 1) + shift)
        keys[:, c] = hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return keys


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest (ids, scores) among some rows, scores summed in one fixed way, ties to smaller ids."""
    score = (vectors[among] * query).sum(axis=1)
    order = np.lexsort((ids[among], -score))[:k]
    return ids[among][order], score[order]


def nearest_in(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, allowed: np.ndarray | None, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest rows of x (that allowed lets it see): a product picks them, exact sums rank them."""
    out = []
    for start in range(0, len(queries), 256):
        q = queries[start : start + 256]
        s = q @ x.T
        if allowed is not None:
            s[~allowed[start : start + 256]] = -np.inf
        m = min(k, s.shape[1])
        edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        for i in range(len(q)):
            row = s[i]
            # everything that rounding could put level with the last one
            among = np.flatnonzero((row >= edge[i] - 1e-9 * (1 + abs(edge[i]))) & np.isfinite(row)) if np.isfinite(edge[i]) else np.flatnonzero(np.isfinite(row))
            out.append(best(ids, x, q[i], among, k))
    return out


def search(vectors: DataFrame, is_query: str, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) that the SQL condition is_query names."""
    e = F.col("embedding")
    usable = e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    x = vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", e.cast("array<double>").alias("v"), F.expr(is_query).alias("q"))
    # -0.0 and 0.0 are equal as numbers, so they hash alike
    x = x.withColumn("h", F.xxhash64(F.transform("v", lambda a: F.when(a == 0, 0.0).otherwise(a)))).withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    sizes = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0].d
    x = x.where(F.size("v") == dim)
    # the k + 1 smallest ids of each vector, first by salt
    first = x.withColumn("n", F.row_number().over(W.partitionBy("h", "s").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    first = first.withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    asked = x.where("q").select("h").distinct().withColumn("asked", F.lit(True))
    first = first.join(asked, "h", "left").select("vec_id", "v", "h", "n", (F.coalesce("asked", F.lit(False)) & (F.col("n") == 1)).alias("asks"))

    curves = directions(dim)
    plain = materialise(first, "ann-vectors")
    total = plain.count()
    share = min(1.0, FIT_VECTORS / max(1, total))
    some = plain.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toPandas()["v"]
    some = np.array(some.tolist(), np.float64).reshape(len(some), dim)
    spread = [((some @ m).mean(0), (some @ m).std(0) + 1e-12) if len(some) else (np.zeros(m.shape[1]), np.ones(m.shape[1])) for m, _ in curves]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = curve_keys(matrix(b.column(1), dim), curves, spread)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(CURVES, dtype=np.int32), b.num_rows)), pa.array(keys.reshape(-1)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), CURVES)))],
                    names=["curve", "key", "vec_id"],
                )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = np.zeros(CURVES, np.int64), TaskContext.get().partitionId()
        for b in batches:
            curve = b.column(0).to_numpy()
            place = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                mine = curve == c
                place[mine] = at[c] + np.arange(mine.sum())
                at[c] += mine.sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(curve), part, np.int32)), pa.array(place)], names=["curve", "vec_id", "part", "place"])

    ways = max(CURVES, -(-total * CURVES // 100_000))
    order = plain.select("vec_id", "v").mapInArrow(keyed, "curve int, key long, vec_id long")
    order = order.repartitionByRange(ways, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    order = materialise(order.mapInArrow(placed, "curve int, vec_id long, part int, place long"), "ann-order")
    # a number for each curve and partition
    before = order.groupBy("curve", "part").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    order = materialise(order.join(before, ["curve", "part"]).select("curve", "vec_id", (F.col("place") + F.col("before")).alias("pos")), "ann-places")

    asking = plain.where("asks").count()
    reach = fit_reach(plain, order, asking, dim, k)
    at = order.join(plain, "vec_id")
    salts = max(1, -(-(block + 2 * reach) * asking // (max(1, total) * BLOCK_QUERIES)))
    blocks = at.select("curve", F.floor(F.col("pos") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pos", "vec_id", "v")
    edge = lambda p: F.floor(p / block)
    touched = F.sequence(edge(F.greatest(F.col("pos") - reach, F.lit(0))), edge(F.least(F.col("pos") + reach, F.lit(total - 1))))
    near = at.where("asks").select(
        F.col("curve").alias("to_curve"), F.explode(touched).alias("to_block"), F.pmod(F.col("h"), F.lit(salts)).cast("int").alias("to_salt"), F.col("pos").alias("from_pos"), F.col("h").alias("from_h"), F.col("v").alias("from_v")
    )

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        if not left.num_rows or not right.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "curve": pa.array([], pa.int32()), "found": pa.array([], kind)})
        ids, pos = left["vec_id"].to_numpy(), left["pos"].to_numpy()
        x, q = matrix(left["v"].combine_chunks(), dim), matrix(right["from_v"].combine_chunks(), dim)
        asked, mine, out = right["from_h"].to_numpy(), right["from_pos"].to_numpy(), []
        for s in range(0, len(q), 256):
            allowed = np.abs(mine[s : s + 256, None] - pos[None, :]) <= reach
            out += nearest_in(ids, x, q[s : s + 256], None if allowed.all() else allowed, k + 1)
        ends = np.cumsum([0, *(len(a) for a, _ in out)])
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([s for _, s in out])), pa.array(np.concatenate([a for a, _ in out]))], fields=list(kind.value_type))
        return pa.table({"h": pa.array(asked), "curve": right["to_curve"], "found": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)})

    schema = "h long, curve int, found array<struct<score:double,vec_id:long>>"
    found = blocks.groupBy("curve", "block", "salt").cogroup(near.groupBy("to_curve", "to_block", "to_salt")).applyInArrow(scan, schema)

    def merged(lists: DataFrame, *by: str) -> DataFrame:
        """The k + 1 best of the lists of each group; an id may be in several, with one score."""
        best = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))), lambda p, q: F.when(p["score"] > q["score"], -1).when(p["score"] < q["score"], 1).when(p["vec_id"] < q["vec_id"], -1).when(p["vec_id"] > q["vec_id"], 1).otherwise(0))
        return lists.groupBy(*by).agg(F.slice(best, 1, k + 1).alias("found"))

    # the blocks of a curve first, then the curves
    lists = merged(merged(found, "h", "curve"), "h")
    mine = x.where("q").select(F.col("vec_id").alias("query_id"), "h").join(lists, "h")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def fit_reach(plain: DataFrame, order: DataFrame, asking: int, dim: int, k: int) -> int:
    """Places on either side of a query that the search looks at, from an exact search for a sample of queries."""
    share = min(1.0, FIT_QUERIES / max(1, asking))
    sample = plain.where("asks").where(F.pmod(F.xxhash64(F.lit("reach"), "vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("vec_id", "v").toPandas()
    if not len(sample):
        return LEAST_REACH
    own, queries = sample["vec_id"].to_numpy(), np.array(sample["v"].tolist(), np.float64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = nearest_in(b.column(0).to_numpy(), matrix(b.column(1), dim), queries, None, k + 1)
                yield pa.RecordBatch.from_pydict({"a": np.repeat(own, [len(i) for i, _ in got]), "vec_id": np.concatenate([i for i, _ in got]), "score": np.concatenate([s for _, s in got])})

    near = plain.select("vec_id", "v").mapInArrow(exact, "a long, vec_id long, score double").where("a <> vec_id")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
    a, b = order.alias("a"), order.alias("b")
    pairs = near.alias("n").join(b, F.col("n.vec_id") == F.col("b.vec_id")).join(a, (F.col("n.a") == F.col("a.vec_id")) & (F.col("a.curve") == F.col("b.curve")))
    gaps: pd.DataFrame = pairs.groupBy("n.a", "n.vec_id").agg(F.min(F.abs(F.col("a.pos") - F.col("b.pos"))).alias("gap")).toPandas()
    return max(LEAST_REACH, int(gaps["gap"].quantile(TARGET, "higher"))) if len(gaps) else LEAST_REACH


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0")
