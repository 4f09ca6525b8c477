"""From shared signatures to verified links and connected components, as Spark jobs.

Two ids that share a signature may be alike; the similarity of their sets
decides. Most signatures belong to one id alone, and go first: they are packed
into blocks by a hash, and each task sorts its blocks as arrays. What stays are
rows (sig, id, size). Every id is first verified against
one partner: of those next to it in the order of its groups, the one it stands
next to most often. Then members of a group that are still apart are verified against
the most alike of those near them in a few chance orders. That connects groups of near
copies with a few pairs an id. Only what is still apart in some group then meets
each other, and of these only pairs whose sketches leave their similarity open
are verified on whole sets, so none of the groups' links is lost.

A sketch is the parity of how many elements of a set fall on each of its
places. Where two sketches differ, exactly one of the sets has an element, so
the number of such places never exceeds what the sets differ in: dropping a
pair for that loses no link. In a sketch of SKETCH_BITS places large sets are all
alike, so they have a wide one too, of as many places as elements, which the pairs
that the first leaves open meet before any text does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import forget, materialise
from vigil.operators.graph import components

#: 64-bit parts of a sketch, and their names.
SKETCH_LONGS = 16
SKETCH = [f"s{k}" for k in range(SKETCH_LONGS)]
SKETCH_BITS = 64 * SKETCH_LONGS
#: Chance orders at most; members ahead in an order that each is held against, by stretches; links for each row below which no further order is worth it.
ROUNDS, AHEAD, STRETCH, FEW = 3, 64, 16, 0.004
#: A signature of an id, and what spreads signatures over partitions.
SIGNATURE, SPREAD = np.dtype([("sig", np.int64), ("id", np.int64), ("size", np.int32)]), np.uint64(0x9E3779B97F4A7C15)
#: Signatures that a task packs at once, those (and rows of lists) of a block at most, and those that a task sorts at once.
PACKED, BLOCK, HELD = 1 << 19, 1 << 10, 1 << 22
#: Bytes of text that are made into sets at once.
PART_BYTES = 1 << 18

#: Sorted distinct 64-bit hashes of each of some texts, end to end, and where each text's begin and end.
Sets = tuple[np.ndarray, np.ndarray]


def sketches(sets: Sets) -> list[pa.Array]:
    """SKETCH_LONGS columns of the parities of each set."""
    values, ends = sets
    n = len(ends) - 1
    place = np.repeat(np.arange(n), np.diff(ends)) * SKETCH_BITS + ((values >> np.uint64(23)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    packed = np.packbits(odd).view(np.int64).reshape(n, SKETCH_LONGS)
    return [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(SKETCH_LONGS)]


def wide_sketches(sets: Sets) -> list[bytes | None]:
    """The parities of each set of more than SKETCH_BITS elements, by a power of two of places that is at least their number."""
    values, ends = sets
    out: list[bytes | None] = [None] * (len(ends) - 1)
    for i in np.flatnonzero(np.diff(ends) > SKETCH_BITS).tolist():
        places = 1 << int(ends[i + 1] - ends[i] - 1).bit_length()
        at = ((values[ends[i] : ends[i + 1]] >> np.uint64(23)) % np.uint64(places)).astype(np.int64)
        out[i] = np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8)).tobytes()
    return out


def places_apart(p: bytes, q: bytes) -> int:
    """Places where two wide sketches differ; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    m = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(np.concatenate((x, y)).reshape(-1, m))).sum())


def in_parts(texts: list, size: Callable[..., int] = len) -> Iterator[list]:
    """Runs of texts (or what else has a size) of about PART_BYTES."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += size(t)
        if held >= PART_BYTES:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def with_sketches(bodies: DataFrame, sets_of: Callable[[list[str]], Sets]) -> DataFrame:
    """id, body, n (size of its set) and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in in_parts(batch.column(1).to_pylist()):
                sets = sets_of(texts)
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(sets[1]).astype(np.int32)), *sketches(sets)], names=["id", "body", "n", *SKETCH])

    return bodies.select("id", "body").mapInArrow(run, "id long, body string, n int, " + ", ".join(f"{s} long" for s in SKETCH))


def may_be_similar(a: str, b: str, least: int) -> Column:
    """False only where the sketches of a and b (aliases with n and a sketch) prove that their sets are less similar than least %."""
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH), F.lit(0))
    return (100 + least) * apart <= (100 - least) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def open_pairs(pairs: DataFrame, sketch: DataFrame, least: int) -> DataFrame:
    """Those pairs (a, b) that wide sketches leave open, with row_a and row_b, the ids of their bodies; sketch: id, n, wide, row."""
    x, y = (sketch.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "wide", "row"))) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p, q = batch.column("n").to_numpy(), batch.column("wide_a"), batch.column("wide_b")
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(pc.and_(p.is_valid(), q.is_valid()).to_numpy(zero_copy_only=False)).tolist():
                keep[i] = (100 + least) * places_apart(p[i].as_py(), q[i].as_py()) <= (100 - least) * n[i]
            yield batch.select(["a", "b", "row_a", "row_b"]).filter(pa.array(keep))

    both = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "row_a", "row_b", (F.col("n_a") + F.col("n_b")).alias("n"), "wide_a", "wide_b")
    return both.mapInArrow(run, "a long, b long, row_a long, row_b long")


def similar_pairs(pairs: DataFrame, bodies: DataFrame, sets_of: Callable[[list[str]], Sets], least: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar by least %, on their whole texts; bodies: id, body, or row, body where pairs have row_a and row_b."""
    if "row" in bodies.columns:
        x = bodies.select(F.col("row").alias("row_a"), F.col("body").alias("x"))
        y = bodies.select(F.col("row").alias("row_b"), F.col("body").alias("y"))
        both = pairs.join(y, "row_b").join(x, "row_a")
    else:
        x = bodies.select(F.col("id").alias("a"), F.col("body").alias("x"))
        y = bodies.select(F.col("id").alias("b"), F.col("body").alias("y"))
        both = pairs.join(y, "b").join(x, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, first = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            keep = []
            for some in in_parts(list(zip(left, right, strict=True)), lambda p: len(p[0]) + len(p[1])):
                of = {t: k for k, t in enumerate(dict.fromkeys(t for p in some for t in p))}
                values, ends = sets_of(list(of))
                for i, (x, y) in enumerate(some):
                    p, q = values[ends[of[x]] : ends[of[x] + 1]], values[ends[of[y]] : ends[of[y] + 1]]
                    both = np.concatenate((p, q))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= least * (len(both) - common):
                        keep.append(first + i)
                first += len(some)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shared_signatures(sets: DataFrame, most: int = HELD) -> DataFrame:
    """sig, id, size of the signatures that several ids have; sets: sigs (an array without nulls), id, size.

    A task that gets more than so many rows passes all of them on, which loses none, so that its memory is bounded.
    """
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(SIGNATURE.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in (b.slice(k, BLOCK) for b in batches for k in range(0, b.num_rows, BLOCK)):
            sigs, ids, size = batch.columns
            counts = pc.list_value_length(sigs).to_numpy()
            x = np.empty(int(counts.sum()), SIGNATURE)
            x["sig"], x["id"], x["size"] = sigs.flatten().to_numpy(), np.repeat(ids.to_numpy(), counts), np.repeat(size.to_numpy(), counts)
            held.append(x)
            total += len(x)
            if total >= PACKED:
                yield blocks(np.concatenate(held))
                held, total = [], 0
        if total:
            yield blocks(np.concatenate(held))

    def blocks(x: np.ndarray) -> pa.RecordBatch:
        part = ((x["sig"].view(np.uint64) * SPREAD >> np.uint64(32)) % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        x, part = x[order], part[order]
        starts = np.union1d(np.arange(0, len(x), BLOCK), np.flatnonzero(part[1:] != part[:-1]) + 1)
        at = np.append(starts, len(x)).astype(np.int32) * SIGNATURE.itemsize
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(x.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), packed], names=["part", "rows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(np.frombuffer(b"".join(batch.column(0).to_pylist()), SIGNATURE))
            total += len(held[-1])
            if total > most:
                yield from map(rows, held)
                held = []
        if held:
            yield rows(several(np.concatenate(held)) if total <= most else np.concatenate(held))

    def several(x: np.ndarray) -> np.ndarray:
        """Those of x whose signature has another id too."""
        x = x[np.argsort(x["sig"])]
        sig = x["sig"]
        same = sig[1:] == sig[:-1]
        other = np.zeros(len(x), bool)
        other[1:] = same
        other[:-1] |= same
        x = x[other]
        if not len(x):
            return x
        new = np.ones(len(x), bool)
        new[1:] = x["sig"][1:] != x["sig"][:-1]
        differs = np.zeros(len(x), bool)
        differs[1:] = ~new[1:] & (x["id"][1:] != x["id"][:-1])
        return x[np.logical_or.reduceat(differs, np.flatnonzero(new))[np.cumsum(new) - 1]]

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in names], names=names)

    wide = sets.select("sigs", "id", F.col("size").cast("int").alias("size"))
    packed = wide.mapInArrow(pack, "part int, rows binary").repartitionById(n, F.col("part"))
    return packed.select("rows").mapInArrow(unpack, "sig long, id long, size int")


def neighbours(signatures: DataFrame, similar_size: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """sig, id, size, before of the ids that may have a partner in some group; before: the one ahead in the order of sizes, if alike in size.

    Rows are range-partitioned in that order, so a large group goes to several tasks. What has no neighbour of a
    similar size there has no partner at all; the first and last rows of a task stay, as their neighbours are elsewhere.
    """
    kinds = "sig long, id long, size int, before long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, ...] | None = None  # sig, id, size, before and whether it stays, of the latest row
        for batch in batches:
            sig, ids, size = (batch.column(k).to_numpy() for k in range(3))
            if not len(sig):
                continue
            if last is not None:
                sig, ids, size = (np.concatenate((p, q)) for p, q in zip(last[:3], (sig, ids, size), strict=True))
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
            sig, ids, size = sig[fresh], ids[fresh], size[fresh]
            alike = np.zeros(len(sig), bool)
            alike[1:] = (sig[1:] == sig[:-1]) & similar_size(size[:-1], size[1:])
            before = np.where(alike, np.roll(ids, 1), -1)
            stays = alike.copy()
            stays[:-1] |= alike[1:]
            if last is None:
                stays[0] = True
            else:
                before[0] = last[3][0]
                stays[0] |= last[4][0]
            last = tuple(x[-1:] for x in (sig, ids, size, before, stays))
            yield rows(*(x[:-1] for x in (sig, ids, size, before, stays)))
        if last is not None:
            yield rows(*last[:4], np.ones(1, bool))

    def rows(sig: np.ndarray, ids: np.ndarray, size: np.ndarray, before: np.ndarray, stays: np.ndarray) -> pa.RecordBatch:
        before = before[stays]
        return pa.RecordBatch.from_arrays([pa.array(sig[stays]), pa.array(ids[stays]), pa.array(size[stays], pa.int32()), pa.array(before, mask=before < 0)], names=["sig", "id", "size", "before"])

    order = signatures.select("sig", "id", F.col("size").cast("int").alias("size")).repartitionByRange("sig", "size", "id")
    return order.sortWithinPartitions("sig", "size", "id").mapInArrow(run, kinds)


def chance_pairs(members: DataFrame, k: int, least: int, ratio: int) -> DataFrame:
    """Pairs (a, b) of one group in the k-th chance order: each member with those of the AHEAD before it, in other parts, whose sketches are most like its own in each stretch, if similar.

    Range-partitioned in that order, so a large group goes to several tasks.
    """
    columns = ["sig", "id", "size", "part", "n", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        for batch in batches:
            x = [batch.column(c).to_numpy() for c in columns]
            old = 0
            if last is not None:
                old, x = len(last[0]), [np.concatenate((p, q)) for p, q in zip(last, x, strict=True)]
            sig, ids, size, part, n, *sketch = x
            pairs = []
            for first in range(1, AHEAD, STRETCH):
                nearest, least_apart = np.full(len(sig), -1), np.full(len(sig), SKETCH_BITS + 1)
                for ahead in range(first, first + STRETCH):
                    at = np.arange(max(old, ahead), len(sig))
                    at = at[(sig[at] == sig[at - ahead]) & (part[at] != part[at - ahead])]
                    at = at[100 * np.minimum(size[at], size[at - ahead]).astype(np.int64) >= ratio * np.maximum(size[at], size[at - ahead]).astype(np.int64)]
                    if len(at):
                        apart = sum(np.bitwise_count(s[at] ^ s[at - ahead]).astype(np.int64) for s in sketch)
                        closer = ((100 + least) * apart <= (100 - least) * (n[at] + n[at - ahead])) & (apart < least_apart[at])
                        nearest[at[closer]], least_apart[at[closer]] = at[closer] - ahead, apart[closer]
                at = np.flatnonzero(nearest >= 0)
                pairs.append(np.sort(np.stack((ids[at], ids[nearest[at]])), axis=0))
            one, other = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], names=["a", "b"])
            last = [c[-AHEAD:] for c in x]

    chance = F.xxhash64(F.lit(k), "id")
    order = members.select(*columns, chance.alias("chance")).repartitionByRange("sig", "chance").sortWithinPartitions("sig", "chance")
    return order.select(*columns).mapInArrow(run, "a long, b long")


def link(signatures: DataFrame, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame]], sets_of: Callable[[list[str]], Sets], least: int, ratio: int, few: bool, name: str) -> DataFrame:
    """id, component of all ids that links of similarity least % connect. Ids are not negative.

    signatures: sigs (an array), id, size. Sizes can only be alike if the smaller one is at least ratio % of the larger. For ids
    that share a signature, prepare writes id, n and sketch, and id and body; sets_of makes sets of bodies. Where sets may
    be large, the sketches have wide ones and row too, and bodies are row, body. Each verification meets the bodies, so
    these had better be bucketed() by their id.
    """
    several = materialise(shared_signatures(signatures), f"{name}-several")
    shared = materialise(neighbours(several, lambda x, y: 100 * np.minimum(x, y).astype(np.int64) >= ratio * np.maximum(x, y).astype(np.int64)), f"{name}-shared")
    forget(several)
    sketch, bodies = prepare(shared.select("id").distinct())

    def apart(members: DataFrame, parts: DataFrame) -> DataFrame:
        """Members of groups that hold more than one component, with their part."""
        x = members.drop("part").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        mixed = x.groupBy("sig").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("sig")
        return x.join(mixed, "sig", "left_semi")

    def sketched(members: DataFrame) -> DataFrame:
        """Members with their sketches, which are far larger: they join where they are compared, not before."""
        return members.join(sketch.select("id", "n", *SKETCH), "id")

    def alike(p: str, q: str) -> Column:
        sizes = (100 * F.col(f"{p}.size") >= ratio * F.col(f"{q}.size")) & (100 * F.col(f"{q}.size") >= ratio * F.col(f"{p}.size"))
        return (F.col(f"{p}.part") != F.col(f"{q}.part")) & sizes & may_be_similar(p, q, least)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = open_pairs(pairs, sketch, least) if "wide" in sketch.columns else pairs
        return materialise(similar_pairs(pairs, bodies, sets_of, least), f"{name}-links")

    # each id with the neighbour that most of its groups give it
    often = shared.where("before IS NOT NULL").groupBy("id", "before").agg(F.count("*").alias("k"))
    first = often.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("k", (-F.col("before")).alias("back"))).alias("m")).select((-F.col("m.back")).alias("a"), "b")
    first = first.alias("p").join(sketch.alias("x"), F.col("p.a") == F.col("x.id")).join(sketch.alias("y"), (F.col("p.b") == F.col("y.id")) & may_be_similar("x", "y", least)).select("p.a", "p.b")
    links = verified(first)
    parts = components(links, f"{name}-parts")

    # members of a group with those near them in chance orders, until that hardly connects any more
    y = materialise(apart(shared.select("sig", "id", "size"), parts), f"{name}-apart")
    forget(shared)
    for k in range(ROUNDS):
        more = verified(chance_pairs(sketched(y), k, least, ratio).distinct())
        found = more.count()
        if found:
            links = links.unionByName(more)
            parts = components(links, f"{name}-parts")
            after = materialise(apart(y, parts), f"{name}-apart")
            forget(y)
            y = after
        if found <= y.count() * FEW:
            break

    # the rest pair by pair, where sizes and sketches allow
    if few:  # a pair only in the first of the groups that it shares
        y = y.join(y.groupBy("id").agg(F.sort_array(F.collect_set("sig")).alias("sigs")), "id")
    y = sketched(y)
    p, q = y.alias("p"), y.alias("q")
    meet = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.id") < F.col("q.id")) & alike("p", "q")
    if few:
        meet = meet & (F.get(F.array_intersect("p.sigs", "q.sigs"), F.lit(0)) == F.col("p.sig"))
    rest = p.join(q, meet).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    links = links.unionByName(verified(rest if few else rest.distinct()))
    return components(links, f"{name}-components")
