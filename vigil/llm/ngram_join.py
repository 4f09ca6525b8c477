"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct shingles of 4 words. All sets are ordered
alike: rare shingles by hash, then frequent ones. Two sets of similarity t share
a signature in their prefixes, if a prefix is long enough: a rare shingle is a
signature by itself; frequent shingles fall into classes, and two of one class
make a signature, so each class takes one more shingle into the prefix. With
n1 rare and n_g frequent shingles of class g, the prefix ends when
n1 + sum(max(0, n_g - 1)) reaches |x| - ceil(t |x|) + 1. The number of classes
follows the size of the set; similar sets lie in the same band of sizes or in
adjacent ones, so combinations are made for both bands. What shares a signature
is verified on the whole sets, and links make components.

Which shingles count as frequent changes the work, never the result. The list
is counted over all documents, and has a fixed bound, so it may be broadcast.

Defined results: a document without a word, or null, has an empty set, links
with nothing and is its own component; with under 4 words the whole sequence is
its one shingle; equal sets are one class, whose members link; repeated rows of
an id share a component; a null id gets the smallest id of its component, or
null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import as_bytes, bucketed, forget, free_name, materialise, table
from vigil.llm.links import PART_BYTES, SKETCH, Sets, link, sketches, wide_sketches

WORDS = 4
#: Similarity in per cent.
LEAST = 85
#: A shingle of so many prefixes is frequent, of which there are at most so many.
FREQUENT_FROM, MAX_FREQUENT = 12, 1 << 17
#: Frequent shingles that a class has in a prefix, about.
CLASS_SIZE = 8
#: Sets that a task remembers so as to give signatures once; beyond, some get them again, which changes no result.
MAX_SEEN = 500_000
MASK = (1 << 64) - 1
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that part words.
SPACES = " \t\n\x0b\f\r"
WORD = ~np.isin(np.arange(256), list(SPACES.encode()))
VALUE = np.where(WORD, np.arange(1, 257), 0).astype(np.uint64)
BASE = np.uint64(0x9E6C63D0876A9A35)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts in UTF-8, in order, and the text of each: polynomials in BASE over their bytes, mixed."""
    a = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)  # a space comes first and last
    word = WORD[a]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, last = edge[::2] + 1, edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = powers(len(a))
    value = VALUE[a]
    value *= up
    total = np.cumsum(value, out=value)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mixed((total[last] - total[starts - 1]) * down[starts]), np.searchsorted(ends, starts, side="right")


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse (mod 2 ** 64) to the powers from 0 to n - 1 at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 1 << 16), x, np.uint64)))) for x in (BASE, INVERSE)]
    return [x[:n] for x in _POWERS]


class Shingler:
    """Sorted distinct hashes of the shingles of n words of texts in UTF-8, end to end, and where each text's begin and end."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, texts: list[bytes | None]) -> Sets:
        h, text = word_hashes([t.lower() if t else b"" for t in texts])
        n, words = self.n, np.bincount(text, minlength=len(texts))
        first = np.cumsum(words) - words
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * FACTORS[k]
        out = mixed(out)
        sizes = np.where(words >= n, words - n + 1, words > 0)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        values = np.empty(ends[-1], np.uint64)
        whole = text[: len(out)] == text[n - 1 :] if len(out) else np.empty(0, bool)
        values[np.repeat(words >= n, sizes)] = out[whole]
        for i in np.flatnonzero((words > 0) & (words < n)):  # the whole sequence as one
            w = h[first[i] : first[i] + words[i]]
            values[ends[i]] = mixed(mixed((w * FACTORS[: len(w)]).sum(keepdims=True)) + np.uint64(len(w)))[0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            values[a:b].sort()
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[ends[:-1][sizes > 0]] = True
        return values[new], np.concatenate(([0], np.cumsum(new)))[ends]

    def of_texts(self, texts: list[str]) -> Sets:
        return self([t.encode("utf-8", "surrogatepass") for t in texts])


def needed(size: int, least: int) -> int:
    """Length of a plain prefix: size - ceil(least % of size) + 1."""
    return size - -(-least * size // 100) + 1


def band(size: int, least: int) -> int:
    return int(np.floor(np.log(size) / -np.log(least / 100)))


def classes(b: int, least: int) -> int:
    """Classes of frequent shingles for sets of a band."""
    largest = (100 / least) ** (b + 1)
    return max(1, int(largest * (100 - least) / 100 / CLASS_SIZE))


def combinations(tokens: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Signatures of one set (sorted hashes, of which some are common) with fewer rare shingles than a plain prefix has."""
    size = len(tokens)
    often, rare = tokens[common], tokens[~common]
    out, missing = [rare], needed(size, least) - len(rare)
    b = band(size, least)
    for tag in (b, b + 1):
        n = classes(tag, least)
        group = ((often >> np.uint64(8)) % np.uint64(n)).astype(np.int64)
        # each shingle but the first of its class takes the prefix one further
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        gained = np.cumsum(~first)
        assert gained[-1] >= missing, "a prefix of too many classes"
        end = int(np.searchsorted(gained, missing)) + 1
        salt = np.uint64(tag * 0x9E3779B97F4A7C15 & MASK)
        order = np.argsort(group[:end], kind="stable")
        chosen, group = often[:end][order], group[:end][order]
        for part in np.split(chosen, np.flatnonzero(np.diff(group)) + 1):
            if len(part) > 1:
                i, j = np.triu_indices(len(part), 1)
                out.append(mixed(mixed(part[i] + salt) + part[j]))
    return np.unique(np.concatenate(out))


class Signer:
    """Signatures of sets, given the sorted hashes of frequent shingles."""

    def __init__(self, frequent: np.ndarray, least: int):
        self.frequent, self.least = frequent, least
        self.maybe = np.zeros(1 << 22, bool)  # by the low bits, before a search in the list
        self.maybe[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def common(self, values: np.ndarray) -> np.ndarray:
        out = self.maybe[(values & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.frequent[np.minimum(np.searchsorted(self.frequent, values[at]), len(self.frequent) - 1)] == values[at]
        return out

    def __call__(self, sets: Sets, wanted: np.ndarray) -> Sets:
        """Signatures of each wanted set, none for the others."""
        values, ends = sets
        sizes = np.diff(ends)
        p = sizes - -(-self.least * sizes // 100) + 1
        p[~wanted | (sizes * 100 < self.least * (sizes + 1))] = 0  # so small that only an equal set is similar
        common = self.common(values)
        rare_before = np.concatenate(([0], np.cumsum(~common)))
        rare = rare_before[ends[1:]] - rare_before[ends[:-1]]
        plain = rare >= p
        place = rare_before[:-1] - np.repeat(rare_before[ends[:-1]], sizes)
        chosen = ~common & (place < np.repeat(np.where(plain, p, 0), sizes))
        each = np.split(values[chosen], np.cumsum(np.where(plain, p, 0))[:-1])
        for i in np.flatnonzero(~plain):
            each[i] = combinations(values[ends[i] : ends[i + 1]], common[ends[i] : ends[i + 1]], self.least)
        return np.concatenate(each) if each else values[:0], np.cumsum([0, *map(len, each)])


def frequent_shingles(docs: DataFrame, key: str, text: str, n: int, least: int) -> np.ndarray:
    """Sorted hashes of at most MAX_FREQUENT shingles that the most plain prefixes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, total = Shingler(n), [], 0
        for batch in batches:
            for _, texts in as_bytes(batch, text, PART_BYTES):
                values, ends = shingles(texts)
                sizes = np.diff(ends)
                p = sizes - -(-least * sizes // 100) + 1
                held.append(values[np.arange(len(values)) - np.repeat(ends[:-1], sizes) < np.repeat(p, sizes)])
                total += len(held[-1])
                if total > 1_000_000:
                    yield counted(held)
                    held, total = [], 0
        if total:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    counts = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    counts = materialise(counts, "shingle-counts")
    left, least_count = MAX_FREQUENT, FREQUENT_FROM
    by_count = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step"))
    for r in by_count.collect():  # a few rows for each doubling of the count
        if r.k > left:
            break
        left, least_count = left - r.k, r.n
    else:
        least_count = FREQUENT_FROM
    if left == MAX_FREQUENT:
        return np.empty(0, np.uint64)
    found = counts.where(F.col("n") >= least_count).select("h").toPandas()["h"].to_numpy(np.int64)
    forget(counts)
    return np.sort(found.view(np.uint64))


def row_hash(key: Column, text: Column) -> Column:
    """A hash of id and text, never null: the same for repeated rows alone, whether or not they have an id."""
    return F.xxhash64(key, text)


#: Makes what gives the signatures of the wanted ones of some sets.
Signers = Callable[[], Callable[[Sets, np.ndarray], Sets]]


def shingle_sets(docs: DataFrame, key: str, text: str, n: int, signers: Signers) -> DataFrame:
    """key, _row (its row_hash()), n_shingles, set_id, sigs and the sketches of each row; of equal sets in a task only the first has signatures and sketches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signer, seen = Shingler(n), signers(), set()
        for batch in batches:
            for part, texts in as_bytes(batch, text, PART_BYTES):
                values, ends = sets = shingles(texts)
                sizes, ids, fresh = np.diff(ends), [], np.zeros(len(texts), bool)
                if len(seen) > MAX_SEEN:
                    seen.clear()
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    s = xxhash.xxh3_64_intdigest(values[a:b].data) >> 1 if b > a else None
                    ids.append(s)
                    if s is not None and s not in seen:
                        seen.add(s)
                        fresh[i] = True
                sigs, at = signer(sets, fresh)
                some = pa.array(np.flatnonzero(fresh))
                back = np.cumsum(fresh) - 1
                of_fresh = (values[np.repeat(fresh, sizes)], np.concatenate(([0], np.cumsum(sizes[fresh]))))
                made = [*sketches(of_fresh), pa.array(wide_sketches(of_fresh), pa.binary())] if len(some) else []
                sketch = [c.take(pa.array(back, mask=~fresh)) for c in made] or [*[pa.nulls(len(texts), pa.int64())] * len(SKETCH), pa.nulls(len(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in (key, "_row")), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sigs.view(np.int64))), *sketch],
                    names=[key, "_row", "n_shingles", "set_id", "sigs", *SKETCH, "wide"],
                )

    rows = docs.select(key, row_hash(F.col(key), F.col(text)).alias("_row"), text)
    return rows.mapInArrow(run, f"`{key}` {kind}, _row long, n_shingles long, set_id long, sigs array<long>, " + ", ".join(f"{s} long" for s in SKETCH) + ", wide binary")


def jaccard_parts(docs: DataFrame, key: str, text: str, n: int, least: int, signers: Signers | None = None) -> DataFrame:
    """_key, _row, n_shingles and _part (its component under links of similarity least %, null without a word) of each row.

    signers give sets their signatures; by default that is by token-combination prefixes. Few of them may be shared by a pair.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    few = signers is not None
    if signers is None:
        shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, "_key", "_text", n, least))

        def signers() -> Signer:
            return Signer(shared.value, least)

    sets = materialise(shingle_sets(rows, "_key", "_text", n, signers), "ngram-sets")
    known = sets.select("_key", "_row", "n_shingles", "set_id")
    sigs = sets.where(F.size("sigs") > 0).select("sigs", F.col("set_id").alias("id"), F.col("n_shingles").alias("size"))

    def prepare(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sketches and texts of some sets, each of one document, which need not have an id."""
        made = sets.where(F.col(SKETCH[0]).isNotNull()).select(F.col("set_id").alias("id"), F.col("_row").alias("row"), F.col("n_shingles").cast("int").alias("n"), *SKETCH, "wide")
        sketch = bucketed(made.join(ids, "id", "left_semi").dropDuplicates(["id"]), "id", "ngram-sketches", deal=False)
        texts = rows.select(row_hash(F.col("_key"), F.col("_text")).alias("row"), F.col("_text").alias("body"))
        # the texts move once: they stay where they met the wanted rows; repeated rows lie in one task
        bodies = texts.join(sketch.select("row").hint("shuffle_hash"), "row", "left_semi").dropDuplicates(["row"])
        return sketch, bucketed(bodies, "row", "ngram-bodies", deal=False)

    linked = link(sigs, prepare, Shingler(n).of_texts, least, least, few, "ngram")
    linked = linked.select(F.col("id").alias("set_id"), "component")
    return known.join(linked, "set_id", "left").select("_key", "_row", "n_shingles", F.coalesce("component", "set_id").alias("_part"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, least: int = LEAST, signers: Signers | None = None) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links of similarity least %) of each row."""
    placed = jaccard_parts(docs, key, text, n, least, signers)
    smallest = placed.where(F.col("_part").isNotNull()).groupBy("_part").agg(F.min("_key").alias("_least"))
    out = placed.join(smallest, "_part", "left")
    return out.select(F.col("_key").alias(key), "n_shingles", F.coalesce("_least", "_key").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The same by plain SQL, for small tables: all pairs that share a shingle, then reachability.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, b AS t FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.t)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(t) FROM r WHERE r.id = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Third stage of the pipeline: of each group of similar documents (5 words, 80 %) one row stays.

    That is one of the smallest id, or one without an id where no row of the group has one. Rows without a word all stay.
    """
    mark = free_name(docs, "_row")
    parts = jaccard_parts(docs, "doc_id", "text", 5, 80).where(F.col("_part").isNotNull())
    first = parts.groupBy("_part").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row")).alias("first"))
    wordless = F.coalesce(F.trim(F.col("text"), F.lit(SPACES)), F.lit("")) == ""
    d = docs.where(~wordless).withColumn(mark, row_hash(F.col("doc_id"), F.col("text"))).alias("d")
    k = first.select(F.col("first._row").alias("_kept")).hint("shuffle_hash").alias("k")
    kept = d.join(k, F.col(f"d.{mark}") == F.col("k._kept"), "left_semi").dropDuplicates([mark]).select(*docs.columns)
    return kept.unionByName(docs.where(wordless))
