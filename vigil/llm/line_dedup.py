"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case without white space at their ends. Equal lines
are one class. Each class gets a one-permutation MinHash signature over its
character shingles, cut into bands; classes that share a band are verified by
the exact Jaccard similarity of their shingle sets, verified links make
components, and of each component the first line (smallest document id, then
position, then the row's hash) stays. Lines too short for a shingle are
compared for equality alone.

Defined results: lines without a letter or digit are never removed; a null text
stays null and an empty one empty; of equal lines in one document the first
stays; a text that loses lines keeps the others in order; repeated rows (equal
id and text) lose lines alike, and rows of one id with other texts are
documents of their own; lines of rows with a null id come after all others, by
their rows' hash; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import bucketed, free_name, materialise, slices, table
from vigil.llm.links import SKETCH, Sets, link, with_sketches
from vigil.llm.ngram_join import mixed, row_hash

#: Characters of a shingle, least similarity in per cent.
SHINGLE, LEAST = 7, 80
COUNTS = re.compile(r"[^\W_]").search
#: Lines that a task remembers so as to give bands once; beyond, some get them again, which changes no result.
MAX_SEEN = 500_000
#: Bands and values of each: similar lines (0.8) share a band with probability 1 - (1 - 0.8 ** 5) ** 10 = 0.98.
BANDS, ROWS = 10, 5
BINS = BANDS * ROWS
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0x9E3779B97F4A7C15**2 % 2**64)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Characters whose hashes are in memory at once: so few that arrays of them stay in a core's cache.
PART_CHARS = 64_000


def line_form(line: str) -> str:
    return line.strip().lower()


def line_hash(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass")) >> 1


def shingle_hashes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of some lines of at least SHINGLE characters, and how many each has."""
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    # polynomials over 2, 4, 6 and then 7 characters
    two = c[:-1] * STEP + c[1:]
    four = two[:-2] * STEP2 + two[2:]
    six = four[:-2] * STEP2 + two[4:]
    h = six[:-1] * STEP + c[6:]
    inside = np.ones(len(h), bool)
    ends = np.cumsum(lengths)[:-1]
    for k in range(1, SHINGLE):  # shingles that reach into the next line
        inside[ends - k] = False
    return mixed(h[inside]), lengths - SHINGLE + 1


def minhash_bands(forms: list[str]) -> np.ndarray:
    """BANDS 64-bit band keys of each line: the least hash of each bin, empty bins filled from the next full one."""
    keys, start, held = [], 0, 0
    for i, form in enumerate(forms):
        held += len(form)
        if held >= PART_CHARS or i + 1 == len(forms):
            keys.append(part_bands(forms[start : i + 1]))
            start, held = i + 1, 0
    return np.concatenate(keys)


def part_bands(forms: list[str]) -> np.ndarray:
    h, n = shingle_hashes(forms)
    bins = np.full(len(forms) * BINS, EMPTY, np.uint64)
    at = np.repeat(np.arange(len(forms)) * BINS, n) + ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(bins, at, h * STEP)
    bins = bins.reshape(len(forms), BINS)
    fill(bins)
    keys = np.zeros((len(forms), BANDS), np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * STEP + bins[:, k::ROWS])
    return mixed(keys + np.arange(BANDS, dtype=np.uint64))


def fill(bins: np.ndarray) -> None:
    """Give each empty bin, in place, the value of the next full one in the circle of its row, plus STEP for each bin on the way."""
    rows = np.flatnonzero((bins == EMPTY).any(axis=1))
    some = bins[rows]
    place = np.where(some != EMPTY, np.arange(BINS), 2 * BINS)
    place = np.concatenate((place, place + BINS), axis=1)
    full = np.minimum.accumulate(place[:, ::-1], axis=1)[:, : BINS - 1 : -1]
    bins[rows] = np.take_along_axis(some, full % BINS, axis=1) + (full - np.arange(BINS)).astype(np.uint64) * STEP


def sets_of(forms: list[str]) -> Sets:
    """Sorted distinct shingle hashes of lines."""
    h, n = shingle_hashes(forms)
    ends = np.concatenate(([0], np.cumsum(n)))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[ends[:-1]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[ends]


def line_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, _row (its row_hash()), at (position), line_id (hash of its form), size, bands of each line that counts; equal lines of a task have bands once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, texts in slices(batch, text):
                rows, at, ids, sizes, fresh, forms = [], [], [], [], [], []
                for i, t in enumerate(texts):
                    for j, line in enumerate(t.split("\n") if t else ()):
                        form = line_form(line)
                        if not COUNTS(form):
                            continue
                        h = line_hash(form)
                        rows.append(i)
                        at.append(j)
                        ids.append(h)
                        sizes.append(len(form))
                        if len(form) < SHINGLE or h in seen:
                            fresh.append(0)
                        else:
                            seen.add(h)
                            fresh.append(BANDS)
                            forms.append(form)
                if len(seen) > MAX_SEEN:
                    seen.clear()
                if not rows:
                    continue
                bands = minhash_bands(forms).reshape(-1).view(np.int64) if forms else np.empty(0, np.int64)
                ends = np.cumsum([0, *fresh])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)).take(pa.array(rows)) for c in (key, "_row")), pa.array(at, pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands))],
                    names=[key, "_row", "at", "line_id", "size", "bands"],
                )

    rows = docs.select(key, row_hash(F.col(key), F.col(text)).alias("_row"), text)
    return rows.mapInArrow(run, f"`{key}` {kind}, _row long, at int, line_id long, size int, bands array<long>")


def wanted_lines(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """id, body (form) of the lines that wanted (_row, places: positions and ids) names."""
    d, w = docs.alias("d"), wanted.hint("shuffle_hash").alias("w")
    rows = d.join(w, row_hash(F.col(f"d.{key}"), F.col(f"d.{text}")) == F.col("w._row")).select(F.col(f"d.{text}").alias("_text"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(batch.schema.get_field_index("places")).to_pylist()
            first = 0
            for _, texts in slices(batch, "_text"):
                ids, forms = [], []
                for t, named in zip(texts, places[first : first + len(texts)], strict=True):
                    lines = (t or "").split("\n")
                    for p in named:
                        form = line_form(lines[p["at"]]) if p["at"] < len(lines) else ""
                        if line_hash(form) == p["line_id"]:
                            ids.append(p["line_id"])
                            forms.append(form)
                first += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["id", "body"])

    return rows.mapInArrow(run, "id long, body string")


def place() -> Column:
    """Where a line stands among all: rows without an id last."""
    return F.struct(F.col("_key").isNull().alias("none"), "_key", "at", "_row")


def classes(docs: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """All lines that count, as line_classes() makes them, and line_id, n, place, component, first of the classes that lose a line.

    place is the first one of a class, first that of its component.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    lines = materialise(line_classes(rows, "_key", "_text"), "lines")
    firsts = materialise(lines.groupBy("line_id").agg(F.min(place()).alias("place"), F.count("*").alias("n")), "line-firsts")
    sigs = lines.where(F.size("bands") > 0).select(F.col("bands").alias("sigs"), F.col("line_id").alias("id"), "size")

    def prepare(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sketches and forms of some lines, from the first place of each."""
        one = firsts.join(ids, F.col("line_id") == F.col("id"))
        wanted = one.groupBy(F.col("place._row").alias("_row")).agg(F.collect_set(F.struct(F.col("place.at").alias("at"), "line_id")).alias("places"))
        found = wanted_lines(rows, wanted, "_key", "_text").dropDuplicates(["id"])  # repeated rows give their lines again
        bodies = bucketed(with_sketches(found, sets_of), "id", "line-bodies", deal=False)
        return bodies.select("id", "n", *SKETCH), bodies.select("id", "body")

    # distinct shingles may be far fewer than characters, so lengths rule nothing out
    linked = link(sigs, prepare, sets_of, least, 0, True, "lines")
    linked = linked.select(F.col("id").alias("line_id"), "component")
    parts = firsts.join(linked, "line_id", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "line_id"))
    parts = materialise(parts, "line-parts")
    first = parts.groupBy("component").agg(F.min("place").alias("first"))
    return lines, parts.join(first, "component")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """key, _row, at, line_id, component, first_key, first_at and removed of each line that has a duplicate."""
    lines, parts = classes(docs, key, text, least)
    out = lines.select("_key", "_row", "at", "line_id").join(parts, "line_id")
    return out.select(F.col("_key").alias(key), "_row", "at", "line_id", "component", F.col("first._key").alias("first_key"), F.col("first.at").alias("first_at"), (~place().eqNullSafe(F.col("first"))).alias("removed"))


def removed_places(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """_row and the positions that go."""
    lines, parts = classes(docs, key, text, least)
    parts = materialise(parts, "line-components")
    single = parts.where("n = 1 AND NOT place <=> first").select("place._row", "place.at")
    # the lines of a common class are many: they meet it where they are, by broadcast or in split partitions
    often = lines.select("_key", "_row", "at", "line_id").join(parts.where("n > 1").select("line_id", "first"), "line_id")
    gone = often.where(~place().eqNullSafe(F.col("first"))).select("_row", "at").unionByName(single)
    return gone.groupBy("_row").agg(F.collect_set("at").alias("_gone"))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the texts that remain."""
    mark = free_name(docs, "_gone")
    gone = removed_places(docs, key, text, least).withColumnRenamed("_gone", mark)
    d, g = docs.alias("d"), gone.hint("shuffle_hash").alias("g")
    both = d.join(g, row_hash(F.col(f"d.`{key}`"), F.col(f"d.`{text}`")) == F.col("g._row"), "left").select("d.*", F.col(f"g.{mark}"))
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                kept = []
                for t, cut in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if t is not None and cut:
                        cut = set(cut)
                        t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in cut)
                    kept.append(t)
                yield part.select(names).set_column(at, pa.field(text, pa.string()), pa.array(kept, pa.string()))

    return both.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with how many of its lines go, and what stays, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(docs)
    return kept.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines_kept"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Second stage of the pipeline: repeated lines go; a document all of whose lines went stays as an empty text."""
    return drop_lines(docs)
