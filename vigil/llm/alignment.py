"""Alignment of the tokens of two public tokenizers.

Both encodings of a text tile the bytes of a space and the text. The ends of
B's tokens are a static, sorted index of intervals; a bisection for the end of
each A token stabs it, and from two neighbouring stabs follow the B tokens
that the A token overlaps. A gap between bytes that no token of either spans
is a boundary of groups. Texts of a batch are laid end to end, so all of this
is done by a few array operations for many texts.

Counts of linked id pairs are over the whole corpus. Tasks count pairs by
chunks of documents and write them beside the documents' links (numbers of the
chunk's pairs); Spark sums the pairs, finds the highest of each B id, and sends
every chunk the sums of its own pairs, where its documents are added up. No
step holds more than a chunk, or one text that is longer.

Defined results: texts that are null, empty, or that an encoding doesn't give
back byte by byte (U+2581 is a space to B) have no tokens: zeros and '';
strings of special tokens are plain text; repeated rows each count; texts of
any length are aligned whole; an empty table gives an empty table; other
columns of the input stay as they are, and the operators refuse an output name
that the input already has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.bpe import byte_characters
from vigil.llm.common import materialise, slices, table

#: Bytes of text that are aligned at once, and links with which a chunk ends.
BATCH_BYTES, CHUNK_LINKS = 1 << 20, 3_000_000
#: Words that a task remembers B's ids of, about, and how long they may be.
CACHE_WORDS, CACHE_CHARS = 200_000, 40
NONE = np.empty(0, np.int32)
#: A pair of ids is the first times this, plus the second.
SHIFT = 1 << 32


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Encoders:
    """A byte-level encoder from a tokenizer's JSON file and one of pieces, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        of = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(map(of.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
        # a vocabulary whose ids are the order of its merges: the same encoding, several times as fast
        self.a = tiktoken.Encoding("ids_in_order_of_merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            self.a_bytes[i] = s
        pieces = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(pieces, self.b.id_to_piece(list(pieces)), strict=True)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.written = [*(f"{i}," for i in range(n)), *(f"{i}|" for i in range(n)), *(f"{i}," for i in range(m)), *(f"{i};" for i in range(m))]

        # no piece holds a space after anything else, so what begins with a space is encoded by itself
        self.cuts = not any(re.search("[^▁]▁", p) for p in self.b.id_to_piece(list(pieces)))
        self.known: dict[str, bytes | None] = {}

    def pieces(self, texts: list[str]) -> list[bytes | None]:
        """B's ids of texts, packed (32 bits each); None where they don't give the text back."""
        of = self.b_bytes.__getitem__
        return [np.array(ids, "<i4").tobytes() if b"".join(map(of, ids)) == f" {t}".encode() else None for t, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]

    def second(self, texts: list[str]) -> list[bytes | None]:
        """pieces(), word by word where texts have single spaces."""
        words = [t.split(" ") for t in texts]
        cut = [self.cuts and "" not in w for w in words]
        whole = iter(self.pieces([t for t, c in zip(texts, cut, strict=True) if not c]))
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in dict.fromkeys(w for ws, c in zip(words, cut, strict=True) if c for w in ws) if w not in known]
        known.update(zip(new, self.pieces(new), strict=True))
        out = []
        for ws, c in zip(words, cut, strict=True):
            found = list(map(known.__getitem__, ws)) if c else [next(whole)]
            out.append(None if None in found else b"".join(found))
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of texts by both; none if a text is null, empty or not given back. A's bytes are the text's by how it merges."""
        some = [t for t in texts if t and "▁" not in t]
        found = iter(zip(some, self.second(some), strict=True))
        out = []
        for t in texts:
            text, b = next(found) if t and "▁" not in t else (None, None)
            out.append((NONE, NONE) if b is None else (np.array(self.a.encode_ordinary(f" {text}"), np.int32), np.frombuffer(b, "<i4")))
        return out


@lru_cache(maxsize=2)
def encoders(paths: tuple[str, str]) -> Encoders:
    return Encoders(*paths)


class Aligned:
    """Tokens, links and groups of some texts, end to end; the *_ends say where each text's begin and end."""

    def __init__(self, texts: list[str | None], encode: Encoders):
        ids = encode.encode(texts)
        self.encode = encode
        self.n_a, self.n_b = (np.fromiter((len(x[k]) for x in ids), np.int64, len(ids)) for k in (0, 1))
        self.a, self.b = (np.concatenate([NONE, *(x[k] for x in ids)]).astype(np.int64) for k in (0, 1))
        self.a_stop, b_stop = np.cumsum(encode.a_size[self.a]), np.cumsum(encode.b_size[self.b])
        last = np.searchsorted(b_stop, self.a_stop)  # the B token that holds the last byte of each A token
        self.a_cuts = b_stop[last] == self.a_stop if len(last) else np.zeros(0, bool)
        self.b_cuts = np.zeros(len(self.b), bool)
        self.b_cuts[last[self.a_cuts]] = True
        first = np.concatenate(([0], (last + self.a_cuts)[:-1])) if len(last) else last
        self.first, self.links = first, last + 1 - first
        self.n_links, self.n_groups = per_text(self.links, self.n_a), per_text(self.a_cuts, self.n_a)

    def pairs(self) -> np.ndarray:
        """The ids that each link joins, text by text."""
        before = np.cumsum(self.links) - self.links
        return np.repeat(self.a, self.links) * SHIFT + self.b[np.repeat(self.first - before, self.links) + np.arange(self.links.sum())]

    def groups_written(self) -> list[str]:
        """The groups of each text: a1,a2|b1;a3|b2,b3."""
        a_group, b_group = (np.cumsum(c) - c for c in (self.a_cuts, self.b_cuts))
        n = int(self.a_cuts.sum())
        a_in, b_in = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        known = len(self.encode.a_bytes)
        order[np.arange(len(self.a)) + (np.cumsum(b_in) - b_in)[a_group]] = self.a + np.where(self.a_cuts, known, 0)
        order[np.arange(len(self.b)) + np.cumsum(a_in)[b_group]] = 2 * known + self.b + np.where(self.b_cuts, len(self.encode.b_bytes), 0)
        words = list(map(self.encode.written.__getitem__, order.tolist()))
        ends = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        return ["".join(words[x:y])[:-1] for x, y in zip(ends, ends[1:], strict=False)]

    def groups(self) -> pa.Array:
        """The groups of each text with the bytes where they begin and end."""
        stops = self.a_stop[self.a_cuts]
        starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
        base = np.repeat((c := np.cumsum(per_text(self.encode.a_size[self.a], self.n_a))) - np.diff(c, prepend=0), self.n_groups)
        ends = lambda cuts: pa.array(np.concatenate(([0], np.flatnonzero(cuts) + 1)), pa.int32())
        each = [pa.ListArray.from_arrays(ends(c), pa.array(x, pa.int32())) for c, x in ((self.a_cuts, self.a), (self.b_cuts, self.b))]
        rows = pa.StructArray.from_arrays([*each, pa.array(starts - base), pa.array(stops - base)], names=["a", "b", "start", "stop"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.n_groups))), pa.int32()), rows)


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of each text."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(sizes)))])


def with_groups(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, groups: str = "groups") -> DataFrame:
    """df with the groups of each text: a (ids of the first vocabulary), b (ids of the second), start and stop (bytes in a space and the text)."""
    paths = paths or vocabularies()
    if groups in df.columns:
        raise ValueError(f"columns exist already: {groups}")
    span = T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType())), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoders(paths)
        for batch in batches:
            for part, texts in slices(batch, text, BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, Aligned(texts, encode).groups()], names=[*part.schema.names, groups])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(groups, T.ArrayType(span))]))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers under 2 ** 32, compressed byte by byte."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
ADDED = {*COUNTS, "groups_sha256", "n_best", "count_sum", "_chunk", "_links", "_pairs", "_counts"}


def chunked(df: DataFrame, text: str, paths: tuple[str, str]) -> DataFrame:
    """df without text, with _chunk, COUNTS, groups_sha256 and _links of each row, and for each chunk a row of its own with _pairs and _counts."""
    others = [f for f in df.schema.fields if f.name != text]
    own = [T.StructField("_chunk", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups_sha256", T.StringType()), T.StructField("_links", T.BinaryType()), T.StructField("_pairs", T.ArrayType(T.LongType())), T.StructField("_counts", T.ArrayType(T.LongType()))]
    names = [f.name for f in [*others, *own]]
    longs = pa.list_(pa.int64())

    def rows(name: str, held: list[tuple[pa.RecordBatch, Aligned, list[str]]], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A chunk: its documents, batch by batch, and its pairs as they come up."""
        at, found = pd.factorize(pairs)
        counts, done = np.bincount(at, minlength=len(found)), 0
        for kept, x, digests in held:
            ends = np.concatenate(([0], np.cumsum(x.n_links))) + done
            done = int(ends[-1])
            links = [packed(at[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            n = kept.num_rows
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([name] * n), *(pa.array(getattr(x, c)) for c in COUNTS), pa.array(digests), pa.array(links, pa.binary()), pa.nulls(n, longs), pa.nulls(n, longs)], names=names)
        kinds = [c.type for c in held[0][0].columns]
        whole = [pa.array([v.tolist()], longs) for v in (found, counts)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([name]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *whole], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, done = encoders(paths), TaskContext.get(), 0
        held, pairs, total = [], [], 0
        for batch in batches:
            for part, texts in slices(batch, text, BATCH_BYTES):
                x = Aligned(texts, encode)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups_written()]
                held.append((part.select([f.name for f in others]), x, digests))
                pairs.append(x.pairs())
                total += len(pairs[-1])
                if total >= CHUNK_LINKS:
                    # what a task commits is of one attempt, so its partition names its chunks
                    yield from rows(f"{task.partitionId()}-{done}", held, np.concatenate(pairs))
                    held, pairs, total, done = [], [], 0, done + 1
        if held:
            yield from rows(f"{task.partitionId()}-{done}", held, np.concatenate(pairs))

    nullable = [T.StructField(f.name, f.dataType) for f in others]
    return df.mapInArrow(run, T.StructType([*nullable, *own]))


def summed(chunks: DataFrame) -> DataFrame:
    """pair, n (its links corpus-wide) and best (n is the highest of its B id)."""
    each = chunks.where(F.col("_pairs").isNotNull()).select(F.explode(F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_counts").alias("n"))).alias("x")).select("x.pair", "x.n")
    counts = materialise(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy(F.pmod("pair", F.lit(SHIFT)).alias("b")).agg(F.max("n").alias("top"))  # a row for each id of the second vocabulary
    return counts.join(top, F.pmod("pair", F.lit(SHIFT)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def token_links(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """df without text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row."""
    paths = paths or vocabularies()
    others = [f for f in df.schema.fields if f.name != text]
    mine = [f.name for f in others]
    if clash := {*mine} & ADDED:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    chunks = materialise(chunked(df, text, paths), "token-chunks")
    asked = chunks.where(F.col("_pairs").isNotNull()).select("_chunk", F.posexplode("_pairs").alias("_at", "pair"))
    given = asked.join(summed(chunks), "pair").select(F.col("_chunk").alias("_of"), "_at", "n", "best")
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in others), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("groups_sha256", T.StringType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("_at").to_numpy()
        n, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        n[place], best[place] = known.column("n").to_numpy(), known.column("best").to_numpy()
        links = [unpacked(x) for x in rows.column("_links").to_pylist()]
        sums = [pa.array([int(v[x].sum()) for x in links], pa.int64()) for v in (best, n)]
        return pa.table([*(rows.column(c) for c in [*mine, *COUNTS, "groups_sha256"]), *sums], names=[f.name for f in out])

    rows = chunks.where(F.col("_links").isNotNull()).drop("_pairs", "_counts")
    return rows.groupBy("_chunk").cogroup(given.groupBy("_of")).applyInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links(table(spark, sf_dir, "documents").select("doc_id", "text"))
