"""BPE encoding and decoding with a public vocabulary.

Each pre-token becomes a doubly linked list of symbols; a priority queue of
(merge rank, position) pops the best merge, entries that an earlier merge made
stale are skipped. Decoding concatenates the vocabulary strings.

Defined results: a null text encodes as the empty text (no ids, decoded ``""``);
texts of any length are encoded whole; repeated rows give repeated results; an
empty table gives an empty table; other columns of the input stay as they are,
and the operator refuses an output name that the input already has.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import slices, table

#: Words whose encodings a worker remembers: so many recent ones, and as many older ones.
CACHE_WORDS = 200_000
#: White space to str.split() but not to the vocabulary's pre-tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return shown


class WordBPE:
    """A vocabulary with its merges, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.merges = {}  # ids of a pair -> its rank, then the id of their union, as one integer
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.merges.setdefault(self.ids[a] << 32 | self.ids[b], rank << 32 | self.ids[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_characters()
        self.inner = [self.ids.get(shown[b], -1) for b in range(256)]
        self.final = [self.ids.get(shown[b] + self.suffix, -1) for b in range(256)]
        self.known, self.older = {}, {}  # packed ids by word; bytes, which the garbage collector needn't visit
        self.pieces: dict[str, bytes] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        n, found = len(symbols), self.merges.get
        if n < 2:
            return symbols
        queue = []
        for i in range(n - 1):
            if m := found(symbols[i] << 32 | symbols[i + 1]):
                queue.append(m << 32 | i)
        if not queue:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            left = symbols[i]
            if left < 0 or j < 0 or found(left << 32 | symbols[j]) != entry >> 32:
                continue  # stale: one of the two has been merged since
            new = entry >> 32 & 0xFFFFFFFF
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := found(new << 32 | symbols[k]):
                    heapq.heappush(queue, m << 32 | i)
            h = before[i]
            if h >= 0 and (m := found(symbols[h] << 32 | new)):
                heapq.heappush(queue, m << 32 | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """Ids of text without white space, packed (little-endian, 32 bits each)."""
        out, pieces = [], self.pieces
        for piece in self.pre.findall(word):
            x = pieces.get(piece)
            if x is None:
                ids = self.merge(piece)
                x = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 32:
                    if len(pieces) >= CACHE_WORDS:
                        pieces.clear()
                    pieces[piece] = x
            out.append(x)
        return b"".join(out)

    def remember(self, word: str) -> bytes:
        x = self.older.get(word)
        if x is None:
            x = self.word(word)
        if len(word) <= 64:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = x
        return x

    def plain(self, text: str) -> bytes:
        """A text without special tokens. Lower case goes character by character, without a final sigma."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if SEPARATORS.search(text):
            return self.word(text)
        words = text.split()
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.remember(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        parts = (self.special[x].to_bytes(4, "little") if x in self.special else self.plain(x) for x in self.cut.split(text) if x)
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


def bpe_encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded", packed: bool = False) -> DataFrame:
    """df with the ids of each text (array of int, or packed as little-endian bytes) and the text decoded from them."""
    path = path or default_vocabulary()
    if clash := {ids, decoded} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField(ids, kind), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part, texts in slices(batch, text):
                codes = [bpe.encode(t) for t in texts]
                if packed:
                    out = pa.array(codes, pa.binary())
                else:
                    ends = np.cumsum([0] + [len(x) // 4 for x in codes])
                    flat = np.frombuffer(b"".join(codes), "<i4")
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns = [*part.columns, out, pa.array(map(bpe.decode, codes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text that its array of ids stands for; null for null ids; unknown ids stand for nothing."""
    path = path or default_vocabulary()
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(path).strings
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if r is None else " ".join(strings[i] for i in r if i in strings) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_encode(docs, packed=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: every document with its ids and decoded text."""
    return bpe_encode(docs)
