"""Language identification by compression.

Each language, however many there are, has a zstandard raw-content dictionary
of bounded size. It is filled with pieces of hash-chosen labelled texts, one
from a hash-chosen place of each text; equal pieces count once. A text is cut into blocks, all of
them are compressed with every dictionary, and the language with the smallest
sum wins; a narrow margin is a rejection.

Defined results: text that is null, empty or without a letter is ``und`` with
score 0 and not accepted; equal sums go to the first language by code point;
with no labelled text at all everything is ``und``; texts of any length are
read whole; repeated rows and copies are sampled as one; an input that already has a
column of the output is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import fold, slices, table

#: Documents of a language that are drawn first, characters of a document's piece, bytes of a dictionary.
SAMPLE_DOCS, PIECE_CHARS, DICT_BYTES = 400, 400, 112_000
BLOCK_BYTES = 1024
LEVEL = 6
#: A margin below this share of the runner-up's bytes is a rejection.
MIN_MARGIN = 0.02


def fit_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries by language, the same for the same rows.

    Languages are counted over all rows; then about SAMPLE_DOCS rows of each are drawn by the hash of their text, and
    four times as many until their distinct pieces fill the dictionary or all rows are drawn.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    shares = {r[0]: min(1.0, SAMPLE_DOCS / r[1]) for r in rows.groupBy(lang).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    places = F.greatest(F.char_length(text) - PIECE_CHARS, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(F.lit("place"), F.col(text)), places).cast("int") + 1
    found: dict[str, bytes] = {}
    while shares:
        share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
        picked = rows.where(draw < F.try_element_at(share, F.col(lang))).select(
            F.col(lang).alias("l"), draw.alias("d"), F.substr(F.col(text), place, F.lit(PIECE_CHARS)).alias("t")
        )
        pieces: dict[str, list] = {}
        for r in picked.groupBy("l", "t").agg(F.min("d").alias("d")).collect():
            pieces.setdefault(r.l, []).append((r.d, r.t))
        raw = {k: "\n".join(t for _, t in sorted(pieces.get(k, []))).lower().encode() for k in shares}
        done = {k for k, s in shares.items() if s >= 1 or len(raw[k]) >= DICT_BYTES}
        found |= {k: raw[k][:DICT_BYTES] for k in done if raw[k]}
        shares = {k: min(1.0, 4 * s) for k, s in shares.items() if k not in done}
    return found


@lru_cache(maxsize=4)
def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, models: list, block: int = BLOCK_BYTES) -> tuple[str, float, bool]:
    """Language, score and acceptance of one text."""
    if not text or not models or not any(map(str.isalpha, text)):
        return "und", 0.0, False
    raw = text.lower().encode("utf-8", "surrogatepass")
    blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in models)
    best = sizes[0][0]
    second = sizes[1][0] if len(sizes) > 1 else best + len(raw)
    margin = (second - best) / second
    return sizes[0][1], 1.0 - 0.5 ** (1 + 20 * margin), margin >= MIN_MARGIN


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1, from the margin) and accepted (the margin isn't narrow)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    if clash := {f.name for f in added} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    fitted = tuple(sorted(dictionaries.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = compressors(fitted, LEVEL)
        for batch in batches:
            for part, texts in slices(batch, text):
                got = [classify(t, models) for t in texts]
                new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "lang_pred", "score", "accepted"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def held_out() -> Column:
    return fold("doc_id", 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
