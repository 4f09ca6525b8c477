"""Periodic runs of words, found by counting matches at each lag.

A run is a maximal stretch of words that repeats with a smallest period q at
least three times and over at least 24 words. At lag q it shows as that many
consecutive matches (a word equal to the one q places on). So matches are
counted first, for every lag up to a third of the text: a frequent word by the
autocorrelation of where it stands (FFT), rare words by the differences of
their places. Only lags with enough matches are searched for islands of
consecutive ones. The matches of a run at multiples of its period are taken
off their lags, as no other run can own them: a run of period q that holds
them would overlap a run of a divisor's period by q words or more, and two
such runs are one. So a text that is one long run is searched once.

Each text is searched whole, in one task; work grows as n sqrt(n log n) at
most, besides the islands.

Defined results: a null, empty or wordless text has no run; a text under 24
words has none; repeated rows give repeated results; an empty table gives an
empty table; other columns of the input stay as they are, and the operator
refuses an output name that the input already has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import as_bytes, table

#: Least words and repetitions of a run.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Numbers that are transformed at once.
AT_ONCE = 1 << 21

#: Start, length, period.
Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    of: dict[bytes, int] = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int32, len(words))


def needed(lag: np.ndarray | int) -> np.ndarray | int:
    """Consecutive matches that a run of this period has at least."""
    return np.maximum(LEAST_WORDS, LEAST_TIMES * lag) - lag


def lag_counts(w: np.ndarray, most: int) -> np.ndarray:
    """How many words equal the one so many places on, for each lag up to most (0 at lag 0)."""
    n, counts = len(w), np.zeros(most + 1, np.int64)
    often = np.bincount(w)
    length = 1 << int(n + most).bit_length()  # no lag up to most wraps around
    heavy = np.flatnonzero(often > max(8, int(np.sqrt(length * np.log2(length)) / 4)))
    if len(heavy):
        power = np.zeros(length // 2 + 1)
        step = max(1, AT_ONCE // length)
        for k in range(0, len(heavy), step):
            spectrum = np.fft.rfft((w == heavy[k : k + step, None]).astype(np.float64), length)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, length)[: most + 1]).astype(np.int64)
    places = np.argsort(w, kind="stable")
    word = w[places]
    if len(heavy):
        light = ~np.isin(word, heavy)
        places, word = places[light], word[light]
    left = often[word]  # occurrences of the word, so as to leave words out that have no further neighbour
    k = 1
    while len(places) > k:
        same = word[k:] == word[:-k]
        apart = (places[k:] - places[:-k])[same]
        counts += np.bincount(apart[apart <= most], minlength=most + 1)
        k += 1
        if not k & 3:
            more = left > k
            places, word, left = places[more], word[more], left[more]
    counts[0] = 0
    return counts


def stretches(true: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where at least so many consecutive values are true, and how many."""
    edge = np.flatnonzero(np.concatenate(([True], ~true, [True])))  # one before each stretch, counted from -1
    long = np.flatnonzero(np.diff(edge) > least)
    return [(int(edge[i]), int(edge[i + 1] - edge[i] - 1)) for i in long]


def islands(w: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """Where enough consecutive words equal those lag places on, and how many: every k-th word is looked at first."""
    least = int(needed(lag))
    step = max(1, least // 8)
    if not stretches(w[: len(w) - lag : step] == w[lag::step], least // step):
        return []
    return stretches(w[: len(w) - lag] == w[lag:], least)


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def smallest(w: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether the stretch, which repeats with this period, repeats with none of its divisors."""
    return not any(np.array_equal(w[start : stop - p], w[start + p : stop]) for p in (period // f for f in prime_factors(period)))


def periodic_runs(w: np.ndarray) -> list[Run]:
    """All runs of a sequence of numbers, by start, then period."""
    n, most = len(w), len(w) // LEAST_TIMES
    if n < LEAST_WORDS:
        return []
    counts, found = lag_counts(w, most), []
    lags = np.arange(most + 1)
    for q in np.flatnonzero(counts >= needed(lags)).tolist():
        if q < 1 or counts[q] < needed(q):
            continue
        for start, matches in islands(w, q):
            length = matches + q
            if smallest(w, start, start + length, q):
                found.append((start, length, q))
                multiples = lags[2 * q :: q]
                counts[2 * q :: q] -= np.maximum(0, length - multiples)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: a run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def looped(words: list[bytes], h: int | None) -> list[bytes]:
    """words with what the number h plants: where it ends in 0, all words from some place on repeat in a loop."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def with_runs(df: DataFrame, text: str = "text", loops: str | None = None, collapsed: str | None = None) -> DataFrame:
    """df with n_runs, start, length, period and exponent_milli of the run of most repetitions, and digests of the runs and of what is left.

    loops names a column of numbers by which loops are planted first (see looped()); collapsed names a column for the text itself without repetitions.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    added = [*(T.StructField(c, T.LongType()) for c in names[:5]), *(T.StructField(c, T.StringType()) for c in [*names[5:], *([collapsed] if collapsed else [])])]
    if clash := {f.name for f in added} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kinds = [pa.int64()] * 5 + [pa.string()] * (len(added) - 5)

    def one(t: bytes | None, h: int | None) -> tuple:
        words = looped(t.split() if t else [], h)
        runs = periodic_runs(numbered(words))
        if runs:
            words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]
        left = b" ".join(words)
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode(), left)]
        best = (None,) * 4
        if runs:
            a, n, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            best = (a, n, q, 1000 * n // q)
        return (len(runs), *best, *digests, *([left.decode()] if collapsed else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            plants = batch.column(batch.schema.get_field_index(loops)).to_pylist() if loops else [None] * batch.num_rows
            at = 0
            for part, texts in as_bytes(batch, text):
                rows = [one(t, h) for t, h in zip(texts, plants[at : at + len(texts)], strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                same = batch.slice(at, len(texts)).column(i)
                yield pa.RecordBatch.from_arrays([*part.set_column(i, batch.schema.field(i), same).columns, *columns], names=[*batch.schema.names, *(f.name for f in added)])
                at += len(texts)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    return with_runs(docs, loops="_h").drop("text", "_h")
