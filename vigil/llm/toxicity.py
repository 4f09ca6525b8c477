"""Toxicity by maximum-scoring segments.

Fit: in how many labelled toxic and clean texts a word is, under a Dirichlet
prior from all of them, gives its log-odds; what counts is the end of their
confidence interval that lies nearer to 0, so a word that is in few texts
weighs little, whichever way it points. A beginning of words stands for words
that the sample doesn't hold, if several of its words point the same way. Scan:
words score their log-odds less a cost, and one linear pass finds all maximal
segments of positive score. Aggregation: Karlin-Altschul statistics (lambda
from the clean token scores, K from the clean maxima) turn segment scores into
normalised scores, and a logistic curve over the sum of the significant ones
gives the probability. What is calibrated is measured out of fold: texts are
scored by log-odds to which they did not contribute.

Scripts that are written without spaces are cut into pairs of characters, which
then are the words.

Defined results: null, empty or wordless text scores as a text without any
segment; texts of any length are scanned whole; repeated label rows of one
document count once (toxic if any is); equal texts, and most near copies, count
once in the fit; with no label of either kind every text scores 0; segments tie
to the earlier one; an input that already has a column of the output is refused.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import as_bytes, fold, slices, table
from vigil.llm.links import PART_BYTES
from vigil.llm.ngram_join import Shingler

#: Labelled rows of the fit, about.
MAX_LABELLED = 20_000
#: Mass of the Dirichlet prior in documents, half the width of an interval in standard deviations, and what each word costs a segment.
PRIOR, WIDTH, COST = 2.0, 1.64, 0.15
#: Log-odds nearer to 0 count as 0.
LEAST_ODDS = 0.05
#: Lengths of beginnings, how many different words of the sample must support one, and what share of their evidence must point its way.
BEGINNINGS, SUPPORT, AGREE = (4, 5, 6), 3, 0.9
FOLDS = 3
FORM = regex.compile(r"[^\W_]+")
#: Runs of scripts without spaces.
DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
CACHE_WORDS = 100_000


def tokens(text: str | None) -> list[str]:
    """What stands between spaces, in lower case; runs of scripts without spaces as their pairs of characters."""
    text = (text or "").lower()
    if not text.isascii():
        text = DENSE.sub(lambda m: f" {m[0]} " if len(m[0]) < 3 else " " + " ".join(map("".join, zip(m[0], m[0][1:], strict=False))) + " ", text)
    return text.split()


def words(text: str | None) -> set[str]:
    return {w for t in tokens(text) for w in FORM.findall(t)}


@dataclass(frozen=True)
class Model:
    """weights: log-odds by word, 0 for words that are known without any; beginnings: log-odds by beginning; rate and size: lambda and K; slope and offset: the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    size: float = 0.1
    slope: float = 0.0
    offset: float = 0.0


class Scorer:
    """Scores of tokens by a model, which remembers them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        w = self.model.weights.get(word)
        if w is not None:
            return w
        longest = next((x for k in sorted(BEGINNINGS, reverse=True) if len(word) > k and (x := self.model.beginnings.get(word[:k])) is not None), 0.0)
        return longest

    def token(self, token: str) -> float:
        """The strongest evidence among the words that a token holds, less the cost."""
        return max((self.word(w) for w in FORM.findall(token)), key=abs, default=0.0) - COST

    def scores(self, text: str | None) -> list[float]:
        out, known = [], self.known
        for token in tokens(text):
            s = known.get(token)
            if s is None:
                s = self.token(token)
                if len(known) >= CACHE_WORDS:
                    known.clear()
                if len(token) <= 64:
                    known[token] = s
            out.append(s)
        return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by one pass over the scores.

    Each candidate keeps the running totals before and after it. A new positive score looks for the nearest earlier
    candidate that starts lower: it stands alone if there is none, or if that one already ends at least as high;
    else both and what lies between become one candidate, which is looked at again.
    """
    total, found = 0.0, []
    for i, s in enumerate(scores):
        if s > 0:
            start, low, high = i, total, total + s
            lower = len(found) - 1
            while True:
                while lower >= 0 and found[lower][2] >= low:
                    lower = found[lower][4]
                if lower < 0 or found[lower][3] >= high:
                    break
                start, low = found[lower][0], found[lower][2]
                del found[lower:]
                lower = len(found) - 1
            found.append((start, i + 1, low, high, lower))
        total += s
    return [(a, b, high - low) for a, b, low, high, _ in found]


def normalised(scores: list[float], model: Model) -> list[tuple[int, int, float]]:
    """The significant segments of a text with their normalised scores."""
    if not scores:
        return []
    floor = math.log(max(model.size * len(scores), math.e))
    found = ((a, b, model.rate * s - floor) for a, b, s in maximal_segments(scores))
    return [x for x in found if x[2] > 0]


def probability(x: float, model: Model) -> float:
    """Of a text whose significant segments score so much together."""
    if not model.weights:
        return 0.0
    return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, model.slope * x + model.offset))))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most about MAX_LABELLED labelled documents, chosen by the hash of their id."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = MAX_LABELLED / max(1, labels.count())
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    # about MAX_LABELLED rows of two numbers: small whatever the tables are
    return docs.select("doc_id", "text").join(F.broadcast(rows.where(draw < share)), "doc_id")


def apart(sample: DataFrame) -> DataFrame:
    """key, text, toxic of the sample without repetitions: texts that share the least hash of their shingles are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(4)
        for batch in batches:
            for part, texts in as_bytes(batch, "text", PART_BYTES):
                values, ends = shingles(texts)
                least = [int(values[a]) >> 1 if b > a else -1 for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), part.column(1).cast(pa.string()), part.column(2), part.column(0)], names=["key", "text", "toxic", "doc_id"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, f"key long, text string, toxic int, doc_id {kind}")
    return rows.groupBy("key").agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"))


def fold_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int")


def count_words(sample: DataFrame) -> DataFrame:
    """word, fold, toxic and clean: in how many texts of each label and fold a word is. sample: text, toxic, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], Counter] = defaultdict(Counter)
        for batch in batches:
            kinds, folds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("toxic", "fold"))
            at = 0
            for _, texts in slices(batch, "text"):
                for t, k, f in zip(texts, kinds[at:], folds[at:], strict=False):
                    counts[f, k > 0].update(words(t))
                at += len(texts)
                if sum(map(len, counts.values())) > 200_000:
                    yield from flush(counts)
        yield from flush(counts)

    def flush(counts: dict[tuple[int, bool], Counter]) -> Iterator[pa.RecordBatch]:
        for (f, toxic), c in counts.items():
            n = pa.array(list(c.values()), pa.int64())
            zero = pa.array(np.zeros(len(n), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([f] * len(n), pa.int32()), *((n, zero) if toxic else (zero, n))], names=["word", "fold", "toxic", "clean"])
        counts.clear()

    found = sample.select("text", "toxic", "fold").mapInArrow(run, "word string, fold int, toxic long, clean long")
    return found.groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lowest(n: np.ndarray) -> np.ndarray:
    """Lower end of the interval of a Poisson mean, by Wilson and Hilferty."""
    n = np.maximum(n, 1e-9)
    return n * np.maximum(0.0, 1 - 1 / (9 * n) - WIDTH / (3 * np.sqrt(n))) ** 3


def highest(n: np.ndarray) -> np.ndarray:
    return (n + 1) * (1 - 1 / (9 * (n + 1)) + WIDTH / (3 * np.sqrt(n + 1))) ** 3


def log_odds(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-odds of words that are in so many of n1 toxic and n0 clean texts: of their interval the end nearer to 0, and 0 if it holds 0."""
    prior = PRIOR * (toxic + clean) / (n1 + n0)
    a, b = toxic + prior, clean + prior
    with np.errstate(divide="ignore"):
        least, most = np.log(lowest(a) * n0) - np.log(highest(b) * n1), np.log(highest(a) * n0) - np.log(lowest(b) * n1)
    out = np.where(least > 0, least, np.where(most < 0, most, 0.0))
    return np.where(np.abs(out) < LEAST_ODDS, 0.0, out)


def beginnings(of: dict[str, float]) -> dict[str, float]:
    """Beginnings that enough different words of the sample support, with the mean of their log-odds."""
    found: dict[str, list[float]] = defaultdict(list)
    for word, w in of.items():
        for k in BEGINNINGS:
            if len(word) > k:
                found[word[:k]].append(w)
    out = {}
    for start, ws in found.items():
        one_way, all_ = abs(sum(ws)), sum(map(abs, ws))
        if sum(w != 0 for w in ws) >= SUPPORT and all(w != 0 for w in ws) and one_way >= AGREE * all_:
            out[start] = sum(ws) / len(ws)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a bounded sample of labelled documents."""
    sample = apart(labelled_sample(docs, labels)).withColumn("fold", fold_of(F.col("key")))
    sizes = {(r.fold, r.k): r.n for r in sample.groupBy("fold", (F.col("toxic") > 0).alias("k")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = (np.array([sizes.get((f, k), 0) for f in range(FOLDS)], float) for k in (True, False))
    if not n1.sum() or not n0.sum():
        return Model()
    # words of a bounded sample; of those in one text only, which weigh nothing, it is enough that they are known
    counts = count_words(sample).groupBy("word").pivot("fold", list(range(FOLDS))).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).na.fill(0)
    common = counts.where(sum((F.col(f"{f}_t") + F.col(f"{f}_c") for f in range(FOLDS)), F.lit(0)) > 1).toPandas()
    if not len(common):
        return Model()
    t, c = (common[[f"{f}_{k}" for f in range(FOLDS)]].to_numpy(float) for k in "tc")
    names = common["word"].tolist()

    def weighed(t: np.ndarray, c: np.ndarray, n1: float, n0: float) -> Model:
        if not n1 or not n0:
            return Model()
        of = dict(zip(names, log_odds(t, c, n1, n0).tolist(), strict=True))
        starts = beginnings(of)
        # a word without weight needs to be known only where a beginning would speak for it
        return Model({w: x for w, x in of.items() if x or any(w[:k] in starts for k in BEGINNINGS)}, starts)

    whole = weighed(t.sum(1), c.sum(1), n1.sum(), n0.sum())
    if not any(whole.weights.values()):
        return Model()
    without = [weighed(t.sum(1) - t[:, f], c.sum(1) - c[:, f], n1.sum() - n1[f], n0.sum() - n0[f]) for f in range(FOLDS)]
    return calibrate(sample, whole, without)


def calibrate(sample: DataFrame, whole: Model, without: list[Model]) -> Model:
    """Extreme-value and logistic parameters, from the segments of each text by the model without its fold."""
    shared = sample.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in shared.value]
        for batch in batches:
            kinds, folds = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("toxic", "fold"))
            at = 0
            for _, texts in slices(batch, "text"):
                rows = []
                for t, k, f in zip(texts, kinds[at:], folds[at:], strict=False):
                    s = scorers[f].scores(t)
                    often = Counter(round(x, 1) for x in s)
                    rows.append((int(k > 0), len(s), [x[2] for x in maximal_segments(s)], list(often), list(often.values())))
                at += len(texts)
                types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["toxic", "n", "found", "value", "times"])

    got = sample.select("text", "toxic", "fold").mapInArrow(run, "toxic long, n long, found array<double>, value array<double>, times array<long>").toPandas()
    top = np.array([max(f, default=0.0) for f in got.found])
    clean = ((got.toxic == 0) & (got.n > 0)).to_numpy()
    often: Counter = Counter()
    for v, k in zip(got.value[clean], got.times[clean], strict=True):
        often.update(dict(zip(v, k, strict=True)))
    often.update({round(max(whole.weights.values()) - COST, 1): 1, round(-COST, 1): 1})  # one more of either sign
    values, times = np.array(list(often)), np.array(list(often.values()), float)
    rate = karlin_lambda(values, times / times.sum())
    # the mean of lambda S - ln n over clean maxima is ln K plus Euler's constant
    gumbel = float(np.mean(rate * top[clean] - np.log(got.n[clean]))) if clean.any() else -2.0
    size = math.exp(max(-12.0, min(3.0, gumbel - 0.5772156649)))
    floor = np.log(np.maximum(size * got.n, math.e))
    x = np.array([np.maximum(0.0, rate * np.asarray(f, float) - e).sum() for f, e in zip(got.found, floor, strict=True)])
    slope, offset = logistic(x, got.toxic.to_numpy(float))
    return Model(whole.weights, whole.beginnings, rate, size, slope, offset)


def karlin_lambda(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(share e^(lambda value)) = 1, which there is where the mean is negative and some values are positive."""
    low, high = 1e-3, 1.0
    short = lambda x: float((shares * np.exp(np.minimum(x * values, 700))).sum()) < 1
    while short(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if short(mid) else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps, lightly ridged; x beyond 20 is as 20."""
    x = np.minimum(x, 20.0)
    slope, offset = 1.0, -3.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([np.sum((y - q) * x) - 0.5 * slope, np.sum(y - q) - 0.01 * offset])
        h = np.array([[np.sum(w * x * x) + 0.5, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.01]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(step[0], -1, 1)), offset + float(np.clip(step[1], -2, 2))
    return max(slope, 1e-3), offset


def score_documents(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score, n_segments and segments (start and end word, normalised score)."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())])
    added = [T.StructField("score", T.DoubleType()), T.StructField("n_segments", T.IntegerType()), T.StructField("segments", T.ArrayType(span))]
    if clash := {f.name for f in added} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
    shared = df.sparkSession.sparkContext.broadcast(model)  # words of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part, texts in slices(batch, text, 1 << 20):
                got = [normalised(scorer.scores(t), scorer.model) for t in texts]
                spans = pa.array([[{"start": a, "stop": b, "score": s} for a, b, s in g] for g in got], kind)
                new = [pa.array([probability(sum(s for *_, s in g), scorer.model) for g in got], pa.float64()), pa.array(list(map(len, got)), pa.int32()), spans]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "score", "n_segments", "segments"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def held_out() -> Column:
    return fold("doc_id", 3) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_segments")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First stage of the pipeline: documents that score as toxic go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    mine = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns])
    scored = score_documents(mine, model, "_in_text").where(F.col("score") < 0.7)
    return scored.select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
