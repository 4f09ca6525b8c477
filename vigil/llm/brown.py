"""Language-model scores by Brown's class-based bigrams.

Fit, over all training texts: word counts; counts of adjacent symbols, where a
symbol is one of the MAX_CLASSED most frequent words or else the word's spelling
group (a hash of its ending); exchange clustering of all symbols into classes.
The TOP most frequent words are exchanged one by one; then every symbol chooses
its best class against the table of class bigrams, in parallel and one half of
the symbols at a time; a half moves only where the likelihood rises, and rounds
end when one raises it by under half a percent. What a symbol needs for that,
its neighbours' counts, is a row of a table in Spark, which is made in one
shuffle: tasks deal what they counted, packed, by symbol, and others add it up.

Score: log10 of class transitions, interpolated with class frequencies, and of
word emissions. In a class with spelling groups every word's count gives up an
absolute discount, estimated from how many words occur once and twice, which is
shared among its groups; a word never seen stands for its group. So the emissions of a class sum to 1 over its words and groups, and the
transitions from a class over classes. A text is its words, then one end, which
also stands before the first word.

Counts of the MAX_KNOWN most frequent words, a fixed bound, go to every task;
counts of all rarer words are joined.

Defined results: a null text is an empty one, its end alone; repeated rows are
scored and counted apart; without training text nothing is known, and scores
are those of the smoothing alone; ties of frequency go by the bytes of the
words; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import as_bytes, fold, forget, materialise, table

#: Words that are exchanged one by one, spelling groups, classes, passes of the exchange.
TOP, GROUPS, CLASSES, PASSES = 512, 256, 48, 6
#: Words that are symbols of their own, words whose counts go to every task.
MAX_CLASSED, MAX_KNOWN = 1 << 16, 1 << 17
#: The exchange ends with a round of both halves that raises the log-likelihood by no more than this share.
ENOUGH = 0.005
#: Least and most discount of a count, weight of class frequencies among transitions, and a floor of masses.
DISCOUNTS, BACKOFF, FLOOR = (0.1, 0.95), 4.0, 1e-3
#: Symbols that a task counts before it hands on the sums; sums that a task adds up at once, and entries of the rows that it writes at once.
COUNTED, MERGED, WRITTEN = 2_000_000, 4_000_000, 1_000_000
#: What spreads symbols over partitions.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Endings(dict):
    """The spelling group of each ending; so many are remembered."""

    def __missing__(self, end: bytes) -> int:
        group = xxhash.xxh3_64_intdigest(end) % GROUPS
        if len(self) < 1 << 16:
            self[end] = group
        return group


ENDINGS = Endings()


def spelling_group(word: bytes) -> int:
    return ENDINGS[word[-3:]]


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, part in as_bytes(batch, "text"):
                for t in part:
                    if t:
                        counts.update(t.lower().split())
                if len(counts) > 400_000:
                    yield flush(counts)
        if counts:
            yield flush(counts)

    def flush(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words by falling counts; the first MAX_CLASSED are symbols, then come the spelling groups and the end."""

    known: dict[bytes, int]
    counts: np.ndarray

    def __post_init__(self) -> None:
        self.classed = min(len(self.counts), MAX_CLASSED)
        self.symbols = np.array([i if i < self.classed else self.classed + spelling_group(w) for w, i in self.known.items()], np.int64)

    @property
    def end(self) -> int:
        return self.classed + GROUPS

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each word, and its place among the known words or -1."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        symbols = np.append(self.symbols, -1)[at]
        rare = np.flatnonzero(at < 0)
        symbols[rare] = self.classed + np.fromiter((ENDINGS[words[i][-3:]] for i in rare.tolist()), np.int64, len(rare))
        return symbols, at


def vocabulary(counts: DataFrame) -> Vocabulary:
    # a count that leaves at most MAX_KNOWN words, found from a few sums
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    left, least = MAX_KNOWN, None
    for r in steps:
        if r.k > left:
            break
        left, least = left - r.k, r.n
    found = counts.where(F.col("n") >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    ranked = sorted(zip(map(bytes, found["word"]), map(int, found["n"]), strict=True), key=lambda x: (-x[1], x[0]))
    return Vocabulary({w: i for i, (w, _) in enumerate(ranked)}, np.array([n for _, n in ranked], np.int64))


def contexts(texts: DataFrame, shared: Broadcast, counted: int = COUNTED, merged: int = MERGED, written: int = WRITTEN) -> DataFrame:
    """w, o, n over all texts: for each symbol the symbols after it, those before it (plus the number of symbols), and how often.

    A row has at most 2 x symbols entries, as the bytes of 32-bit numbers; n of 64-bit ones where one needs them.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, total = shared.value, [], 0
        end = np.array([vocabulary.end])
        for batch in batches:
            for _, part in as_bytes(batch, "text"):
                words = [t.lower().split() if t else [] for t in part]
                symbols, _ = vocabulary([w for text in words for w in text])
                ends = np.cumsum([len(w) for w in words])
                path = np.concatenate((end, np.insert(symbols, ends, vocabulary.end)))
                held.append(path[:-1] << 32 | path[1:])
                total += len(path)
                if total >= counted:
                    yield dealt(np.concatenate(held), vocabulary.end + 1)
                    held, total = [], 0
        if held:
            yield dealt(np.concatenate(held), vocabulary.end + 1)

    def dealt(codes: np.ndarray, symbols: int) -> pa.RecordBatch:
        """What was counted, a block for each partition."""
        code, n = np.unique(codes, return_counts=True)
        a, b = (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32)
        w = np.concatenate((a, b))
        part = ((w.astype(np.uint64) * SPREAD >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        columns = [x[order] for x in (w, np.concatenate((b, a + np.int32(symbols))), np.tile(n.astype(np.int32), 2))]
        part = part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        blocks = [b"".join(x[p:q].tobytes() for x in columns) for p, q in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "rows"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, fresh, done = 2 * (shared.value.end + 1), [], 0, 0
        for batch in batches:
            for block in batch.column(0).to_pylist():
                w, o, n = np.frombuffer(block, np.int32).reshape(3, -1)
                held.append((w.astype(np.int64) * width + o, n.astype(np.int64)))
                fresh += len(w)
                if fresh > max(merged, done):
                    held, fresh = [summed(held)], 0
                    done = len(held[0][0])
        if held:
            yield from rows(*summed(held), width)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(code)
        code, n = code[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[starts], np.add.reduceat(n, starts)

    def rows(code: np.ndarray, n: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        w, o = code // width, (code % width).astype(np.int32)
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        edges, first = np.append(starts, len(w)), 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + written, side="right")) - 1)
            some = slice(int(edges[first]), int(edges[last]))
            many = n[some].astype(np.int32 if n[some].max() < 1 << 31 else np.int64)
            ends = (edges[first : last + 1] - edges[first]).astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x.tobytes())]) for x in (o[some], many)]
            yield pa.RecordBatch.from_arrays([pa.array(w[starts[first:last]].astype(np.int32)), *packed], names=["w", "o", "n"])
            first = last

    blocks = texts.select("text").mapInArrow(count, "part int, rows binary").repartitionById(parts, F.col("part"))
    return blocks.select("rows").mapInArrow(add_up, "w int, o binary, n binary")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w of each row; row, o and n of each of its entries."""
    o, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    sizes = np.fromiter(map(len, o), np.int64, len(o)) // 4
    wide = np.fromiter(map(len, n), np.int64, len(n)) > 4 * sizes
    many = np.concatenate([np.frombuffer(x, np.int64 if y else np.int32) for x, y in zip(n, wide.tolist(), strict=True)]) if wide.any() else np.frombuffer(b"".join(n), np.int32)
    return batch.column(0).to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), np.frombuffer(b"".join(o), np.int32), many


def class_bigrams(rows: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class follows another: a table as small as the classes, whatever the texts are."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k)
        for batch in batches:
            w, row, o, n = flat(batch)
            after = o < len(of)
            table += np.bincount(of[w][row[after]] * k + of[o[after]], n[after], k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(table.astype(np.int64))], names=["code", "n"])

    got = rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(k, k)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What classes change of the log-likelihood of the bigrams: f over class bigrams less f over left and right totals, f(x) = x log x."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def move_gains(table: np.ndarray, row: np.ndarray, col: np.ndarray, own: float) -> np.ndarray:
    """Gain in likelihood of a symbol's joining each class, but for a constant; table is without it, row and col are its counts by classes after and before, own those of itself."""
    f, d = xlogx, np.diagonal(table)
    left, right = table.sum(1) + col, table.sum(0) + row  # its neighbours are counted wherever it goes
    gain = (f(table + row) - f(table)).sum(1) + (f(table + col[:, None]) - f(table)).sum(0)
    gain += f(d + row + col + own) - f(d) - (f(d + row) - f(d)) - (f(d + col) - f(d))
    return gain - (f(left + row.sum() + own) - f(left)) - (f(right + col.sum() + own) - f(right))


def without(table: np.ndarray, row: np.ndarray, col: np.ndarray, own: float, old: int) -> None:
    """Take a symbol out of a class, in place; row and col are without its own counts."""
    table[old] -= row
    table[:, old] -= col
    table[old, old] -= own


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each symbol: symbols move, one by one, to the class that raises the likelihood of the bigrams most.

    The last symbol, the end, keeps a class of its own.
    """
    n = len(counts)
    c = counts.astype(np.float64)
    order = np.argsort(-(c.sum(1) + c.sum(0))[:-1], kind="stable")
    of = np.full(n, classes, np.int64)
    of[order] = np.arange(n - 1) % classes
    k = classes + 1
    one = np.zeros((n, k))
    one[np.arange(n), of] = 1
    table = one.T @ c @ one
    for _ in range(passes):
        moved = 0
        for w in order:
            if not c[w].any() and not c[:, w].any():
                continue
            row, col, own, old = np.bincount(of, c[w], k), np.bincount(of, c[:, w], k), c[w, w], of[w]
            row[old] -= own
            col[old] -= own
            without(table, row, col, own, old)
            gain = move_gains(table, row, col, own)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            without(table, -row, -col, -own, new)
        if not moved:
            break
    return of


def moved(rows: DataFrame, of: np.ndarray, table: np.ndarray, first: int, half: int | None) -> np.ndarray:
    """Classes after the symbols from first on (of one half, by parity) chose the best against a table, each as if it alone moved."""
    k, size = CLASSES + 1, len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, row, o, n = flat(batch)
            counts = np.bincount(row * 2 * k + np.where(o < size, of[o % size], k + of[o % size]), n, len(w) * 2 * k).reshape(-1, 2, k)
            self_ = o == w[row]
            own = np.bincount(row[self_], n[self_], len(w))
            out = []
            for i, x in enumerate(w.tolist()):
                if first <= x < size - 1 and (half is None or x % 2 == half):
                    after, before, old = counts[i, 0], counts[i, 1], of[x]
                    after[old] -= own[i]
                    before[old] -= own[i]
                    t = table.copy()
                    without(t, after, before, own[i], old)
                    gain = move_gains(t, after, before, own[i])
                    new = int(np.argmax(gain[:CLASSES]))
                    if gain[new] > gain[old] + 1e-9:
                        out.append((x, new))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([c for _, c in out], pa.int32())], names=["w", "k"])

    got = rows.mapInArrow(run, "w int, k int").toPandas()  # a number for each of at most MAX_CLASSED + GROUPS symbols
    after = of.copy()
    after[got["w"].to_numpy()] = got["k"].to_numpy()
    return after


def cluster(rows: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol, and the table of class bigrams."""
    top, size = min(TOP, vocabulary.classed), vocabulary.end + 1
    # the most frequent words one by one, all others as one symbol
    lump = np.minimum(np.arange(size), top)
    lump[-1] = top + 1
    n = top + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n)
        for batch in batches:
            w, row, o, m = flat(batch)
            after = o < size
            counts += np.bincount(lump[w][row[after]] * n + lump[o[after]], m[after], n * n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["code", "n"])

    got = rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n * n, np.int64)
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    of = exchange(counts.reshape(n, n), CLASSES, PASSES)[lump]
    table = class_bigrams(rows, of)
    # then all, half by half, first those beside the most frequent; a half moves only where that gains
    first, known = top, likelihood(table)
    while True:
        before = known
        for half in (0, 1):
            next_ = moved(rows, of, table, first, half)
            after = class_bigrams(rows, next_)
            if (gained := likelihood(after)) > known:
                of, table, known = next_, after, gained
        if first == 0 and known - before <= ENOUGH * abs(known):
            return of, table
        first = 0


@dataclass
class Model:
    """Vocabulary, classes of its symbols, log10 transitions; totals; tokens and words of each class, discount of its words, share of each group in what they give up."""

    vocabulary: Vocabulary
    of: np.ndarray
    transitions: np.ndarray
    tokens: int
    kinds: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: np.ndarray
    group_share: np.ndarray

    def emission(self, n: np.ndarray, k: np.ndarray, share: np.ndarray | float = 0.0) -> np.ndarray:
        """log10 probability of words of these counts in their classes; where a count is 0, of a group with such a share."""
        all_, d = self.class_tokens[k] + FLOOR, self.discount[k]
        unseen = share * (d * self.class_words[k] + FLOOR) / all_
        return np.log10(np.where(n > 0, np.maximum(n - d, 1e-9) / all_, np.maximum(unseen, 1e-12)))

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.tokens + 1.0 * (self.kinds + 1)))


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts (column text), and the counts of all words."""
    spark = texts.sparkSession
    counts = materialise(word_counts(texts), "lm-counts")
    documents = texts.count()
    total, kinds, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    # absolute discounting: what a count is too high by, from the words that occur once and twice
    discount = min(max(once / max(1, once + 2 * twice), DISCOUNTS[0]), DISCOUNTS[1])
    words = vocabulary(counts)
    shared = spark.sparkContext.broadcast(words)
    size, k = words.end + 1, CLASSES + 1
    rows = materialise(contexts(texts, shared), "lm-contexts")
    of, n = cluster(rows, words)
    forget(rows)
    share = (n.sum(0) + 0.5) / (n.sum() + 0.5 * k)
    transitions = np.log10((n + BACKOFF * share) / (n.sum(1, keepdims=True) + BACKOFF))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tokens, kinds = shared.value, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            at, _ = vocabulary(batch.column(0).to_pylist())
            np.add.at(kinds, at, 1)
            np.add.at(tokens, at, batch.column(1).to_numpy())
        group = slice(words.classed, words.end)
        sums = [np.concatenate((np.bincount(of, x, k), x[group])).astype(np.int64) for x in (kinds, tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + GROUPS, dtype=np.int32)), *map(pa.array, sums)], names=["at", "words", "tokens"])

    # by class, then by group
    sums = counts.select("word", "n").mapInArrow(totals, "at int, words long, tokens long").groupBy("at").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
    all_words, all_tokens = np.zeros(k + GROUPS), np.zeros(k + GROUPS)
    for r in sums:
        all_words[r["at"]], all_tokens[r["at"]] = r.words, r.tokens
    class_words, tokens, group_words = all_words[:k], all_tokens[:k], all_words[k:]
    in_class = of[words.classed : words.end]
    open_ = np.zeros(k)  # only classes with a spelling group have unseen words
    open_[in_class] = discount
    weight = group_words + 1
    return Model(words, of, transitions, int(total) + documents, int(kinds) + (documents > 0), documents, tokens, class_words, open_, weight / np.bincount(in_class, weight, k)[in_class]), counts


def parts(docs: DataFrame, key: str, model: Model) -> DataFrame:
    """_row, key, n_tokens and the sums over known words and transitions, with the rarer words that are yet to be counted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    rare_type = pa.struct([("word", pa.binary()), ("g", pa.int32()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v, row = m.vocabulary, TaskContext.get().partitionId() << 33
        end_class = m.of[v.end : v.end + 1]
        end_base = float(m.base(np.array([m.ends]))[0])
        known_base, known_emission = (np.append(x, 0.0) for x in (m.base(v.counts), m.emission(v.counts, m.of[v.symbols])))
        for batch in batches:
            for part, texts in as_bytes(batch, "text"):
                split = [t.lower().split() if t else [] for t in texts]
                words = [w for text in split for w in text]
                symbols, at = v(words)
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                ends, text = np.cumsum(sizes), np.repeat(np.arange(len(split)), sizes)
                path = np.concatenate((end_class, np.insert(m.of[symbols], ends, end_class[0])))
                moves = np.add.reduceat(m.transitions[path[:-1], path[1:]], ends - sizes + np.arange(len(split)))  # every text has its end
                known, base, emission = (np.bincount(text, x, len(split)) for x in (at >= 0, known_base[at], known_emission[at]))
                rare, tfs, groups, held = [], [], [], [0]
                where = np.flatnonzero(at < 0)
                cuts = np.searchsorted(where, ends).tolist()
                others, marks = [words[i] for i in where.tolist()], (symbols[where] - v.classed).tolist()
                for p, q in zip([0, *cuts], cuts, strict=False):
                    tf = Counter(others[p:q])
                    rare.extend(tf)
                    tfs.extend(tf.values())
                    groups.extend(dict(zip(others[p:q], marks[p:q], strict=True)).values())  # in the order of first occurrence, as in the Counter
                    held.append(len(rare))
                entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(groups, pa.int32()), pa.array(tfs, pa.int32())], fields=list(rare_type))
                columns = [
                    pa.array(row + np.arange(len(split))), pa.array(sizes + 1), pa.array(known.astype(np.int64) + (m.ends > 0)), pa.array(base + end_base), pa.array(moves + emission),
                    pa.ListArray.from_arrays(pa.array(held, pa.int32()), entries),
                ]
                row += len(split)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), *columns], names=[key, "_row", "n_tokens", "_known", "_base", "_score", "_rare"])

    schema = f"`{key}` {kind}, _row long, n_tokens long, _known long, _base double, _score double, _rare array<struct<word:binary,g:int,tf:int>>"
    return docs.select(key, "text").mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score, score (log10) and perplexity of each row of docs (key, text)."""
    rows = materialise(parts(docs, key, model), "lm-parts")
    rare = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.g", "r.tf")
    found = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    k = model.of[model.vocabulary.classed : model.vocabulary.end]  # of each group
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("g") + 1)
    seen = F.log10(F.greatest(F.col("n") - pick(model.discount[k]), F.lit(1e-9))) - pick(np.log10(model.class_tokens[k] + FLOOR))
    emission = F.when(F.col("n") > 0, seen).otherwise(pick(model.emission(np.zeros(GROUPS), k, model.group_share)))
    base = F.log10((F.col("n") + 1) / float(model.tokens + model.kinds + 1))
    sums = found.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("k2"), F.sum(base * F.col("tf")).alias("b2"), F.sum(emission * F.col("tf")).alias("s2")
    )
    out = rows.select(key, "_row", "n_tokens", "_known", "_base", "_score").join(sums, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(key, "n_tokens", plus("_known", "k2").cast("long").alias("n_known"), plus("_base", "b2").alias("base_score"), plus("_score", "s2").alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out() -> Column:
    return fold("doc_id", 7) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs.where(~held_out()))
    scored = score_texts(docs, model, counts)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
