"""Keyed, ordered operators: hysteresis, runs, throttles, K of N, gaps, latches.

Window forms use one partition and order specification each, so Spark sorts
once for all their columns. Folds, whose state depends on what they emitted,
walk sorted partitions (operators.folds); for unbounded streams the same steps
are in vigil.streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.operators.folds import folded


def runs(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """df with run (number of the state's run) and age (place in it), from 1."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(state).over(w)
    changed = F.when(before.isNull() | (before != F.col(state)), 1).otherwise(0)
    x = df.withColumn("run", F.sum(changed).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.withColumn("age", F.row_number().over(W.partitionBy(*keys, "run").orderBy(*order)))


def confirmed_changes(df: DataFrame, keys: list[str], order: list[str], state: str, frames: Column, initial: Column | None = None) -> DataFrame:
    """Rows at which a state that lasted so many frames differs from the one confirmed before.

    Without an initial state the first run counts from its first row and gives no event.
    """
    x = runs(df, keys, order, state)
    needed = frames if initial is not None else F.when(F.col("run") == 1, 1).otherwise(frames)
    points = x.where(F.col("age") == needed)
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    points = points.withColumn("before", before if initial is None else F.coalesce(before, initial))
    return points.where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))


def throttle(df: DataFrame, keys: list[str], at: str, gap: str, ident: str) -> DataFrame:
    """keys and ident of the rows that pass: the first of a key, then each that is at least its gap after the last that passed.

    Rows are (at: seconds, ident) in that order; a gap of 0 or less lets all pass. A row so long after the one before
    passes whatever passed earlier, so a key's rows are cut there, and each piece is folded by itself.
    """
    w = W.partitionBy(*keys).orderBy(at, ident)
    whole = df.withColumn("_gap", F.max(gap).over(W.partitionBy(*keys)).cast("double"))
    free = whole.where("_gap <= 0").select(*keys, F.col(ident).cast("long").alias(ident))
    cut = whole.where("_gap > 0").withColumn("_cut", F.when(F.col(at) - F.lag(at).over(w) >= F.col("_gap"), 1).otherwise(0))
    cut = cut.withColumn("_piece", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(last: float | None, rows: dict[str, list]) -> tuple[list[tuple], float | None]:
        out = []
        for t, i, least in zip(rows[at], rows[ident], rows["_gap"], strict=True):
            if last is None or t - last >= least:
                last = float(t)
                out.append((int(i),))
        return out, last

    # the second piece and those after it begin with a row that passes, so each is a key of its own
    kept = folded(cut.select(*keys, "_piece", F.col(at).cast("double").alias(at), F.col(ident).cast("long").alias(ident), "_gap"), [*keys, "_piece"], [at, ident], f"{ident} long", fold)
    return kept.drop("_piece").unionByName(free)


def scheduled(df: DataFrame, keys: list[str], at: str, step: float, ident: str) -> DataFrame:
    """keys and ident of the rows that a schedule of one each step seconds publishes.

    A row passes from the next planned time on. The one after that is planned a step later than planned, so jitter
    doesn't wear the rate down, but no more than a step behind the row: after a stall it starts anew. A row three steps
    after the one before is such a start, so keys are cut there.
    """
    w = W.partitionBy(*keys).orderBy(at, ident)
    x = df.select(*keys, F.col(at).cast("double").alias(at), F.col(ident).cast("long").alias(ident))
    x = x.withColumn("_piece", F.sum(F.when(F.col(at) - F.lag(at).over(w) >= 3 * step, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(planned: float | None, rows: dict[str, list]) -> tuple[list[tuple], float | None]:
        out = []
        for t, i in zip(rows[at], rows[ident], strict=True):
            if planned is None or t >= planned:
                planned = float(t - step if planned is None else max(planned + step, t - step))
                out.append((int(i),))
        return out, planned

    return folded(x, [*keys, "_piece"], [at, ident], f"{ident} long", fold).drop("_piece")


def recorded(df: DataFrame, keys: list[str], at: str, ident: str, interval: float, segment: float, still: float, lost: float) -> DataFrame:
    """keys, ident, segment (seconds at which it began) and still of the rows that a recorder writes.

    A row is written when the last one written lies interval seconds back. Segments begin with a row written, the first
    that comes so long after their beginning, or after lost seconds without a row; a written row is kept as a still too
    when the last still lies so far back (0: no stills). Rows are (at: seconds, ident) in that order. A row after a
    silence as long as all of these begins anew whatever was before it, so a key's rows are cut there.
    """
    w = W.partitionBy(*keys).orderBy(at, ident)
    x = df.select(*keys, F.col(at).cast("double").alias(at), F.col(ident).cast("long").alias(ident)).withColumn("_silence", F.col(at) - F.lag(at).over(w))
    x = x.withColumn("_piece", F.sum(F.when(F.col("_silence") >= max(interval, still, lost), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))

    def fold(state: list | None, rows: dict[str, list]) -> tuple[list[tuple], list]:
        written, began, kept = state or (None, None, None)
        out = []
        for t, i, silence in zip(rows[at], rows[ident], rows["_silence"], strict=True):
            if silence is not None and silence >= lost:
                began = None
            if written is not None and t - written < interval:
                continue
            written = t
            if began is None or t - began >= segment:
                began = t
            as_still = still > 0 and (kept is None or t - kept >= still)
            if as_still:
                kept = t
            out.append((i, began, as_still))
        return out, [written, began, kept]

    return folded(x, [*keys, "_piece"], [at, ident], f"{ident} long, segment double, still boolean", fold).drop("_piece")


def rolling_hits(df: DataFrame, keys: list[str], order: list[str], hit: Column, n: int) -> DataFrame:
    """df with hits: how many of the last n rows hit."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("hits", F.sum(F.when(hit, 1).otherwise(0)).over(w))


def growing(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with growing: whether the last three values rise strictly."""
    w = W.partitionBy(*keys).orderBy(*order)
    a, b = F.lag(value, 2).over(w), F.lag(value, 1).over(w)
    return df.withColumn("growing", F.coalesce((a < b) & (b < F.col(value)), F.lit(False)))


def gaps(df: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """Feeds lost and restored: rows (keys, at, kind, gap_s) at both ends of each gap of so many seconds."""
    w = W.partitionBy(*keys).orderBy(at)
    x = df.withColumn("_next", F.lead(at).over(w)).withColumn("gap_s", F.col("_next") - F.col(at)).where(F.col("gap_s") >= least)
    both = F.array(F.struct(F.lit("feed_lost").alias("kind"), F.col(at).alias("at")), F.struct(F.lit("feed_restored").alias("kind"), F.col("_next").alias("at")))
    return x.select(*keys, "gap_s", F.explode(both).alias("e")).select(*keys, "e.kind", "e.at", "gap_s")


def episodes(df: DataFrame, keys: list[str], at: str, spark: str, window: int = 10, needed: int = 3, calm: float = 4.0, y: str | None = None, jump: float = 25.0) -> DataFrame:
    """Starts of episodes: needed of the last window rows count, the present one sparks, and no episode is on.

    A spark counts unless its y lies over jump above that of the spark before. An episode ends, and what was counted
    is forgotten, at the first row calm seconds after the last spark; nothing is forgotten while none is on. Of rows at
    one time those that don't spark come first, then by y.
    """
    height = F.col(y).cast("double") if y else F.lit(0.0)
    x = df.select(*keys, F.col(at).cast("double").alias("_t"), F.col(spark).cast("int").alias("_s"), height.alias("_y"))

    def fold(carried: list | None, rows: dict[str, list]) -> tuple[list[tuple], list]:
        recent, latched, last, high = carried or ([], False, None, None)
        out = []
        for t, s, v in zip(rows["_t"], rows["_s"], rows["_y"], strict=True):
            counts = s == 1 and not (high is not None and v - high < -jump)
            if s == 1:
                last, high = t, v
            recent = [*recent, int(counts)][-window:]
            if latched and last is not None and t - last >= calm:
                latched, recent, high = False, [], None
            if s == 1 and not latched and sum(recent) >= needed:
                latched = True
                out.append((t,))
        return out, [recent, latched, last, high]

    return folded(x, keys, ["_t", "_s", "_y"], "started double", fold)


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float = 0.9) -> DataFrame:
    """keys and ema: keep times the old mean, the rest of it the new value; the first value starts it.

    Written out, each value has the weight that later ones left it, so it is one weighted sum.
    """
    backwards = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    x = df.withColumn("_later", F.row_number().over(backwards) - 1).withColumn("_first", F.lead(F.lit(1)).over(backwards).isNull())
    weight = F.pow(F.lit(float(keep)), F.col("_later")) * F.when(F.col("_first"), 1.0).otherwise(1.0 - keep)
    return x.groupBy(*keys).agg(F.sum(weight * F.col(value).cast("double")).alias("ema"))


def resample(index: Column, step: float) -> Column:
    """Whether the frame of this index (from 0) stays when one in step does."""
    return (index == 0) | (F.floor(index / step) > F.floor((index - 1) / step))


def backoff(attempt: Column, first: float, most: float) -> Column:
    """Seconds before the attempt after this one."""
    return F.least(F.lit(float(first)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def marked(df: DataFrame, keys: list[str], order: list[str], sets: Column, tick: str, ttl: int) -> DataFrame:
    """df with marked: whether a mark was set at most ttl ticks ago."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("marked", F.coalesce(F.col(tick) - F.last(F.when(sets, F.col(tick)), ignorenulls=True).over(w) <= ttl, F.lit(False)))


#: Seconds of a stretch in which a ring's rows are counted by themselves.
STRETCH = 300


def held_at(df: DataFrame, keys: list[str], at: str, seconds: float, frame: Column, asks: Column) -> DataFrame:
    """The rows of df that ask, with held: how many frames of their key a ring of so many seconds holds at their time.

    at: microseconds. A frame adds one from its own time on and takes it back just after its last, so held is a running
    sum. Stretches of a key are summed apart, each from what those before it leave: no row meets another, and no task
    holds a key. Rows without a time are in a ring of their own.
    """
    ring = int(seconds * 1_000_000)
    comes = df.withColumns({"_k": F.col(at) * 2, "_w": F.when(frame, 1).otherwise(0).cast("long"), "_asks": asks})
    goes = df.where(frame & F.col(at).isNotNull()).select(*keys, ((F.col(at) + ring) * 2 + 1).alias("_k"), F.lit(-1).cast("long").alias("_w"), F.lit(False).alias("_asks"))
    width = 2 * STRETCH * 1_000_000
    moves = comes.unionByName(goes, allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_k") / width))
    sums = moves.where("_stretch IS NOT NULL").groupBy(*keys, "_stretch").agg(F.sum("_w").alias("_w"))
    before = F.sum("_w").over(W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    left = sums.select(*keys, "_stretch", (F.col("_stretch") * width).alias("_k"), F.coalesce(before, F.lit(0)).alias("_w"), F.lit(False).alias("_asks"))
    own = W.partitionBy(*keys, "_stretch").orderBy("_k").rangeBetween(W.unboundedPreceding, 0)
    return moves.unionByName(left, allowMissingColumns=True).withColumn("held", F.sum("_w").over(own)).where("_asks").drop("_k", "_w", "_asks", "_stretch")


def held(df: DataFrame, keys: list[str], at: str, seconds: float) -> DataFrame:
    """df with held: rows of the key that a ring of so many seconds holds with this one (at: seconds)."""
    x = df.withColumn("_at", F.round(F.col(at) * 1_000_000).cast("long"))  # seconds as doubles lie within a microsecond
    return held_at(x, keys, "_at", seconds, F.lit(True), F.lit(True)).drop("_at")


def clip_rate(n: Column, span: Column, fallback: float = 10.0) -> Column:
    """Frames a second of a clip; null for fewer than two frames, the fallback where they have no span."""
    return F.when(n < 2, None).when(span <= 0, fallback).otherwise((n - 1) / span)


def cadence(seq: Column, person_every: int, fire_every: int, fire_offset: int, ppe_every: int) -> dict[str, Column]:
    """Which detectors run on a frame; protective equipment on every so many runs of the person detector."""
    person = seq % person_every == 0
    return {"person": person, "fire": seq % fire_every == fire_offset % fire_every, "ppe": person & (F.floor(seq / person_every) % ppe_every == 0)}


def paced(df: DataFrame, keys: list[str], at: str, fps: float, ident: str) -> DataFrame:
    """The first row of each key in every slot of 1 / fps seconds, counted from 1970."""
    slot = F.floor(F.col(at) * fps)
    first = df.groupBy(*keys, slot.alias("_slot")).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(at, ident)).alias("_r"))
    return first.select(*keys, "_r.*")


#: Stretches that an order without keys is cut into.
STRETCHES = 64


def stretched(df: DataFrame, order: str) -> DataFrame:
    """df with _p: stretches of about equally many rows, rising with a numeric order."""
    bounds = df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / STRETCHES for k in range(1, STRETCHES)], 0.002)
    cuts = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]).cast("array<double>")
    return df.withColumn("_p", F.size(F.filter(cuts, lambda b: b < F.col(order))))


def with_previous(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before in a numeric order of all rows, stretch by stretch: no task sees more than one."""
    x = stretched(df, order)
    last = x.groupBy("_p").agg(F.max_by(value, order).alias("_last"))
    carried = last.select("_p", F.lag("_last").over(W.orderBy("_p")).alias("_carried"))  # a row a stretch
    inner = W.partitionBy("_p").orderBy(order)
    y = x.withColumn("_first", F.row_number().over(inner) == 1).withColumn(name, F.lag(value).over(inner)).join(carried, "_p")
    return y.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))).drop("_p", "_first", "_carried")


def with_running_sum(df: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """df with the sum of an amount up to each row in a numeric order of all rows, stretch by stretch."""
    x = stretched(df.withColumn("_amount", amount), order)
    sums = x.groupBy("_p").agg(F.sum("_amount").alias("_sum"))
    before = sums.select("_p", F.coalesce(F.sum("_sum").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_sum_before"))
    own = F.sum("_amount").over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn(name, own).join(before, "_p").withColumn(name, F.col(name) + F.col("_sum_before")).drop("_p", "_amount", "_sum_before")
