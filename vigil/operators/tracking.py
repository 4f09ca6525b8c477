"""Boxes linked over time: association inside spells of activity, then windows over the links.

Association depends on what was taken before, so it is a fold over the boxes of
one camera (or of one of its classes). A silence longer than links may span ends every link, so a camera's
boxes are cut there, and spells are folded apart. A fold walks its boxes batch
by batch and carries what is live (a few boxes or tracks), so no task holds a
camera's history, however long it is never silent. What comes after the links
(K of N, growth) is window functions. An object is named by its first box.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vigil.operators.folds import Fold, folded
from vigil.operators.similarity import BOX


def spells(boxes: DataFrame, longest: int, keys: tuple[str, ...]) -> DataFrame:
    """boxes with _spell: a new one of a key after a silence of more than so many ticks."""
    w = W.partitionBy(*keys).orderBy("tick")
    new = F.when(F.col("tick") - F.lag("tick").over(w) > longest, 1).otherwise(0)
    return boxes.withColumn("_new", new).withColumn("_spell", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_new")


def linked(boxes: DataFrame, longest: int, fold: Fold, name: str, keys: tuple[str, ...] = ("camera_id",)) -> DataFrame:
    """keys, det_id and the object (its first box) that fold links the boxes of each spell of a key with."""
    x = spells(boxes, longest, keys).select(*keys, "_spell", F.col("tick").cast("long").alias("tick"), F.col("det_id").cast("long").alias("det_id"), *[c for c in ["score"] if c in boxes.columns], *[F.col(c).cast("double").alias(c) for c in BOX])
    return folded(x, [*keys, "_spell"], ["tick", "det_id"], f"det_id long, {name} long", fold, "tick").drop("_spell")


#: Candidates that choose at once.
CHOOSERS = 512


def chosen(candidates: np.ndarray, boxes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that choose a box, and which: one after the other takes the free box of most overlap, of equal ones the last.

    Some candidates at a time meet the boxes that are free then, and only pairs of enough overlap are made.
    """
    free, at, many, mine, theirs = np.arange(len(boxes)), 0, CHOOSERS, [], []
    while at < len(candidates) and len(free):
        found = alike(candidates[at : at + many], boxes[free], least, np.inf, PAIRS if many > 1 else np.inf)
        if found is None:
            many = max(1, many // 2)
            continue
        who, box, share = found
        order = np.lexsort((-box, -share, who))
        taken, last = bytearray(len(free)), -1
        for i, j in zip(who[order].tolist(), box[order].tolist(), strict=True):
            if i != last and not taken[j]:
                taken[j], last = 1, i
                mine.append(at + i)
                theirs.append(int(free[j]))
        free, at = free[np.frombuffer(taken, np.uint8) == 0], at + many
    return np.array(mine, np.int64), np.array(theirs, np.int64)


def candidates(boxes: DataFrame, n: int, least: float) -> DataFrame:
    """camera_id, det_id, candidate: older candidates choose first, of their class the box of most overlap; none is chosen again n ticks after its last box.

    Candidates meet boxes of their class alone, so a camera's classes are folded apart.
    """

    def fold(carried: tuple | None, rows: dict[str, list]) -> tuple[list[tuple[int, int]], tuple]:
        none = np.zeros(0, np.int64)
        first, seen, latest = carried or (none, none, np.zeros((0, 4)))  # in the order of making
        ticks, dets, at = np.array(rows["tick"], np.int64), np.array(rows["det_id"], np.int64), np.stack([np.array(rows[c], np.float64) for c in BOX], axis=1)
        starts, out = np.flatnonzero(np.concatenate(([True], ticks[1:] != ticks[:-1]))).tolist(), []
        for a, b in zip(starts, [*starts[1:], len(ticks)], strict=True):
            live = ticks[a] - seen <= n
            first, seen, latest = first[live], seen[live], latest[live]
            here = a + np.flatnonzero(np.concatenate((dets[a + 1 : b] != dets[a : b - 1], [True])))
            mine, theirs = chosen(latest, at[here], least)
            seen[mine], latest[mine] = ticks[a], at[here[theirs]]
            out += zip(dets[here[theirs]].tolist(), first[mine].tolist(), strict=True)
            new = np.delete(here, theirs)
            first, seen, latest = np.concatenate((first, dets[new])), np.concatenate((seen, ticks[new])), np.concatenate((latest, at[new]))
            out += zip(dets[new].tolist(), dets[new].tolist(), strict=True)
        return out, (first, seen, latest)

    return linked(boxes, n, fold, "candidate", ("camera_id", "klass")).drop("klass")


def k_of_n(boxes: DataFrame, k: int, n: int, least: float = 0.3) -> DataFrame:
    """The first box with which a candidate has k boxes in the last n ticks, and whether its last three areas rise.

    boxes: camera_id, tick, klass, det_id, x1, y1, x2, y2.
    """
    x = boxes.join(candidates(boxes, n, least), ["camera_id", "det_id"])
    own = W.partitionBy("camera_id", "candidate").orderBy("tick")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    x = x.withColumn("_area", area).withColumn("_hits", F.count("*").over(own.rangeBetween(1 - n, 0)))
    rises = F.coalesce((F.lag("_area", 2).over(own) < F.lag("_area").over(own)) & (F.lag("_area").over(own) < F.col("_area")), F.lit(False))
    x = x.withColumn("growing", rises).where(F.col("_hits") >= k)
    first = x.withColumn("_r", F.row_number().over(own)).where("_r = 1")
    return first.select("camera_id", F.col("tick").cast("long").alias("tick"), "klass", *[F.col(c).cast("double").alias(c) for c in BOX], "growing")


#: Deviations of position and speed, as shares of a box's height, and of its shape and the shape's change.
POSITION, SPEED, SHAPE, SHAPE_SPEED, SHAPE_SEEN = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1


class Motion:
    """Constant-velocity Kalman filters of many boxes: centre, shape (width over height) and height, each with its speed.

    Noise of the four is independent, so each is a filter of two states of its own: x and v are n x 4, and p, q, r the
    entries of their covariances.
    """

    def __init__(self, seen: np.ndarray):
        h = seen[:, 3:4]
        self.x, self.v = seen.copy(), np.zeros_like(seen)
        self.p, self.q, self.r = (2 * self.spread(h, POSITION, SHAPE / 2)) ** 2, np.zeros_like(seen), (10 * self.spread(h, SPEED, SHAPE_SPEED / 10)) ** 2

    @staticmethod
    def spread(h: np.ndarray, share: float, shape: float) -> np.ndarray:
        return np.concatenate((share * h, share * h, np.full_like(h, shape), share * h), axis=1)

    def predict(self) -> None:
        h = np.abs(self.x[:, 3:4])
        self.x = self.x + self.v
        self.p = self.p + 2 * self.q + self.r + self.spread(h, POSITION, SHAPE) ** 2
        self.q = self.q + self.r
        self.r = self.r + self.spread(h, SPEED, SHAPE_SPEED) ** 2

    def update(self, at: np.ndarray, seen: np.ndarray) -> None:
        """Correct the filters at these places by what was seen."""
        s = self.p[at] + self.spread(np.abs(self.x[at, 3:4]), POSITION, SHAPE_SEEN) ** 2
        gain, drift, off = self.p[at] / s, self.q[at] / s, seen - self.x[at]
        self.x[at] += gain * off
        self.v[at] += drift * off
        self.r[at] -= drift * self.q[at]
        self.q[at] -= gain * self.q[at]
        self.p[at] -= gain * self.p[at]

    def boxes(self) -> np.ndarray:
        w, h = self.x[:, 2] * self.x[:, 3] / 2, self.x[:, 3] / 2
        return np.stack((self.x[:, 0] - w, self.x[:, 1] - h, self.x[:, 0] + w, self.x[:, 1] + h), axis=1)

    def take(self, at: np.ndarray) -> None:
        for name in "xvpqr":
            setattr(self, name, getattr(self, name)[at])

    def add(self, other: Motion) -> None:
        for name in "xvpqr":
            setattr(self, name, np.concatenate((getattr(self, name), getattr(other, name))))


def measured(boxes: np.ndarray) -> np.ndarray:
    """Centre, shape and height of boxes."""
    w, h = boxes[:, 2] - boxes[:, 0], np.maximum(boxes[:, 3] - boxes[:, 1], 1e-9)
    return np.stack((boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h), axis=1)


#: Comparisons at once, and pairs of different boxes that are sorted at once.
CHUNK, PAIRS = 1 << 20, 1 << 21


def alike(a: np.ndarray, b: np.ndarray, least: float, below: float, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows, columns and overlaps of at least least and under below of boxes a with boxes b; None for more than most.

    Two boxes overlap no more than their sides along x do. So the left end of a box lies at most (1 - least) widths
    after that of a, and (1 - least) / least widths before it, where also least widths of a must lie in that of b: b is
    walked in that order, some comparisons at a time.
    """
    order = np.argsort(b[:, 0], kind="stable")
    b, width = b[order], np.maximum(a[:, 2] - a[:, 0], 0)
    if least > 0:
        spare = 1e-6 * width + 1e-9 * np.abs(a[:, 0]) + 1e-9
        with np.errstate(over="ignore"):
            before = np.minimum(width * (1 - least) / least, np.fmax.reduce(b[:, 2] - b[:, 0], initial=0.0) - width * least)
        low = np.searchsorted(b[:, 0], a[:, 0] - before - spare)
        high = np.searchsorted(b[:, 0], a[:, 0] + width * (1 - least) + spare, side="right")
    else:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(b))
    many = np.maximum(high - low, 0)
    ends, found, count, at = np.concatenate(([0], np.cumsum(many))), [], 0, 0
    while at < ends[-1]:
        upto = min(at + CHUNK, int(ends[-1]))
        k = np.arange(at, upto)
        i = np.searchsorted(ends, k, side="right") - 1
        j = low[i] + k - ends[i]
        share = overlap_of(a[i], b[j])
        kept = np.flatnonzero((share >= least) & (share < below))
        found.append((i[kept], order[j[kept]], share[kept]))
        count, at = count + len(kept), upto
        if count > most:
            return None
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def overlap_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes side by side."""
    size = lambda x: np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
    side = lambda k: np.maximum(np.minimum(a[:, k + 2], b[:, k + 2]) - np.maximum(a[:, k], b[:, k]), 0)
    both = side(0) * side(1)
    union = size(a) + size(b) - both
    return np.where(union > 0, both / np.maximum(union, 1e-12), 0.0)


class Places:
    """Different boxes, each with the numbers that are still free of those that lie there."""

    def __init__(self, boxes: np.ndarray):
        order = np.lexsort(boxes.T[::-1])  # stable, so numbers rise at each place
        new = np.ones(len(order), bool)
        new[1:] = (boxes[order[1:]] != boxes[order[:-1]]).any(axis=1)
        starts = np.flatnonzero(new)
        self.boxes, self.order = boxes[order[starts]], order.tolist()
        self.next, self.end = starts.tolist(), [*starts[1:].tolist(), len(order)]

    def free(self) -> np.ndarray:
        return np.flatnonzero(np.asarray(self.next) < np.asarray(self.end))

    def first(self, place: int) -> int:
        return self.order[self.next[place]]

    def left(self, place: int) -> int:
        return self.end[place] - self.next[place]

    def take(self, place: int, n: int) -> list[int]:
        at = self.next[place]
        self.next[place] = at + n
        return self.order[at : at + n]


def matched(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Boxes of a and b that go together, the pair of most overlap first, then by number in a and in b.

    Boxes at one place count once and are taken by number. Pairs are made in bands of overlap, from the top, of what no
    band above took: a band that would hold too many is made narrower. So neither all pairs nor a matrix of them exist.
    """
    rows, columns, out = Places(a), Places(b), []
    below = np.inf
    while below > least:
        p, q = rows.free(), columns.free()
        if not len(p) or not len(q):
            break
        floor = max(least, 0.9 if below > 1 else 2 * below - 1 if below > 0.75 else below - 0.25)
        top = min(below, 1.0 + 1e-9)
        found = alike(rows.boxes[p], columns.boxes[q], floor, below, PAIRS)
        while found is None:
            floor = (floor + top) / 2
            found = alike(rows.boxes[p], columns.boxes[q], floor, below, PAIRS if top - floor > 1e-9 else np.inf)
        greedy(p[found[0]], q[found[1]], found[2], rows, columns, out)
        below = floor
    return out


def greedy(p: np.ndarray, q: np.ndarray, share: np.ndarray, rows: Places, columns: Places, out: list[tuple[int, int]]) -> None:
    """Take pairs of places by falling overlap; where overlaps are equal, by row and then by column."""
    if not len(share):
        return
    order = np.argsort(-share, kind="stable")
    share = share[order]
    starts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1]))).tolist()
    p, q = p[order].tolist(), q[order].tolist()
    for lo, hi in zip(starts, [*starts[1:], len(p)], strict=True):
        if hi - lo == 1:
            n = min(rows.left(p[lo]), columns.left(q[lo]))
            if n:
                out += zip(rows.take(p[lo], n), columns.take(q[lo], n), strict=True)
            continue
        near: dict[int, list[int]] = {}
        for k in range(lo, hi):
            if rows.left(p[k]) and columns.left(q[k]):
                near.setdefault(p[k], []).append(q[k])
        heap = [(rows.first(place), place) for place in near]
        heapify(heap)
        while heap:
            row, place = heappop(heap)
            near[place] = [c for c in near[place] if columns.left(c)]
            if near[place]:
                column = min(near[place], key=columns.first)
                rows.take(place, 1)
                out.append((row, columns.take(column, 1)[0]))
                if rows.left(place):
                    heappush(heap, (rows.first(place), place))


def track(boxes: DataFrame, high: float = 0.5, low: float = 0.1, least: float = 0.2, lost_after: int = 30, sure_after: int = 2) -> DataFrame:
    """camera_id, det_id and track_id (its first box) of the boxes of sure tracks.

    Tracks move on as they did (a constant-velocity filter) until they are seen again, for lost_after ticks. Boxes of
    high score meet all tracks by overlap with where these should be; then boxes down to low meet what is left. Only
    high ones begin tracks. A track is sure once it was seen in sure_after ticks in a row; before, its boxes have no
    track, and it ends with the first tick that misses it. Ticks are the frames on which the detector ran.
    """

    def fold(carried: tuple | None, rows: dict[str, list]) -> tuple[list[tuple[int, int]], tuple]:
        none = np.zeros(0, np.int64)
        motion, ids, hits, seen, now = carried or (Motion(np.zeros((0, 4))), none, none, none, None)
        out: list[tuple[int, int]] = []
        pdf = pd.DataFrame(rows)
        for tick, part in pdf[pdf.score >= low].groupby("tick"):
            for _ in range(int(tick - now) if now is not None else 0):
                if not len(ids):
                    break
                motion.predict()
            now = int(tick)
            live = (now - seen <= lost_after) & ((hits >= sure_after) | (now - seen == 1))
            motion.take(live)
            ids, hits, seen = ids[live], hits[live], seen[live]
            at = part[["x1", "y1", "x2", "y2"]].to_numpy(float)
            dets, strong = part["det_id"].to_numpy(np.int64), part["score"].to_numpy(float) >= high
            free, taken = np.arange(len(ids)), np.zeros(len(dets), bool)
            for group in (np.flatnonzero(strong), np.flatnonzero(~strong)):
                if not len(group) or not len(free):
                    continue
                pairs = matched(at[group], motion.boxes()[free], least)
                if not pairs:
                    continue
                mine, theirs = group[[i for i, _ in pairs]], free[[j for _, j in pairs]]
                motion.update(theirs, measured(at[mine]))
                hits[theirs] = np.where(now - seen[theirs] == 1, hits[theirs] + 1, np.maximum(hits[theirs], 1))
                seen[theirs] = now
                taken[mine] = True
                out += [(int(dets[i]), int(ids[j])) for i, j in zip(mine, theirs, strict=True) if hits[j] >= sure_after]
                free = np.setdiff1d(free, theirs)
            new = np.flatnonzero(strong & ~taken)
            if len(new):
                motion.add(Motion(measured(at[new])))
                ids, hits, seen = np.concatenate((ids, dets[new])), np.concatenate((hits, np.ones(len(new), np.int64))), np.concatenate((seen, np.full(len(new), now)))
                if sure_after <= 1:
                    out += [(int(d), int(d)) for d in dets[new]]
        return out, (motion, ids, hits, seen, now)

    return linked(boxes, lost_after, fold, "track_id")


def confirmed(detections: DataFrame) -> DataFrame:
    """Detections of tracks that a tracker has confirmed; track 0 is one."""
    return detections.where("track_id >= 0")


def label(masked: Column, small: Column, track: Column) -> Column:
    """What is written beside a box."""
    return F.when(masked, "MASKED").when(small, "SMALL").otherwise(F.concat(F.lit("#"), track.cast("string")))
