"""Keyed state with a lifetime: identities, protective equipment, welding episodes, and queues with a bound.

Each operator is a step over the rows of one key in order, so a stream, however
it is cut into batches, gives what the same rows give at once. States end by
event time: a key that is silent for its lifetime after the watermark passed is
dropped by a timer, and one that comes back later starts anew either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

#: Seconds that an identity is kept without a sighting, and checks of a camera that an item's state is kept.
IDENTITY_S, PPE_CHECKS = 5.0, 300
#: Alerts that wait for their sink, and alerts that wait for their clip, at most.
QUEUE, PENDING = 1000, 20

#: (state or None, rows in order) -> (results, state or None)
Step = Callable[[tuple | None, pd.DataFrame], tuple[list[tuple], tuple | None]]


def keyed(rows: DataFrame, keys: list[str], order: list[str], output: str, state: str, step: Step, lifetime_s: float | None = None, at: str = "ts") -> DataFrame:
    """keys and output of the steps over a stream; with a lifetime, a key's state ends so long after its newest row by the watermark of at."""
    names = [part.split()[0] for part in output.split(", ")]
    kinds = dict(rows.dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(order, na_position="first")
        out, after = step(held.get if held.exists else None, pdf)
        if after is not None:
            held.update(after)
            if lifetime_s is not None:
                newest = int(pdf[at].max().timestamp() * 1000)
                held.setTimeoutTimestamp(max(newest + int(lifetime_s * 1000), held.getCurrentWatermarkMs()) + 1)
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(*key, *r) for r in out], columns=[*keys, *names])

    timeout = GroupStateTimeout.NoTimeout if lifetime_s is None else GroupStateTimeout.EventTimeTimeout
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), output])
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", timeout)


def identity_step(ttl: float = IDENTITY_S) -> Step:
    """Rows at (seconds), alert_id, subtype, identity_status; results alert_id and identity of the exits: that of the last entry, null if it was forgotten."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        known, seen = state or (None, None)
        out = []
        for r in rows.itertuples():
            if seen is not None and r.at - seen > ttl:
                known = None
            seen = float(r.at)
            if r.subtype == "entry":
                known = r.identity_status if isinstance(r.identity_status, str) else "no_face"
            elif r.subtype == "exit":
                out.append((int(r.alert_id), known))
        return out, (known, seen)

    return step


def identity_stream(rows: DataFrame, ttl: float = IDENTITY_S) -> DataFrame:
    """camera_id, track_id, alert_id and identity of each exit. rows: camera_id, track_id, ts (with a watermark), at, alert_id, subtype, identity_status; sightings have no subtype."""
    return keyed(rows, ["camera_id", "track_id"], ["at", "alert_id"], "alert_id long, identity string", "known string, seen double", identity_step(ttl), ttl)


def ppe_step(frames: int = 3, ttl: int = PPE_CHECKS) -> Step:
    """Rows check_no and state (present, absent, or else unclear); result the check_no at which an item has been absent so often in a row."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        age, fired, last = state or (0, False, None)
        out = []
        for r in rows.itertuples():
            if last is not None and r.check_no - last > ttl + 1:
                age, fired = 0, False
            last = int(r.check_no)
            if r.state == "present":
                age, fired = 0, False
            elif r.state == "absent":
                age += 1
                if not fired and age >= frames:
                    fired = True
                    out.append((last,))
        return out, (age, fired, last)

    return step


def ppe_stream(checks: DataFrame, frames: int = 3, ttl: int = PPE_CHECKS, lifetime_s: float = 600.0) -> DataFrame:
    """camera_id, zone_id, track_id, item, check_no of violations. checks: these, ts (with a watermark) and state; a silent key is dropped after lifetime_s."""
    return keyed(checks, ["camera_id", "zone_id", "track_id", "item"], ["check_no"], "check_no long", "age int, fired boolean, last long", ppe_step(frames, ttl), lifetime_s)


def episode_step(window: int = 10, needed: int = 3, calm: float = 4.0, jump: float = 25.0) -> Step:
    """Rows at, spark, y; results the starts of episodes, as sequences.episodes() gives them."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        recent, latched, last, height = (list(state[0]), *state[1:]) if state else ([], False, None, None)
        out = []
        for r in rows.itertuples():
            t, y = float(r.at), float(r.y)
            counts = bool(r.spark) and not (height is not None and y - height < -jump)
            if r.spark:
                last, height = t, y
            recent = [*recent, int(counts)][-window:]
            if latched and last is not None and t - last >= calm:
                latched, recent, height = False, [], None
            if r.spark and not latched and sum(recent) >= needed:
                latched = True
                out.append((t,))
        return out, (recent, latched, last, height)

    return step


def episode_stream(rows: DataFrame, window: int = 10, needed: int = 3, calm: float = 4.0, jump: float = 25.0) -> DataFrame:
    """camera_id and started of each episode: so many sparks of the last rows, re-armed by calm. rows: camera_id, at, spark, y."""
    return keyed(rows, ["camera_id"], ["at"], "started double", "recent array<int>, latched boolean, last double, y double", episode_step(window, needed, calm, jump))


def queue_step(capacity: int, served: int) -> Step:
    """Rows seq; each step takes them in, drops the oldest beyond capacity, and serves some; results seq, dropped so far."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        waiting, dropped = (list(state[0]), state[1]) if state else ([], 0)
        waiting += [int(s) for s in rows["seq"]]
        if (over := len(waiting) - capacity) > 0:
            waiting, dropped = waiting[over:], dropped + over
        return [(s, dropped) for s in waiting[:served]], (waiting[served:], dropped)

    return step


def bounded_queue(rows: DataFrame, capacity: int = QUEUE, served: int = 100) -> DataFrame:
    """lane, seq and dropped (how many the lane has lost so far) of what is served, the oldest first. rows: lane, seq.

    A lane that is full loses its oldest. Each batch with rows of a lane serves so many; rows of lane that only wake it
    have a null seq.
    """

    def step(state: tuple | None, pdf: pd.DataFrame) -> tuple[list[tuple], tuple | None]:
        return queue_step(capacity, served)(state, pdf[pdf["seq"].notna()])

    return keyed(rows, ["lane"], ["seq"], "seq long, dropped long", "waiting array<long>, dropped long", step)
