"""Stateful streams: boundary hysteresis with left-view exits and eviction, throttles, idempotent sinks.

Each operator is one step function; the stream and the batch fold both use it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vigil.operators.boundaries import EVICT_AFTER, LEFT_AFTER

#: Rows that a dimension read again for each batch may have.
MAX_DIMENSION = 100_000
#: Seconds in which the follow-up of an alert can come.
FOLLOW_S = 3600.0
EVENTS = "camera_id string, zone_id string, track_id long, update_no long, kind string"


def boundary_step(state: dict[str, Any], update_no: int, seen: dict[int, tuple[bool, bool]], frames: int) -> list[tuple[int, str]]:
    """Advance one zone by one update; seen: track -> (inside, at the frame's edge). Returns (track, kind) events.

    state maps a track to [confirmed, candidate, age, last_seen, at_edge]. A track's first sight settles it, except that
    one born inside at the edge after the first updates begins outside and so can enter.
    """
    out = []
    for track, (inside, edge) in sorted(seen.items()):
        s = state.get(str(track))
        if s is None:
            born = inside and edge and update_no > LEFT_AFTER
            state[str(track)] = [False, True, 1, update_no, edge] if born else [inside, inside, frames, update_no, edge]
            continue
        confirmed, candidate, age, _, _ = s
        age = age + 1 if candidate == inside else 1
        candidate = inside
        if candidate != confirmed and age >= frames:
            confirmed = candidate
            out.append((track, "entry" if confirmed else "exit"))
        state[str(track)] = [confirmed, candidate, age, update_no, edge]
    for track, s in sorted(state.items(), key=lambda x: int(x[0])):
        if s[0] and s[4] and s[3] <= update_no - LEFT_AFTER:
            s[0] = s[1] = False
            out.append((int(track), "exit"))
    if update_no > EVICT_AFTER:
        for track in [t for t, s in state.items() if s[3] < update_no - EVICT_AFTER]:
            del state[track]
    return out


def fold_zone(rows: pd.DataFrame, state: dict[str, Any], frames: int) -> list[tuple[int, int, str]]:
    """Events (update, track, kind) of one zone's rows (update_no, track_id, inside, at_edge).

    A null track marks an empty update. A row whose column reset is true (a camera was set up anew, a zone redrawn)
    forgets all tracks before its update.
    """
    out = []
    for u, part in rows.sort_values(["update_no", "track_id"]).groupby("update_no", sort=True):
        if "reset" in part.columns and part["reset"].fillna(False).any():
            state.clear()
        seen = {int(r.track_id): (bool(r.inside), bool(r.at_edge)) for r in part.itertuples() if pd.notna(r.track_id)}
        out += [(int(u), t, kind) for t, kind in boundary_step(state, int(u), seen, frames)]
    return out


def boundary_batch(observations: DataFrame, frames: int) -> DataFrame:
    """The stream's steps over a table (camera_id, zone_id, update_no, track_id, inside, at_edge), zone by zone; operators.boundaries does the same by windows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, t, u, kind) for u, t, kind in fold_zone(pdf, {}, frames)]
        return pd.DataFrame(rows, columns=["camera_id", "zone_id", "track_id", "update_no", "kind"])

    return observations.groupBy("camera_id", "zone_id").applyInPandas(run, EVENTS)


def boundary_stream(observations: DataFrame, frames: int) -> DataFrame:
    """The same over a stream whose updates arrive in order for each camera."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(parts))
        rows = [(*key, t, u, kind) for u, t, kind in fold_zone(pdf, known, frames)]
        state.update((json.dumps(known),))
        yield pd.DataFrame(rows, columns=["camera_id", "zone_id", "track_id", "update_no", "kind"])

    return observations.groupBy("camera_id", "zone_id").applyInPandasWithState(run, EVENTS, "tracks string", "append", GroupStateTimeout.NoTimeout)


def throttle_step(last: float | None, at: float, gap: float) -> tuple[bool, float | None]:
    """Whether an alert passes, and the time that the next one counts from."""
    passes = gap <= 0 or last is None or at - last >= gap
    return passes, at if passes else last


def throttle_stream(alerts: DataFrame, gap: float, follow_s: float = FOLLOW_S) -> DataFrame:
    """Alerts (key string, at double, alert_id long, and followup boolean if there is one) that a throttle of gap seconds lets pass.

    A follow-up passes where the very alert that it belongs to (alert_id) passed before, at most follow_s earlier, and
    doesn't restart the gap; so what was suppressed doesn't come through later.
    """
    if "followup" not in alerts.columns:
        alerts = alerts.withColumn("followup", F.lit(False))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, ids, ats = state.get if state.exists else (None, [], [])
        sent = dict(zip(ids, ats, strict=True))
        out = []
        for r in pd.concat(list(parts)).sort_values(["at", "followup", "alert_id"]).itertuples():
            sent = {i: t for i, t in sent.items() if r.at - t <= follow_s}
            if r.followup:
                passes = r.alert_id in sent
            else:
                passes, last = throttle_step(last, r.at, gap)
                if passes:
                    sent[int(r.alert_id)] = float(r.at)
            if passes:
                out.append((key[0], r.at, r.alert_id))
        state.update((last, list(sent), list(sent.values())))
        yield pd.DataFrame(out, columns=["key", "at", "alert_id"])

    return alerts.groupBy("key").applyInPandasWithState(run, "key string, at double, alert_id long", "last double, ids array<long>, ats array<double>", "append", GroupStateTimeout.NoTimeout)


def segment_counts(frames: DataFrame, minutes: int = 15, late: str = "10 seconds") -> DataFrame:
    """Frames of each camera and recording segment, with a watermark for late ones (ts: timestamp)."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("segment"), "camera_id").agg(F.count("*").alias("n"))


def event_time(video_s: Column, ts: Column, started: Column) -> Column:
    """When something happened: its place in a video after the video's start, else its time stamp."""
    return F.coalesce(F.timestamp_micros(F.unix_micros(started.cast("timestamp")) + (video_s * 1_000_000).cast("long")), ts.cast("timestamp"))


def lanes(alerts: DataFrame, urgent: Column) -> tuple[DataFrame, DataFrame]:
    """Urgent alerts and the others, for a query each, so that neither waits for the other."""
    sure = F.coalesce(urgent, F.lit(False))
    return alerts.where(sure), alerts.where(~sure)


Sink = Callable[[DataFrame], None]


def deliver(batch: DataFrame, sinks: dict[str, Sink], attempts: int = 3, first_s: float = 0.5, most_s: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Hand a batch to every sink, each as often as it needs, up to so many attempts with doubling waits.

    A sink that fails doesn't keep the batch from the others; returned are the names of those that failed to the last, with the error.
    """
    failed: dict[str, str] = {}
    for name, sink in sinks.items():
        for attempt in range(1, attempts + 1):
            try:
                sink(batch)
                failed.pop(name, None)
                break
            except Exception as e:  # noqa: BLE001  whatever a sink raises is its own failure
                failed[name] = f"{type(e).__name__}: {e}"
                if attempt < attempts:
                    sleep(min(first_s * 2 ** (attempt - 1), most_s))
    return failed


class KeepLastGood:
    """A small table that is read again for each batch; a version that can't be read or has errors leaves the one before in place."""

    def __init__(self, read: Callable[[], DataFrame], errors: Column):
        self.read, self.errors, self.good, self.problem = read, errors, None, ""

    def __call__(self) -> DataFrame:
        try:
            rows = self.read()
            bad = rows.where(F.size(self.errors) > 0).limit(1).collect()
            self.problem = str(bad[0]) if bad else ""
            if not bad:
                # rows, not a plan over files that may change: a dimension is small, or it is an error
                held = rows.limit(MAX_DIMENSION + 1).collect()
                if len(held) > MAX_DIMENSION:
                    raise ValueError(f"a dimension of over {MAX_DIMENSION} rows")
                self.good = rows.sparkSession.createDataFrame(held, rows.schema)
        except AnalysisException as e:
            self.problem = str(e)
        if self.good is None:
            raise ValueError(f"no good version yet: {self.problem}")
        return self.good


def write_once(stream: DataFrame, path: str, key: str, checkpoint: str, then: dict[str, Sink] | None = None, day: str | None = None):
    """Append each batch to path without the keys that are there already, so that a repeated batch changes nothing.

    With day (a column of dates) the target is partitioned by it, and only the days of the batch are looked at. What
    was new goes to the sinks of then, also where the write before was a repeated one.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark, fresh = df.sparkSession, df.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        if hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(path)):
            there = spark.read.schema(df.schema).parquet(path)
            if day:
                days = [r[0] for r in df.select(day).distinct().collect()]
                there = there.where(F.col(day).isin([x for x in days if x is not None]) | (F.lit(None in days) & F.col(day).isNull()))
            f, t = fresh.alias("f"), there.select(F.col(key).alias("_key")).alias("t")
            fresh = f.join(t, F.col(f"f.{key}").eqNullSafe(F.col("t._key")), "left_anti")
        fresh = fresh.persist()
        try:
            writer = fresh.write.mode("append")
            (writer.partitionBy(day) if day else writer).parquet(path)
            if then:
                deliver(fresh, then)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
