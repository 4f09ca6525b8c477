"""Checks of operator-made documents: shapes, zones, cameras, rules and users. Each gives an array of messages, empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import geometry

KINDS = ("polygon", "tripwire", "exclusion", "fire_roi")
SEVERITIES = ("low", "medium", "high", "critical")
EVENTS = ("entry", "exit")
DIRECTIONS = ("a_to_b", "b_to_a", "both")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
CLASSES = ("person", "fire", "smoke")
ITEMS = ("helmet", "vest", "gloves", "shoes", "glasses")
ALERTS = ("boundary", "crowd", "ppe", "access", "fire", "smoke", "phone", "welding")
SINKS = ("smtp",)
#: Longest cooldown, in seconds.
LONGEST = 7 * 24 * 3600
ROLES = ("admin", "operator", "viewer")
EMAIL = r"^[^@\s,;<>]+@[^@\s,;<>]+\.[^@\s,;<>]+$"
TIME = r"^([01]?[0-9]|2[0-3]):[0-5]?[0-9](:[0-5]?[0-9])?$"
#: Modules that work on tracked persons in zones, and the module that does the tracking.
NEED_BOUNDARY, BOUNDARY = ("crowd", "ppe", "phone", "identity"), "boundary"
#: A shape over this share of the frame is suspicious.
LARGE = 0.8


def messages(*checks: tuple[Column, str]) -> Column:
    """The texts of those conditions that hold, in order; null conditions don't."""
    return F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def name(value: Column) -> Column:
    """A word of a document as it is compared: in lower case, without white space at its ends."""
    return F.lower(F.trim(value))


def unknown(values: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a list, which may be null, names something else."""
    return F.size(F.array_except(F.transform(F.coalesce(values, F.array().cast("array<string>")), name), F.array(*map(F.lit, allowed)))) > 0


def empty(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) < 1


def schedule_errors(days: Column, start: Column, stop: Column) -> Column:
    """Messages of a schedule: days by their first three letters, times as HH:MM or HH:MM:SS, both or neither and not the same."""
    short = F.transform(F.coalesce(days, F.array().cast("array<string>")), lambda d: F.substring(name(d), 1, 3))
    bad = lambda t: t.isNotNull() & ~F.trim(t).rlike(TIME)
    clock = lambda t: F.aggregate(F.split(F.trim(t), ":"), F.lit(0), lambda s, p: s * 60 + F.try_to_number(p, F.lit("99")).cast("int")) * F.when(F.size(F.split(t, ":")) == 2, 60).otherwise(1)
    one = start.isNull() != stop.isNull()
    return messages(
        (F.size(F.array_except(short, F.array(*map(F.lit, DAYS)))) > 0, "unknown day"),
        (one, "one of two times"),
        (bad(start) | bad(stop), "bad time"),
        (~one & ~bad(start) & ~bad(stop) & (clock(start) == clock(stop)), "times are the same"),
    )


def zone_errors(zone: str) -> Column:
    """Messages of a zone document (a struct column: id, type, points, severity, direction, events, detect, min_frames, applies_to, days, from, to, crowd_threshold, crowd_min_frames, ppe_required): its fields, then its schedule, then its shape.

    Fields that are null have their defaults: a polygon of medium severity for persons, both directions and events.
    """
    f = lambda c: F.col(f"{zone}.{c}")
    kind = F.coalesce(name(f("type")), F.lit("polygon"))
    given = lambda c, allowed: f(c).isNotNull() & ~one_of(name(f(c)), allowed)
    own = messages(
        (F.coalesce(F.trim(f("id")), F.lit("")) == "", "no id"),
        (~one_of(kind, KINDS), "unknown type"),
        (given("severity", SEVERITIES), "unknown severity"),
        (given("direction", DIRECTIONS), "unknown direction"),
        (unknown(f("events"), EVENTS), "unknown event"),
        (unknown(f("detect"), CLASSES), "unknown class to detect"),
        (f("min_frames") < 1, "min_frames below 1"),
        (unknown(f("applies_to"), CLASSES), "unknown class to apply to"),
        (kind.isin("exclusion", "fire_roi") & empty(f("applies_to")), "applies to nothing"),
        (f("crowd_threshold") < 1, "crowd_threshold below 1"),
        (f("crowd_min_frames") < 1, "crowd_min_frames below 1"),
        (unknown(f("ppe_required"), ITEMS), "unknown item"),
    )
    shape = F.when(kind == "tripwire", geometry.problems(f("points"), "tripwire")).otherwise(geometry.problems(f("points")))
    return F.concat(own, schedule_errors(f("days"), f("from"), f("to")), shape)


def area_warning(points: Column) -> Column:
    """Whether a shape takes up most of the frame."""
    return geometry.shoelace(points) > LARGE


def camera_errors(camera: Column, source: Column, fps: Column, modules: Column, known: tuple[str, ...]) -> Column:
    return messages(
        (~F.coalesce(camera.rlike(r"^[a-z0-9_-]{1,32}$"), F.lit(False)), "bad id"),
        (F.coalesce(F.trim(source), F.lit("")) == "", "no source"),
        (~F.coalesce(fps > 0, F.lit(False)), "fps not above 0"),
        (F.size(F.array_except(modules, F.array(*map(F.lit, known)))) > 0, "unknown module"),
    )


def rule_errors(rule: str) -> Column:
    """Messages of an alert rule (a struct column: type, min_severity, cooldown_seconds (text), to, kinds)."""
    f = lambda c: F.col(f"{rule}.{c}")
    to = F.filter(F.transform(F.coalesce(f("to"), F.array().cast("array<string>")), F.trim), lambda t: t != "")
    wait = F.when(F.coalesce(F.trim(f("cooldown_seconds")), F.lit("")) == "", 0.0).otherwise(f("cooldown_seconds").try_cast("double"))
    kinds = F.filter(F.coalesce(f("kinds"), F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    return messages(
        (~one_of(name(F.coalesce(f("type"), F.lit(""))), SINKS), "unknown type"),
        (f("min_severity").isNotNull() & ~one_of(name(f("min_severity")), SEVERITIES), "unknown severity"),
        (wait.isNull(), "cooldown is no number"),
        (~wait.between(0, LONGEST), "cooldown out of range"),
        (F.size(to) < 1, "no recipient"),
        (F.exists(to, lambda t: ~t.rlike(EMAIL)), "bad recipient"),
        (unknown(kinds, ALERTS), "unknown kind"),
    )


def user_errors(name: Column, role: Column, password: Column) -> Column:
    return messages((~F.coalesce(name.rlike(r"^[A-Za-z0-9_.#-]{3,64}$"), F.lit(False)), "bad name"), (~one_of(role, ROLES), "unknown role"), (F.coalesce(F.char_length(password), F.lit(0)) < 8, "short password"))


def with_implied(modules: Column) -> Column:
    """Modules and what they need, sorted."""
    more = F.array_union(modules, F.array(F.lit(BOUNDARY)))
    return F.sort_array(F.when(F.arrays_overlap(modules, F.array(*map(F.lit, NEED_BOUNDARY))), more).otherwise(modules))


def checked(documents: DataFrame, key: str, errors: Column) -> DataFrame:
    """documents with errors; a key that occurs twice is an error of each of its rows."""
    x = documents.withColumn("errors", errors)
    twice = documents.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    y = x.join(twice, F.col(key).eqNullSafe(F.col("_key"))).withColumn("errors", F.concat("errors", messages((F.col("_n") > 1, "duplicate id"))))
    return y.drop("_key", "_n")


def last_good(versions: DataFrame, store: str, version: str) -> DataFrame:
    """Of each store the rows of its newest version in which no row has errors: a bad load changes nothing."""
    bad = versions.groupBy(store, version).agg(F.max(F.size("errors")).alias("_bad")).where("_bad = 0")
    newest = bad.groupBy(store).agg(F.max(version).alias(version))
    return versions.join(newest, [store, version], "left_semi").drop("errors")
