"""Incidents and the events around them, per entity.

All window work runs on a timeline with one row per (entity, day[, tag]) and counts for weights. A
busy entity therefore holds at most one row per calendar day and tag, however many events it has.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(
    df: DataFrame,
    key: str,
    day: Column,
    streams: dict[str, Column],
    tags: Iterable[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Counts per (entity, day, tags) for every stream, from one pass over one table.

    `streams` maps an output name to the predicate that says which rows belong to it; `weight` is the
    number of events a row stands for.
    """
    n = F.lit(1) if weight is None else weight
    wanted = functools.reduce(lambda a, b: a | b, streams.values())
    return (
        df.where(wanted & F.col(key).isNotNull() & day.isNotNull())
        .groupBy(F.col(key).alias("key"), day.alias("day"), *tags)
        .agg(*[F.sum(F.when(cond, n).otherwise(0)).alias(name) for name, cond in streams.items()])
    )


def merge_timelines(parts: dict[str, DataFrame], tags: Iterable[str] = ()) -> DataFrame:
    """Timeline of several tables that have columns key, day and tags."""
    stacked = None
    for name in parts:
        cols = [F.lit(1 if other == name else 0).alias(other) for other in parts]
        part = parts[name].select("key", "day", *tags, *cols)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("key", "day", *tags).agg(*[F.sum(n).alias(n) for n in parts])


def around(before: int, after: int) -> W:
    """Days from `before` days back to `after` days ahead of a row, both ends included."""
    return W.partitionBy("key").orderBy("day").rangeBetween(-before, after)


def count_back(stream: str, days: int) -> Column:
    """Events of a stream in [day - days, day]."""
    return F.coalesce(F.sum(stream).over(around(days, 0)), F.lit(0))


def count_ahead(stream: str, days: int) -> Column:
    """Rows of a stream in [day, day + days]."""
    return F.coalesce(F.sum(stream).over(around(0, days)), F.lit(0))


def first_ahead(stream: str, days: int) -> Column:
    """Day of the first row of a stream at or after this day, within a limit."""
    return F.min(F.when(F.col(stream) > 0, F.col("day"))).over(around(0, days))


def associate(tl: DataFrame, incident: str, event: str, windows: list[int]) -> DataFrame:
    """Incident days with the event count of every look-back; all frames share one shuffle."""
    out = tl.withColumns({f"n_{w}": count_back(event, w) for w in windows})
    return out.where(F.col(incident) > 0)


def multiplicity(tl: DataFrame, incident: str, event: str, windows: list[int]) -> DataFrame:
    """Event days with the number of incidents each event is associated with."""
    out = tl.withColumns({f"m_{w}": count_ahead(incident, w) for w in windows})
    return out.where(F.col(event) > 0)


def multiplicity_rates(tl: DataFrame, incident: str, event: str, windows: list[int]) -> DataFrame:
    """Per look-back: events matched once or more, twice or more, their share, pairs from both sides."""
    both = tl.withColumns(
        {f"n_{w}": count_back(event, w) for w in windows}
        | {f"m_{w}": count_ahead(incident, w) for w in windows}
    )
    long = both.select(
        incident,
        event,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(w).alias("days"), F.col(f"n_{w}").alias("n"), F.col(f"m_{w}").alias("m")
                    )
                    for w in windows
                ]
            )
        ).alias("x"),
    ).select(incident, event, "x.*")
    matched = F.sum(F.when(F.col("m") >= 1, F.col(event)).otherwise(0))
    twice = F.sum(F.when(F.col("m") >= 2, F.col(event)).otherwise(0))
    return long.groupBy("days").agg(
        matched.alias("matched_events"),
        twice.alias("matched_twice"),
        (100.0 * twice / F.greatest(matched, F.lit(1))).alias("multiplicity_pct"),
        F.sum(F.col(incident) * F.col("n")).alias("pairs_incident_side"),
        F.sum(F.col(event) * F.col("m")).alias("pairs_event_side"),
    )


def lag_weights(
    incident_days: DataFrame, event_days: DataFrame, days: int, carry: Iterable[str] = ()
) -> DataFrame:
    """Number of (incident, event) pairs per lag, without listing the pairs.

    Inputs have one row per (key, day[, carry]) and a weight `n`. Days fall into blocks of days + 1;
    an event block is offered to its own and the next incident block, so the join is an equality on
    (key, block). Inside a block a key has at most days + 1 day rows, which bounds the fan-out.
    """
    block = lambda c: F.floor(c / F.lit(days + 1))
    inc = incident_days.select(
        "key", F.col("day").alias("i_day"), F.col("n").alias("i_n"), block(F.col("day")).alias("b"), *carry
    )
    evt = event_days.select(
        "key",
        F.col("day").alias("e_day"),
        F.col("n").alias("e_n"),
        F.explode(F.array(block(F.col("day")), block(F.col("day")) + 1)).alias("b"),
    )
    lag = F.col("i_day") - F.col("e_day")
    return (
        inc.join(evt, ["key", "b"])
        .where(lag.between(0, days))
        .groupBy(lag.alias("lag"), *carry)
        .agg(F.sum(F.col("i_n") * F.col("e_n")).alias("pairs"))
    )


def coverage_span(df: DataFrame, day: Column, streams: dict[str, Column]) -> DataFrame:
    """First and last observed day per stream; one row."""
    wanted = functools.reduce(lambda a, b: a | b, streams.values())
    return df.where(wanted).agg(
        *[F.min(F.when(cond, day)).alias(f"{name}_lo") for name, cond in streams.items()],
        *[F.max(F.when(cond, day)).alias(f"{name}_hi") for name, cond in streams.items()],
    )


def edges(span: DataFrame, look_back: dict[str, int], day: Column | str = "day") -> tuple[Column, Column]:
    """Whether [day - W, day] leaves the observed span of any stream on the left or on the right.

    The span enters as scalar subqueries, so nothing is joined.
    """
    d = F.col(day) if isinstance(day, str) else day
    left, right = F.lit(False), F.lit(False)
    for name, days in look_back.items():
        left = left | (d - days < span.select(f"{name}_lo").scalar())
        right = right | (d > span.select(f"{name}_hi").scalar())
    return left, right
