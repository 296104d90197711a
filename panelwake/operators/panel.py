"""Entity-by-season features that only use what happened before the season's cutoff.

Periods may be missing for an entity, so period windows are RANGE frames on the period number.
Every table entering a window has at most one row per (entity, period).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.functions import calendar, numeric
from panelwake.operators.order import lookup_skewed
from panelwake.session import durable


@dataclass(frozen=True)
class PanelSpec:
    """Floors below which history was not observed, and the event classes counted apart."""

    first_season: int
    context_first_year: int
    complaint_first_year: int
    complaint_floor: dt.date
    classes: tuple[str, ...] = field(default=("A", "B", "C", "I"))


def before(entity: str, period: str) -> W:
    """All earlier periods."""
    return W.partitionBy(entity).orderBy(period).rangeBetween(W.unboundedPreceding, -1)


def exactly(entity: str, period: str, back: int) -> W:
    """The one period `back` periods ago, if the entity has it."""
    return W.partitionBy(entity).orderBy(period).rangeBetween(-back, -back)


def span(entity: str, period: str, first_back: int, last_back: int) -> W:
    return W.partitionBy(entity).orderBy(period).rangeBetween(-first_back, -last_back)


def masked(available: Column, value: Column) -> Column:
    """Zero where history is covered and empty, NULL where it is not covered."""
    return F.when(available, F.coalesce(value, F.lit(0)))


def history(spine: DataFrame, facts: list[DataFrame], entity: str, period: str) -> DataFrame:
    """Spine rows and per-period facts on one axis, one row per (entity, period).

    A fact table has the entity, the period it happened in and any number of count columns. Facts of
    periods the spine lacks stay, marked by in_spine = 0, because later periods count them.
    """
    labels = [c for c in spine.columns if c not in (entity, period)]
    names = [c for f in facts for c in f.columns if c not in (entity, period)]
    stacked = spine.withColumn("in_spine", F.lit(1))
    for fact in facts:
        stacked = stacked.unionByName(fact, allowMissingColumns=True)
    return stacked.groupBy(entity, period).agg(
        F.coalesce(F.max("in_spine"), F.lit(0)).alias("in_spine"),
        *[F.max(c).alias(c) for c in labels],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )


def label_history(entity: str, period: str, label: str, first_season: int) -> dict[str, Column]:
    """Lags, horizon, recency and chronicity of a 0/1 label."""
    earlier = before(entity, period)
    return {
        **{
            f"viol_lag{k}": F.coalesce(F.max(label).over(exactly(entity, period, k)), F.lit(0))
            for k in (1, 2, 3)
        },
        "hist_horizon": F.col(period) - first_season,
        "viol_recency": F.col(period)
        - F.max(F.when(F.col(label) == 1, F.col(period))).over(earlier),
        "viol_chronicity": numeric.ratio(
            F.sum(label).over(earlier), F.count(label).over(earlier)
        ),
    }


def prior_and_total(entity: str, period: str, fact: str, name: str, available: Column | None = None):
    """Count in the previous period and in all earlier ones."""
    ok = F.lit(True) if available is None else available
    return {
        f"{name}_prior1": masked(ok, F.sum(fact).over(exactly(entity, period, 1))),
        f"{name}_cum": masked(ok, F.sum(fact).over(before(entity, period))),
    }


def trailing_sum(entity: str, period: str, fact: str, periods: int) -> Column:
    return F.coalesce(F.sum(fact).over(span(entity, period, periods, 1)), F.lit(0))


def own_sums(entity: str, period: str, label: str) -> dict[str, Column]:
    """Rows and positives of the entity itself in earlier periods."""
    earlier = before(entity, period)
    return {
        "_own_n": F.coalesce(F.count(label).over(earlier), F.lit(0)),
        "_own_p": F.coalesce(F.sum(label).over(earlier), F.lit(0)),
    }


def owner_history(
    spine: DataFrame, owners: DataFrame, entity: str, period: str, label: str, owner: str
) -> DataFrame:
    """Per (owner, period): portfolio size, panel rows now, rows and positives of earlier periods."""
    known = owners.where(F.col(owner).isNotNull()).select(entity, owner)
    per_period = (
        spine.select(entity, period, label)
        .join(known, entity)
        .groupBy(owner, period)
        .agg(F.count("*").alias("_owner_n"), F.sum(label).alias("p"))
    )
    running = before(owner, period)
    sizes = known.groupBy(owner).agg(F.count("*").alias("portfolio_size"))
    return per_period.select(
        owner,
        period,
        "_owner_n",
        F.coalesce(F.sum("_owner_n").over(running), F.lit(0)).alias("_all_n"),
        F.coalesce(F.sum("p").over(running), F.lit(0)).alias("_all_p"),
    ).join(sizes, owner)


def with_owner(
    rows: DataFrame, owners: DataFrame, history: DataFrame, entity: str, period: str, owner: str
) -> DataFrame:
    """Attach owner and owner history; owners holding a large share of the panel are spread.

    The history has one row per (owner, period) and is kept, as three places read it.
    """
    history = durable(history)
    total = history.agg(F.coalesce(F.sum("_owner_n"), F.lit(0))).first()[0]
    linked = rows.join(owners.select(entity, owner), entity, "left")
    return lookup_skewed(linked, history, [owner, period], F.col("_owner_n"), total, F.col(entity))


def loo_rate() -> Column:
    """The owner's earlier positive rate over its other entities; NULL without any."""
    others = F.col("_all_n") - F.col("_own_n")
    return numeric.ratio(F.col("_all_p") - F.col("_own_p"), others)


def owner_rates(
    spine: DataFrame, owners: DataFrame, entity: str, period: str, label: str, owner: str
) -> DataFrame:
    """Portfolio size and leave-one-out rate on the spine."""
    rows = spine.select(entity, period, label).withColumns(own_sums(entity, period, label))
    past = owner_history(spine, owners, entity, period, label, owner)
    out = with_owner(rows, owners, past, entity, period, owner)
    return out.select(entity, period, owner, "portfolio_size", loo_rate().alias("portfolio_loo_rate"))


@dataclass(frozen=True)
class Cutoffs:
    """How an event day maps to the periods whose trailing windows may contain it."""

    first_target: Callable[[Column], Column]  # first period whose cutoff is after the day
    reach: int  # number of consecutive targets that can contain the day
    cutoff: Callable[[Column], Column]  # cutoff date of a period


SEASONS = Cutoffs(calendar.next_cutoff_season, 2, calendar.cutoff)


def to_targets(days: DataFrame, cutoffs: Cutoffs, longest: int, period: str = "season") -> DataFrame:
    """Each event-day row once per target period whose last `longest` days contain it."""
    first = cutoffs.first_target(F.col("day"))
    out = days.withColumn(period, F.explode(F.sequence(first, first + (cutoffs.reach - 1))))
    cut = cutoffs.cutoff(F.col(period))
    return out.withColumn("_cut", cut).where(
        (F.col("day") < F.col("_cut")) & (F.col("day") >= F.date_sub(F.col("_cut"), longest))
    )


def day_grain(events: DataFrame, entity: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Events per (entity, day) with first and last time, and the gaps inside days.

    Equal times are merged first, so a day of one entity holds at most one row per clock tick.
    """
    ticks = (
        events.select(entity, calendar.epoch_micros(ts).alias("_t"), F.to_date(ts).alias("day"))
        .where(F.col(entity).isNotNull() & F.col("_t").isNotNull())
        .groupBy(entity, "day", "_t")
        .agg(F.count("*").alias("_c"))
    )
    previous = F.lag("_t").over(W.partitionBy(entity, "day").orderBy("_t"))
    ticks = ticks.withColumn("_gap", F.col("_t") - previous)
    days = ticks.groupBy(entity, "day").agg(
        F.sum("_c").alias("events"), F.min("_t").alias("first_t"), F.max("_t").alias("last_t")
    )
    gaps = ticks.select(
        entity,
        "day",
        F.explode(
            F.array(
                F.struct(F.col("_gap").alias("gap"), F.lit(1).cast("long").alias("n")),
                F.struct(F.lit(0).cast("long").alias("gap"), (F.col("_c") - 1).alias("n")),
            )
        ).alias("x"),
    ).select(entity, "day", "x.*").where(F.col("gap").isNotNull() & (F.col("n") > 0))
    return days, gaps


def gap_features(
    events: DataFrame,
    entity: str,
    ts: str,
    cutoffs: Cutoffs,
    days: int,
    period: str = "season",
    more: dict[str, Column] | None = None,
) -> DataFrame:
    """Median and smallest gap between events inside the window, days since the last event, events.

    `more` adds aggregates over the window's day rows (columns day, events, _cut).

    Gaps in one window add up to at most its length, which bounds how many different gap values a
    busy entity can have, and with it the histogram behind the median.
    """
    per_day, in_day = day_grain(events, entity, ts)
    # neighbouring days are found once per entity, before its days go to their targets
    by_day = W.partitionBy(entity).orderBy("day")
    linked = per_day.withColumns({"_before": F.lag("last_t").over(by_day), "_before_day": F.lag("day").over(by_day)})
    targets = to_targets(linked, cutoffs, days, period)
    covered = F.col("_before_day") >= F.date_sub(F.col("_cut"), days)
    across = targets.where(covered).select(
        entity, period, (F.col("first_t") - F.col("_before")).alias("gap"), F.lit(1).cast("long").alias("n")
    )
    inside = to_targets(in_day, cutoffs, days, period).select(entity, period, "gap", "n")
    gaps = (
        across.unionByName(inside)
        .groupBy(entity, period)
        .agg(
            (F.percentile("gap", F.lit(0.5), F.col("n")) / 86400000000.0).alias("gap_median"),
            (F.min("gap") / 86400000000.0).alias("gap_min"),
        )
    )
    extra = more or {}
    last = targets.groupBy(entity, period).agg(
        F.sum("events").alias("events"),
        F.max("last_t").alias("_last"),
        *[c.alias(n) for n, c in extra.items()],
    )
    since = calendar.elapsed_days(F.col("_last"), calendar.epoch_micros(cutoffs.cutoff(F.col(period))))
    return last.select(entity, period, "events", since.alias("days_since_last"), *extra).join(
        gaps, [entity, period], "left"
    )


def window_sums() -> dict[str, Column]:
    """Events and event days of the previous season, events of the last 365 and 730 days."""
    prior = _in_prior_season()
    recent = F.col("day") >= F.date_sub(F.col("_cut"), 365)
    return {
        "evt_ps": F.sum(F.when(prior, F.col("events")).otherwise(0)),
        "days_ps": F.count_if(prior),
        "evt_t365": F.sum(F.when(recent, F.col("events")).otherwise(0)),
        "evt_t730": F.sum("events"),
    }


def complaint_windows(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """The window sums per (entity, target season), without gaps."""
    per_day = (
        events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .groupBy(entity, F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("events"))
    )
    rows = to_targets(per_day, SEASONS, 730)
    return rows.groupBy(entity, "season").agg(*[c.alias(n) for n, c in window_sums().items()])


def _in_prior_season() -> Column:
    s = F.col("season") - 1
    return (F.col("day") >= calendar.cutoff(s)) & (F.col("day") < calendar.season_end(s))


def problem_windows(
    events: DataFrame, entity: str, ts: str, sub_key: str, is_sub: Column, unflagged: Column
) -> DataFrame:
    """Per (entity, target season): distinct sub-units, events with and without the repeat flag."""
    per_day = (
        events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
        .groupBy(
            entity,
            F.to_date(ts).alias("day"),
            F.when(is_sub, F.col(sub_key)).alias("_sub"),
        )
        .agg(F.count("*").alias("events"), F.count_if(unflagged).alias("events_n"))
    )
    rows = to_targets(per_day, SEASONS, 730)
    prior = _in_prior_season()
    per_sub = rows.groupBy(entity, "season", "_sub").agg(
        F.sum(F.when(prior, F.col("events")).otherwise(0)).alias("all_ps"),
        F.sum(F.when(prior, F.col("events_n")).otherwise(0)).alias("n_ps"),
        F.max(F.when(prior, 1).otherwise(0)).alias("seen_ps"),
    )
    named = F.col("_sub").isNotNull()
    return per_sub.groupBy(entity, "season").agg(
        F.count_if(named & (F.col("seen_ps") == 1)).alias("apts_ps"),
        F.sum("all_ps").alias("evt_all_ps"),
        F.sum("n_ps").alias("evt_n_ps"),
        F.count_if(named).alias("apts_t730"),
    )


def availability(season: Column, floor: dt.date) -> dict[str, Column]:
    """Whether a window's left edge is on or after the first observed day."""
    cut = calendar.cutoff(season)
    lit = F.lit(floor)
    return {
        "ps": (calendar.cutoff(season - 1) >= lit),
        "t365": (F.date_sub(cut, 365) >= lit),
        "t730": (F.date_sub(cut, 730) >= lit),
    }


def complaint_columns(floor: dt.date) -> dict[str, Column]:
    """Masked complaint features of a frame joined to complaint_windows."""
    av = availability(F.col("season"), floor)
    days = F.col("days_ps")
    return {
        **{f"c6_available_{k}": av[k].cast("int") for k in ("ps", "t365", "t730")},
        "c6_evt_ps": masked(av["ps"], F.col("evt_ps")).cast("double"),
        "c6_days_ps": masked(av["ps"], days).cast("double"),
        "c6_dup_intensity_ps": F.when(av["ps"], numeric.ratio(F.col("evt_ps"), days)),
        "c6_evt_t365": masked(av["t365"], F.col("evt_t365")).cast("double"),
        "c6_evt_t730": masked(av["t730"], F.col("evt_t730")).cast("double"),
    }


def gap_columns(floor: dt.date) -> dict[str, Column]:
    """Masked gap features of a frame joined to gap_features."""
    av = availability(F.col("season"), floor)["t730"]
    return {
        "c6_gap_median_t730": F.when(av, F.col("gap_median")),
        "c6_gap_min_t730": F.when(av, F.col("gap_min")),
        "c6_days_since_last_t730": F.when(av, F.col("days_since_last")),
    }


def problem_columns(floor: dt.date, units: str) -> dict[str, Column]:
    """Masked problem features of a frame joined to problem_windows and the unit count."""
    av = availability(F.col("season"), floor)
    apts = F.coalesce("apts_ps", F.lit(0))
    flagged = 1.0 - numeric.ratio(F.col("evt_n_ps"), F.col("evt_all_ps"))
    return {
        "c7_available_ps": av["ps"].cast("int"),
        "c7_available_t730": av["t730"].cast("int"),
        "c7_apts_ps": masked(av["ps"], F.col("apts_ps")).cast("double"),
        "c7_apt_share_ps": F.when(av["ps"], numeric.ratio(apts, F.col(units))),
        "c7_evt_all_ps": masked(av["ps"], F.col("evt_all_ps")).cast("double"),
        "c7_evt_dedupN_ps": masked(av["ps"], F.col("evt_n_ps")).cast("double"),
        "c7_dupflag_share_ps": F.when(av["ps"], flagged),
        "c7_apts_t730": masked(av["t730"], F.col("apts_t730")).cast("double"),
    }


def on_spine(spine: DataFrame, windows: DataFrame, entity: str, columns: dict[str, Column]) -> DataFrame:
    """One window family on the spine: 0 where covered and empty, NULL where not covered."""
    out = spine.join(windows, [entity, "season"], "left")
    return out.select(entity, "season", *[c.alias(n) for n, c in columns.items()])


def history_features(
    spine: DataFrame, incidents: DataFrame, yearly: DataFrame, entity: str, spec: PanelSpec
) -> DataFrame:
    """Label, count, context and yearly complaint history: one shuffle, one sort, many frames.

    `incidents`: entity, season, inc. `yearly`: entity, season, cmp and one ctx_<class> per class,
    where `season` holds the calendar year, so 'season - 1' means the last full year before the cutoff
    year.
    """
    p = "season"
    rows = history(spine.select(entity, p, "label_c", "label_bc"), [incidents, yearly], entity, p)
    after_first = F.col(p) > spec.first_season
    has_year = F.col(p) - 1 >= spec.complaint_first_year
    cols = label_history(entity, p, "label_c", spec.first_season)
    inc = prior_and_total(entity, p, "inc", "x", after_first)
    cols |= {"viol_cnt_prior1": inc["x_prior1"], "viol_cnt_prior_cum": inc["x_cum"]}
    names = [c.lower() for c in spec.classes]
    rows = rows.withColumn("ctx_total", sum((F.col(f"ctx_{c}") for c in names), F.lit(0)))
    for c in [*names, "total"]:
        cols |= prior_and_total(entity, p, f"ctx_{c}", f"ctx_{c}")
    cmp = prior_and_total(entity, p, "cmp", "x", has_year)
    cols |= {
        "c311_available": has_year.cast("int"),
        "c311_prior1": cmp["x_prior1"],
        "c311_prior_cum": cmp["x_cum"],
    }
    own = own_sums(entity, p, "label_c")
    keep = [entity, p, *cols, *own, "label_c", "label_bc"]
    return rows.withColumns(cols | own).where(F.col("in_spine") == 1).select(*keep)


FEATURE_TYPES = {"c311_available": "int", "prewar": "int", "bldgclass_1": "string", "borough": "string"}


def feature_frame(
    spine: DataFrame,
    incidents: DataFrame,
    yearly: DataFrame,
    complaint_events: DataFrame,
    problem_events: DataFrame,
    lots: DataFrame,
    owners: DataFrame,
    entity: str,
    spec: PanelSpec,
) -> DataFrame:
    """All feature families on the spine.

    `lots`: entity, yearbuilt, unitsres, unitstotal, numfloors, bldgclass_1, borough.
    `owners`: entity, owner_key. Event tables: entity, ts; problem events also sub_key, is_sub, flag.
    Every family has one row per (entity, season) and joins on it; the masks are applied at the end.
    """
    keys = [entity, "season"]
    c6 = gap_features(complaint_events, entity, "ts", SEASONS, 730, more=window_sums()).drop("events")
    c7 = problem_windows(problem_events, entity, "ts", "sub_key", F.col("is_sub"), F.col("flag") == "N")
    rows = history_features(spine, incidents, yearly, entity, spec)
    # what is looked up by entity comes first, while rows still lie by entity from their windows
    past = owner_history(spine, owners, entity, "season", "label_c", "owner_key")
    rows = with_owner(rows.join(lots, entity, "left"), owners, past, entity, "season", "owner_key")
    rows = rows.join(c6, keys, "left").join(c7, keys, "left")
    year = F.col("yearbuilt")
    tail = complaint_columns(spec.complaint_floor) | gap_columns(spec.complaint_floor)
    tail |= problem_columns(spec.complaint_floor, "unitstotal")
    derived = {
        "building_age": F.col("season") - numeric.positive(year),
        "prewar": F.coalesce(numeric.prewar(year), F.lit(0)),
        "portfolio_loo_rate": loo_rate(),
    }
    names = fixed_features(spec.classes) + list(tail)
    known = derived | tail
    typed = lambda c: FEATURE_TYPES.get(c, "int" if "available" in c else "double")
    return rows.select(
        *keys,
        *[known.get(c, F.col(c)).cast(typed(c)).alias(c) for c in names],
        "label_c",
        "label_bc",
    )


def fixed_features(classes) -> list[str]:
    """The fixed feature order; c6_* and c7_* columns follow it."""
    context = [f"ctx_{c.lower()}_{w}" for c in [*classes, "total"] for w in ("prior1", "cum")]
    return [
        "viol_lag1", "viol_lag2", "viol_lag3", "hist_horizon", "viol_recency",
        "viol_chronicity", "viol_cnt_prior1", "viol_cnt_prior_cum",
        *context,
        "c311_available", "c311_prior1", "c311_prior_cum",
        "building_age", "prewar", "unitsres", "unitstotal", "numfloors",
        "bldgclass_1", "borough", "portfolio_size", "portfolio_loo_rate",
    ]
