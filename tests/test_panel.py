from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwake.operators import panel
from panelwake.plans import panel_queries, standins
from panelwake.sources import contracts

D = dt.datetime


def spine_of(spark, rows):
    return spark.createDataFrame(rows, "key int, season int, label_c int, label_bc int")


def test_label_history_counts_missing_season_as_no_label(spark):
    rows = [(1, 2015, 1, 1), (1, 2016, 1, 1), (1, 2018, 0, 0), (1, 2019, 1, 1), (2, 2018, 0, 0)]
    cols = panel.label_history("key", "season", "label_c", 2015)
    out = spine_of(spark, rows).select("key", "season", *[c.alias(n) for n, c in cols.items()])
    r = {(x["key"], x["season"]): x for x in out.collect()}
    assert r[1, 2018]["viol_lag1"] == 0 and r[1, 2018]["viol_lag2"] == 1 and r[1, 2018]["viol_lag3"] == 1
    assert r[1, 2018]["viol_recency"] == 2 and r[1, 2018]["viol_chronicity"] == 1.0
    assert r[1, 2019]["viol_chronicity"] == pytest.approx(2 / 3)
    assert r[2, 2018]["viol_recency"] is None and r[2, 2018]["viol_chronicity"] is None
    assert r[1, 2015]["hist_horizon"] == 0


def test_facts_in_seasons_without_panel_row_still_count(spark):
    spine = spine_of(spark, [(1, 2016, 0, 0), (1, 2018, 0, 0)])
    facts = spark.createDataFrame([(1, 2017, 3), (1, 2018, 5)], "key int, season int, inc long")
    rows = panel.history(spine, [facts], "key", "season")
    cols = panel.prior_and_total("key", "season", "inc", "x")
    out = {r["season"]: r for r in rows.withColumns(cols).where("in_spine = 1").collect()}
    assert set(out) == {2016, 2018}
    assert (out[2018]["x_prior1"], out[2018]["x_cum"]) == (3, 3)
    assert (out[2016]["x_prior1"], out[2016]["x_cum"]) == (0, 0)


def test_leave_one_out_rate_needs_another_entity(spark):
    spine = spine_of(spark, [(k, s, y, y) for k, s, y in [(1, 2016, 1), (2, 2016, 0), (1, 2017, 0), (2, 2017, 0), (3, 2016, 1), (3, 2017, 1)]])
    owners = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "key int, owner_key string")
    out = panel.owner_rates(spine, owners, "key", "season", "label_c", "owner_key")
    r = {(x["key"], x["season"]): x for x in out.collect()}
    assert r[1, 2017]["portfolio_loo_rate"] == 0.0 and r[2, 2017]["portfolio_loo_rate"] == 1.0
    assert r[3, 2017]["portfolio_loo_rate"] is None and r[1, 2016]["portfolio_loo_rate"] is None
    assert r[1, 2016]["portfolio_size"] == 2


def windows(spark, times):
    ev = spark.createDataFrame([(1, t) for t in times], "key int, ts timestamp_ntz")
    return {r["season"]: r for r in panel.complaint_windows(ev, "key", "ts").collect()}


def test_trailing_windows_are_days_not_years(spark):
    # the span before 1 October 2020 holds 29 February, so 365 days reach back to 2 October 2019 only
    got = windows(spark, [D(2019, 10, 1), D(2019, 10, 2)])
    assert got[2020]["evt_t365"] == 1 and got[2020]["evt_t730"] == 2 and got[2020]["evt_ps"] == 2
    assert 2021 not in got or got[2021]["evt_t730"] == 1


def test_windows_hold_nothing_from_the_cutoff_on(spark):
    got = windows(spark, [D(2020, 9, 30, 23, 59), D(2020, 10, 1)])
    assert got[2020]["evt_t730"] == 1
    assert got[2021]["evt_ps"] == 1 and got[2021]["evt_t365"] == 1


def test_masks_tell_uncovered_from_empty(spark):
    spine = spark.createDataFrame([(1, s) for s in (2019, 2020, 2021)], "key int, season int")
    ev = spark.createDataFrame([(2, D(2020, 1, 1))], "key int, ts timestamp_ntz")
    cols = panel.complaint_columns(dt.date(2019, 6, 1))
    rows = panel.on_spine(spine, panel.complaint_windows(ev, "key", "ts"), "key", cols)
    r = {x["season"]: x for x in rows.collect()}
    assert r[2019]["c6_evt_ps"] is None and r[2019]["c6_available_ps"] == 0
    assert r[2020]["c6_evt_ps"] == 0.0 and r[2020]["c6_evt_t730"] is None
    assert r[2020]["c6_dup_intensity_ps"] is None
    assert r[2021]["c6_evt_t730"] == 0.0


@pytest.mark.parametrize("floor, covered", [(dt.date(2019, 9, 30), 1), (dt.date(2019, 10, 1), 1), (dt.date(2019, 10, 2), 0)])
def test_mask_edge(spark, floor, covered):
    df = spark.createDataFrame([(2020,)], "season int")
    assert int(df.select(panel.availability(F.col("season"), floor)["ps"]).first()[0]) == covered


def test_gaps(spark):
    rows = [(1, D(2020, 9, 1)), (2, D(2020, 9, 1)), (2, D(2020, 9, 3, 12)), (3, D(2018, 9, 1)), (3, D(2020, 9, 30))]
    rows += [(4, D(2020, 9, 1, 10)), (4, D(2020, 9, 1, 10)), (4, D(2020, 9, 1, 16)), (4, D(2020, 9, 2, 16))]
    ev = spark.createDataFrame(rows, "key int, ts timestamp_ntz")
    out = panel.gap_features(ev, "key", "ts", panel.SEASONS, 730).where("season = 2020")
    r = {x["key"]: x for x in out.collect()}
    assert r[1]["gap_median"] is None and r[1]["gap_min"] is None and r[1]["days_since_last"] == 30.0
    assert r[2]["gap_median"] == 2.5
    assert r[3]["gap_median"] is None  # the event before the window is not seen
    assert (r[4]["gap_min"], r[4]["gap_median"], r[4]["events"]) == (0.0, 0.25, 4)


def test_gaps_equal_brute_force_on_a_busy_entity(spark):
    rng = random.Random(5)
    times = [D(2019, 6, 1) + dt.timedelta(seconds=rng.randrange(0, 400 * 86400, 3600)) for _ in range(1500)]
    ev = spark.createDataFrame([(1, t) for t in times], "key int, ts timestamp_ntz")
    row = panel.gap_features(ev, "key", "ts", panel.SEASONS, 730).where("season = 2020").first()
    import numpy as np

    inside = sorted(t for t in times if t < D(2020, 10, 1))
    gaps = [(b - a).total_seconds() / 86400 for a, b in zip(inside, inside[1:])]
    assert row["gap_median"] == pytest.approx(np.median(gaps)) and row["gap_min"] == min(gaps)
    assert row["events"] == len(inside)


def test_distinct_sub_units(spark):
    rows = [(1, D(2020, 1, 1), "1A", True, "N"), (1, D(2020, 1, 9), "1A", True, "Y"), (1, D(2020, 1, 2), "BLDG", False, "Y"), (1, D(2020, 7, 1), "2B", True, "N")]
    ev = spark.createDataFrame(rows, "key int, ts timestamp_ntz, sub_key string, is_sub boolean, flag string")
    r = panel.problem_windows(ev, "key", "ts", "sub_key", F.col("is_sub"), F.col("flag") == "N").where("season = 2020").first()
    assert (r["apts_ps"], r["evt_all_ps"], r["evt_n_ps"], r["apts_t730"]) == (1, 3, 1, 2)


def test_features_ignore_everything_from_the_cutoff_on(spark, folder):
    """Dropping all rows from 1 October 1998 on leaves the features of season 1998 as they were."""
    full = panel_queries.frame(spark, folder).where("season = 1998").drop("label_c", "label_bc")
    spine = standins.spine(spark, folder)
    li = standins.lineitem(spark, folder).where(F.col("l_shipdate") < F.lit(D(1998, 10, 1)))
    original = standins.lineitem
    try:
        standins.lineitem = lambda *_: li
        cut_spine = standins.spine(spark, folder).where("season < 1998")
        rows_1998 = spine.where("season = 1998").withColumns({"label_c": F.lit(0), "label_bc": F.lit(0)})
        joined = cut_spine.unionByName(rows_1998)
        standins_spine = standins.spine
        standins.spine = lambda *_: joined
        cut = panel_queries.frame(spark, folder).where("season = 1998").drop("label_c", "label_bc")
        a, b = contracts.fingerprint(full).first(), contracts.fingerprint(cut).first()
    finally:
        standins.lineitem = original
        standins.spine = standins_spine
    assert a["rows"] > 0 and a == b


def test_frame_is_the_same_under_other_partitioning(spark, folder):
    prints = []
    for n in ("4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        prints.append(contracts.fingerprint(panel_queries.feature_frame(spark, folder)).first())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prints[0] == prints[1]


def test_frame_has_the_fixed_order(spark, folder):
    f = panel_queries.frame(spark, folder)
    want = ["key", "season", *panel.fixed_features(standins.SPEC.classes), *panel_queries.FRAME_TAIL, "label_c", "label_bc"]
    assert f.columns == want
    four = panel.PanelSpec(2017, 2014, 2020, dt.date(2019, 6, 1))
    assert len(panel.fixed_features(four.classes)) == 30


def test_neighbouring_days_are_found_once_per_entity(spark):
    """One window by entity before days go to their targets; a neighbour outside a target's window gives it no gap."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    days = [(1, at(d)) for d in (0, 3, 9, 12)] + [(2, at(5))]
    blocks = panel.Cutoffs(
        first_target=lambda d: F.floor(F.datediff(d, F.lit(dt.date(2024, 1, 1))) / 5).cast("int") + 1,
        reach=2,
        cutoff=lambda p: F.date_add(F.lit(dt.date(2024, 1, 1)), p * 5),
    )
    got = panel.gap_features(spark.createDataFrame(days, "k int, ts timestamp"), "k", "ts", blocks, 8, "block")
    assert {(r["k"], r["block"]): (r["events"], r["gap_median"], r["gap_min"]) for r in got.collect()} == {
        (1, 1): (2, 3.0, 3.0), (1, 2): (2, 6.0, 6.0), (1, 3): (2, 3.0, 3.0), (1, 4): (1, None, None),
        (2, 2): (1, None, None),
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "lag(last_t" in line]
    assert windows and not any("block" in line for line in windows)
