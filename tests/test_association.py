from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelwake.operators import association as assoc
from panelwake.operators import stats


def table(spark, incidents, events):
    rows = [(k, d, "i") for k, d in incidents] + [(k, d, "e") for k, d in events]
    df = spark.createDataFrame(rows, "k int, d int, s string")
    return assoc.timeline(df, "k", F.col("d"), {"inc": F.col("s") == "i", "evt": F.col("s") == "e"})


@pytest.fixture(scope="module")
def drawn():
    """A third of all rows sits on one entity."""
    rng = random.Random(7)
    pick = lambda: 1 if rng.random() < 0.34 else rng.randint(2, 12)
    return (
        [(pick(), rng.randint(0, 400)) for _ in range(300)],
        [(pick(), rng.randint(0, 400)) for _ in range(500)],
    )


def pairs(inc, evt, w):
    return [(i, e) for i in inc for e in evt if i[0] == e[0] and i[1] - w <= e[1] <= i[1]]


def test_bounds_are_inclusive(spark):
    tl = table(spark, [(1, 100)], [(1, 100), (1, 86), (1, 85), (1, 101), (2, 100)])
    row = assoc.associate(tl, "inc", "evt", [14, 15]).first()
    assert (row["n_14"], row["n_15"]) == (2, 3)


def test_counts_equal_brute_force(spark, drawn):
    inc, evt = drawn
    tl = table(spark, inc, evt)
    for w in (14, 30):
        rows = assoc.associate(tl, "inc", "evt", [w]).collect()
        got = {(r["key"], r["day"]): r[f"n_{w}"] for r in rows}
        want = {i: sum(1 for e in evt if e[0] == i[0] and i[1] - w <= e[1] <= i[1]) for i in set(inc)}
        assert got == want


def test_multiplicity_and_pair_sums(spark, drawn):
    inc, evt = drawn
    rows = {r["days"]: r for r in assoc.multiplicity_rates(table(spark, inc, evt), "inc", "evt", [14, 30]).collect()}
    for w in (14, 30):
        m = [sum(1 for i in inc if i[0] == e[0] and e[1] <= i[1] <= e[1] + w) for e in evt]
        r = rows[w]
        assert r["pairs_incident_side"] == r["pairs_event_side"] == sum(m) == len(pairs(inc, evt, w))
        assert r["matched_events"] == sum(x >= 1 for x in m)
        assert r["matched_twice"] == sum(x >= 2 for x in m)


def test_lag_weights_equal_listed_pairs(spark, drawn):
    inc, evt = drawn
    tl = table(spark, inc, evt)
    i = tl.where("inc > 0").select("key", "day", F.col("inc").alias("n"))
    e = tl.where("evt > 0").select("key", "day", F.col("evt").alias("n"))
    got = {r["lag"]: r["pairs"] for r in assoc.lag_weights(i, e, 30).collect()}
    want = {}
    for a, b in pairs(inc, evt, 30):
        want[a[1] - b[1]] = want.get(a[1] - b[1], 0) + 1
    assert got == want


def test_first_ahead(spark):
    tl = table(spark, [(1, 10), (1, 20)], [(1, 5), (1, 10), (1, 11), (1, 21)])
    rows = tl.withColumn("f", assoc.first_ahead("inc", 10)).where("evt > 0").collect()
    assert {r["day"]: r["f"] for r in rows} == {5: 10, 10: 10, 11: 20, 21: None}


def test_coverage_edges(spark):
    df = spark.createDataFrame([(100, "e"), (200, "e"), (129, "i"), (130, "i"), (201, "i")], "day int, s string")
    span = assoc.coverage_span(df, F.col("day"), {"evt": F.col("s") == "e"})
    left, right = assoc.edges(span, {"evt": 30})
    rows = df.where("s = 'i'").select("day", left.alias("l"), right.alias("r")).collect()
    assert {r["day"]: (r["l"], r["r"]) for r in rows} == {129: (True, False), 130: (False, False), 201: (False, True)}


def test_merge_timelines(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "key int, day int")
    b = spark.createDataFrame([(1, 5)], "key int, day int")
    rows = assoc.merge_timelines({"inc": a, "evt": b}).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [(1, 5, 2, 1), (2, 6, 1, 0)]


def test_distribution_is_linear_interpolation(spark):
    import numpy as np

    values = [0, 0, 1, 2, 5, 5, 9]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    row = stats.histogram_of(df, [], F.col("v"), F.lit(1)).agg(*stats.distribution()).first()
    assert row["n"] == 7
    for name, p in (("p25", 25), ("median", 50), ("p75", 75)):
        assert row[name] == pytest.approx(np.percentile(values, p))
    assert row["pct_ge2"] == pytest.approx(100 * 4 / 7)


def test_window_runs_on_day_grain(spark, drawn):
    """The window must read counted days, not rows: a count comes before it in the plan."""
    tl = table(spark, *drawn)
    plan = assoc.associate(tl, "inc", "evt", [14])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")
