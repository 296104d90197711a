from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwake.functions import keys
from panelwake.operators import waterfall
from panelwake.sources import contracts, landing
from panelwake.sources.contracts import ContractError


def test_undeclared_column_stops(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ContractError):
        contracts.require_columns(df, ["a"])
    with pytest.raises(ContractError):
        contracts.require_columns(df, ["b", "a"], exact=True)
    assert contracts.require_columns(df, ["a", "b"], exact=True) is df


def test_conform_adds_missing_and_orders(spark):
    schema = T.StructType().add("b", "string").add("a", "long").add("c", "date")
    out = contracts.conform(spark.createDataFrame([("7", "x")], "a string, b string"), schema)
    assert out.columns == ["b", "a", "c"]
    assert tuple(out.first()) == ("x", 7, None)


def test_empty_table_stops(spark):
    with pytest.raises(ContractError):
        contracts.require_rows(spark.createDataFrame([], "a int"), "events")


def test_domain_vocabulary_and_lossless(spark):
    df = spark.createDataFrame([("Y", "1"), ("N", "2x")], "flag string, n string")
    contracts.require_domain(df, "flag", ["Y", "N"])
    with pytest.raises(ContractError):
        contracts.require_domain(df, "flag", ["Y"])
    with pytest.raises(ContractError):
        contracts.require_lossless(df, {"n": keys.to_number("n")})
    vocabulary = spark.createDataFrame([("Y",)], "v string")
    with pytest.raises(ContractError):
        contracts.require_vocabulary(df, "flag", vocabulary)


def test_invariants(spark):
    df = spark.createDataFrame([(1, 2000, 0), (1, 2000, 1)], "k int, season int, y int")
    with pytest.raises(ContractError):
        contracts.require_invariants(df, ["k", "season"], ["y"], "season", 2000, 2)
    contracts.require_invariants(df.where("y = 1"), ["k", "season"], ["y"], "season", 2000, 1)


def test_counts_contract(spark):
    found = spark.createDataFrame([(2020, 50), (2022, 49)], "cohort int, n long")
    expected = spark.createDataFrame([(2020, 50), (2022, 50), (2024, 50)], "cohort int, n long")
    with pytest.raises(ContractError) as e:
        contracts.require_counts(found, expected, ["cohort"], ["n"])
    assert "2024" in str(e.value) and "2022" in str(e.value)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    a = contracts.fingerprint(df.repartition(3)).first()
    b = contracts.fingerprint(df.orderBy(F.desc("id")).repartition(16)).first()
    c = contracts.fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 9).otherwise(F.col("v")))).first()
    assert a == b and a != c
    contracts.require_fingerprint(df, a.asDict())
    with pytest.raises(ContractError):
        contracts.require_fingerprint(df.where("id > 0"), a.asDict())


def test_changed_tables(spark):
    a = {"x": spark.range(5), "y": spark.range(6)}
    b = {"x": spark.range(5), "y": spark.range(7)}
    diff = contracts.changed_tables(contracts.fingerprints(a), contracts.fingerprints(b))
    assert [r["table"] for r in diff.collect()] == ["y"]


def test_slice_refuses_to_reach_past_the_cutoff(spark):
    df = spark.createDataFrame([(dt.date(2020, 9, 30),), (dt.date(2020, 10, 1),)], "d date")
    cut = dt.date(2020, 10, 1)
    assert waterfall.trailing_slice(df, "d", dt.date(2020, 1, 1), cut, cut).count() == 1
    with pytest.raises(ContractError):
        waterfall.trailing_slice(df, "d", dt.date(2020, 1, 1), dt.date(2020, 10, 2), cut)
    with pytest.raises(ContractError):
        waterfall.latest_before(df, "d", cut)


def test_period_guard(spark):
    df = spark.createDataFrame([(2020,), (2026,)], "season int")
    with pytest.raises(ContractError):
        waterfall.guard_periods(df, "season", "load", range(2019, 2027), 2026)
    assert waterfall.guard_periods(df.where("season < 2026"), "season", "load", range(2019, 2026), 2026) == [2020]


def test_waterfall_counts_every_row_once(spark):
    df = spark.range(100)
    steps = [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 50), ("none", F.lit(None).cast("boolean"))]
    got = {r["reason"]: r["rows"] for r in waterfall.waterfall_counts(df, steps).collect()}
    assert got == {"even": 50, "small": 25, "none": 0, "kept": 25}
    assert waterfall.survivors(df, steps).count() == 25


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    assert tuple(contracts.repeated_keys(df, ["k"]).first()) == (2, 1)


def test_sinks(spark, tmp_path):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"), (F.col("id") % 3).alias("season"))
    landing.write_sorted(df, str(tmp_path / "sorted"), ["k"], 3)
    back = spark.read.parquet(str(tmp_path / "sorted"))
    assert back.count() == 1000
    landing.write_predictions(df, str(tmp_path / "pred"), "season", "REHEARSAL")
    read = landing.read_up_to(spark, str(tmp_path / "pred"), "season", 1, ["k", "season", "run_label"])
    assert {r["season"] for r in read.select("season").distinct().collect()} == {0, 1}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    landing.append_audit(spark, str(tmp_path / "audit"), "a", [2020], [2020, 2021])
    landing.append_audit(spark, str(tmp_path / "audit"), "b", [2021], [2021])
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    landing.write_metrics(df.limit(3), str(tmp_path / "m"))
    landing.save_config(spark, str(tmp_path / "cfg"), {"depth": 3})
    assert landing.load_config(spark, str(tmp_path / "cfg")) == {"depth": 3}
    assert landing.markdown_table(spark.createDataFrame([("a", 0.5)], "k string, v double")).endswith("| a | 0.5000 |")


def test_parts_land_apart(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 5, 1), 1), (dt.date(2021, 5, 1), 2)], "d date, k int")
    bounds = [(dt.date(2019, 6, 1), dt.date(2021, 1, 1)), (dt.date(2021, 1, 1), None)]
    landing.write_parts(df, F.col("d"), bounds, str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).groupBy("part").count().orderBy("part").collect()
    assert [tuple(r) for r in got] == [(1, 1), (2, 1)]


def test_landed_json_gets_declared_columns(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": "1"}\n{"a": "2", "b": "z"}\n')
    schema = T.StructType().add("a", "string").add("b", "string").add("c", "string")
    rows = landing.read_landed(spark, str(tmp_path), schema).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", None, None), ("2", "z", None)]


def test_array_rows_in_any_column_order(spark):
    docs = spark.createDataFrame(
        [(1, '[["NAME","B","county"],["x","5","7"],["y","-666666666","12"]]'), (2, '[["county","NAME"],["3","z"]]')],
        "doc int, body string",
    )
    out = landing.rows_from_arrays(
        docs, "body", {"NAME": "name", "B": "b", "county": "county"}, ["doc"], ["B"], {"county": 3}
    )
    assert sorted(tuple(r) for r in out.drop("row_no").collect()) == [
        (1, "x", 5.0, "007"), (1, "y", None, "012"), (2, "z", None, "003")
    ]


def test_listing_lines(spark):
    body = "BOROUGH NUMBER STREET\nBX 12-14A  grand  av 3 4 50 \n\nPage 1\n1 of 3\nXX 1 bad 1 2 3"
    rows = landing.listing_lines(spark.createDataFrame([(1, body)], "doc int, body string"), "body", ["doc"])
    got = [(r["kind"], r["house_number"], r["street"], r["units"]) for r in rows.orderBy("line_no").collect()]
    assert got == [
        ("header", None, None, None),
        ("row", "12-14A", "GRAND AV", 50),
        ("residue", None, None, None),
        ("header", None, None, None),
        ("residue", None, None, None),
    ]
