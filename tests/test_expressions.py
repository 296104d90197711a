from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelwake.functions import calendar, keys, numeric, text


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "day, season",
    [
        (dt.date(2020, 9, 30), None),
        (dt.date(2020, 10, 1), 2020),
        (dt.date(2021, 5, 31), 2020),
        (dt.date(2021, 6, 1), None),
        (dt.date(2021, 1, 15), 2020),
    ],
)
def test_season_boundaries(spark, day, season):
    assert one(spark, day, calendar.season_of("v"), "v date") == season


def test_season_label(spark):
    assert one(spark, 1999, calendar.season_label("v"), "v int") == "1999-00"
    assert one(spark, 2019, calendar.season_label("v"), "v int") == "2019-20"


def test_next_cutoff_season(spark):
    f = calendar.next_cutoff_season("v")
    assert one(spark, dt.date(2020, 9, 30), f, "v date") == 2020
    assert one(spark, dt.date(2020, 10, 1), f, "v date") == 2021


@pytest.mark.parametrize(
    "raw, key",
    [
        ("2054800111.00000000", 2054800111),
        ("2054800111", 2054800111),
        ("0000000000", None),
        ("", None),
        (None, None),
        ("abc", None),
        ("-5", None),
    ],
)
def test_key_hygiene(spark, raw, key):
    assert one(spark, raw, keys.normalize_key("v")) == key


def test_key_hygiene_keeps_zero_when_asked(spark):
    assert one(spark, "0000000000", keys.normalize_key("v", False)) == 0


def test_composite_key(spark):
    got = one(spark, "x", keys.composite_key(F.lit("2"), F.lit("123"), F.lit("7.0")))
    assert got == 2001230007


def test_epoch_micros_ignores_session_zone(spark):
    ts = dt.datetime(2024, 3, 10, 2, 30, 0, 123456)
    before = spark.conf.get("spark.sql.session.timeZone")
    want = int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.123456' AS v")
            assert df.select(calendar.epoch_micros("v")).first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("E. 136th St", "EAST 136 STREET"),
        ("  w   1st av ", "WEST 1 AVENUE"),
        ("St Nicholas Pl", "STREET NICHOLAS PLACE"),
        ("1ST 2ND 3RD 4TH", "1 2 3 4"),
        ("A1ST", "A1ST"),
        ("Grand Blvd.", "GRAND BOULEVARD"),
        ("", ""),
    ],
)
def test_street(spark, raw, want):
    assert one(spark, raw, text.normalize_street("v")) == want


def test_text_uses_all_white_space(spark):
    assert one(spark, " a 　b\t\x1fc ", text.normalize_text("v")) == "A B C"
    assert one(spark, None, text.normalize_text("v")) == ""


def test_owner_key(spark):
    lit = F.lit
    make = lambda *a: one(spark, "x", text.owner_key(*[lit(v).cast("string") for v in a]))
    assert make("12 ", " main  st", None, "acme") == "ADDR:12|MAIN ST|"
    assert make("12", " ", "10001", "acme  co") == "CORP:ACME CO"
    assert make("12", None, "10001", None) is None


def test_split_address(spark):
    df = spark.createDataFrame([("12 main st",), ("alone",)], "v string")
    number, street = text.split_address("v")
    assert [tuple(r) for r in df.select(number, street).collect()] == [("12", "main st"), ("alone", "")]


@pytest.mark.parametrize(
    "units, name",
    [(None, "unmatched"), (1, "<2"), (2, "2-5"), (5, "2-5"), (6, "6-19"), (19, "6-19"), (20, "20-49"), (50, "50+")],
)
def test_unit_class(spark, units, name):
    assert one(spark, units, numeric.unit_class("v"), "v int") == name


@pytest.mark.parametrize("x", [0.5, 1.0, 2.0, 3.7, 10.0, 250.0, 1e6])
def test_log_gamma(spark, x):
    got = one(spark, x, numeric.log_gamma(F.col("v")), "v double")
    assert got == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_units_ladder(spark):
    df = spark.createDataFrame([(4, 2), (0, 2), (None, 2), (0, None), (None, 0)], "t int, r int")
    u, s = numeric.units_ladder(F.col("t"), F.col("r"))
    assert [tuple(r) for r in df.select(u, s).collect()] == [(4.0, 0), (2.0, 1), (2.0, 1), (3.0, 2), (3.0, 2)]


def test_cap_units(spark):
    df = spark.createDataFrame([(3.0, 5.0), (80.0, 60.0), (1.0, 0.0)], "u double, k double")
    u, k = numeric.cap_units(F.col("u"), F.col("k"), 50.0)
    assert [tuple(r) for r in df.select(u, k).collect()] == [(3.0, 3.0), (50.0, 50.0), (1.0, 0.0)]


def test_mixed_radix_last_dimension_fastest(spark):
    dims = [("a", [1, 2]), ("b", [10, 20, 30])]
    out = numeric.mixed_radix(F.col("id"), dims)
    rows = spark.range(6).select(*[c.alias(n) for n, c in out.items()]).collect()
    assert [tuple(r) for r in rows] == [(1, 10), (1, 20), (1, 30), (2, 10), (2, 20), (2, 30)]


def test_edge_status(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    got = [r[0] for r in df.select(numeric.edge_status(F.col("v"), [1, 2, 3])).collect()]
    assert got == ["low-edge", "interior", "high-edge"]
