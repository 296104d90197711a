"""Every registered query: SQL comparison where there is SQL, otherwise rows and a stable schema."""

from __future__ import annotations

import check
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, folder, name):
    ok, text = check.compare(spark, duck, name, folder)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, folder, name):
    df = entry.queries()[name](spark, folder)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
