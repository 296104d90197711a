from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelwake.operators import dedupe, ranking, strata
from panelwake.streaming import feeds


def land(spark, path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.parquet(f"{path}/{i}")
    schema = spark.read.parquet(f"{path}/0").schema
    return schema


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def test_dedupe_over_batches_and_late_rows(spark, tmp_path):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    path = str(tmp_path / "in")
    files = [
        [(1, t(1)), (2, t(1)), (1, t(1, 5))],
        [(2, t(2)), (3, t(9))],
        [(4, t(10))],
        [(5, t(1)), (3, t(9)), (6, t(11))],  # 5 arrives too late
    ]
    schema = land(spark, path, files)
    out, query = feeds.drain(feeds.dedupe(stream(spark, path, schema), "ts", ["k"], "2 days"), "t")
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3, 4, 6]
    assert feeds.dropped_late(query) >= 1


def test_stream_association_equals_batch(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    inc = [(1, day(10)), (1, day(10)), (1, day(40)), (2, day(12)), (3, day(60))]
    evt = [(1, day(10)), (1, day(3)), (1, day(2)), (1, day(11)), (2, day(5)), (2, day(4)), (9, day(60))]
    a, b = str(tmp_path / "i"), str(tmp_path / "e")
    sa, sb = land(spark, a, [inc, [(8, day(90))]]), land(spark, b, [evt, [(8, day(89))]])
    out, _ = feeds.drain(feeds.associate(stream(spark, a, sa), stream(spark, b, sb), "k", "ts", 7), "t")
    got = {
        (r["key"], r["day"]): (r["i"], r["e"])
        for r in out.where("day < '2024-03-20'").groupBy("key", "day").agg(F.max("incidents").alias("i"), F.sum("events").alias("e")).collect()
    }
    want = {
        (1, day(10).date()): (2, 2), (1, day(40).date()): (1, 0), (2, day(12).date()): (1, 1), (3, day(60).date()): (1, 0),
    }
    assert got == want


def test_a_folder_of_parts_gives_the_rows_of_one_file(spark, folder, tmp_path):
    from panelwake.plans import stream_queries

    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    li.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = lambda q, at: sorted(map(tuple, q(spark, at).collect()))
    for q in (stream_queries.stream_dedupe, stream_queries.stream_assoc):
        one, many = rows(q, folder), rows(q, str(tmp_path))
        assert one and one == many and all(r[-1] == 0 for r in one)


def test_late_rows_of_several_batches_are_counted(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    for i, rows in enumerate([[(1, t(1))], [(2, t(20))], [(3, t(2)), (4, t(21))], [(5, t(3))]]):
        spark.createDataFrame(rows, "k int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = feeds.file_stream(spark, str(tmp_path / "in"), schema, per_batch=1)
    out, query = feeds.drain(feeds.dedupe(stream, "ts", ["k"], "2 days"), "t")
    assert len({p["batchId"] for p in query.recentProgress}) >= 4
    assert out.count() + feeds.dropped_late(query) == 5 and feeds.dropped_late(query) >= 1


def test_intake_keeps_late_rows_and_runs_again(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d)
    schema = "k int, ts timestamp, v string"
    batches = [
        [(1, t(10), "a"), (2, t(11), "a"), (2, t(11), "a"), (None, t(11), "a"), (9, None, "a")],
        [(2, t(11), "b"), (3, t(2), "b"), (4, t(30), "b"), (None, t(11), "b"), (9, None, "b")],
        [(5, t(26), "c"), (6, t(25), "c"), (4, t(30), "c")],
        [(7, t(31), "d")],
    ]
    from panelwake.streaming.feeds import Intake

    intake = Intake(str(tmp_path / "home"), "ts", ["k", "ts"], 5)
    frames = [spark.createDataFrame(b, schema) for b in batches]
    state = lambda: (
        sorted((r["batch"], str(r["k"]), r["v"]) for r in intake.taken(spark, frames[0].schema).collect()),
        sorted((r["batch"], r["k"], r["limit"]) for r in intake.late(spark, frames[0].schema).collect()),
        sorted((r["batch"], r["rows"], r["taken"], r["late"]) for r in intake.marks(spark).collect()),
    )
    for i, frame in enumerate(frames):
        intake.take(frame, i)
    taken, late, marks = state()
    assert taken == [(0, "1", "a"), (0, "2", "a"), (0, "9", "a"), (0, "None", "a"), (1, "4", "b"), (2, "5", "c"), (3, "7", "d")]
    assert late == [(1, 3, t(6)), (2, 6, t(25))]
    assert marks == [(0, 5, 4, 0), (1, 5, 1, 1), (2, 3, 1, 1), (3, 1, 1, 0)]
    intake.take(frames[1], 1)  # a batch that failed is run again
    intake.take(frames[3], 3)
    assert state() == (taken, late, marks)
    intake.take(spark.createDataFrame([], schema), 4)  # nothing landed
    assert state()[0] == taken


def test_intake_resumes_where_it_stopped(spark, tmp_path):
    from panelwake.streaming.feeds import Intake

    t = lambda d: dt.datetime(2024, 1, d)
    intake = Intake(str(tmp_path / "home"), "ts", ["k"], 2)
    for rows in ([(1, t(1))], [(2, t(20)), (1, t(1))], [(3, t(2)), (4, t(21))]):
        spark.createDataFrame(rows, "k int, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        intake.run(stream)
        intake.run(stream)  # nothing new
    marks = sorted((r["batch"], r["rows"], r["taken"], r["late"]) for r in intake.marks(spark).collect())
    assert marks == [(0, 1, 1, 0), (1, 2, 1, 0), (2, 2, 1, 1)]


def test_landings_are_several_batches_with_late_rows(spark, folder):
    from panelwake.plans import stream_queries

    rows = sorted(stream_queries.stream_ingest_batches(spark, folder).collect())
    assert len(rows) >= 3 and sum(r["late_rows"] for r in rows) > 0 and sum(r["repeated"] for r in rows) > 0
    assert stream_queries.stream_assoc_batches(spark, folder).first()["batches"] >= 3


def test_keep_first_limits_rows_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = dedupe.keep_first(df, ["k"], [F.desc("id")])
    assert {r["k"]: r["id"] for r in out.collect()} == {0: 999, 1: 997, 2: 998}
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_single_valued_and_conflicts(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, None), (None, 5)], "k int, v int")
    assert [tuple(r) for r in dedupe.single_valued(df, "k", "v").collect()] == [(1, 5)]
    r = dedupe.conflicts(df, "k", "v").first()
    assert (r["keys"], r["conflicting_keys"], r["usable_keys"], r["unusable_rows"]) == (2, 1, 1, 2)


def test_dominant_category_ties_go_up(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "g int, c string")
    assert {r["g"]: r["c"] for r in strata.dominant(df, ["g"], "c").collect()} == {1: "b", 2: "a"}


def test_zero_history(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first = spark.createDataFrame([(1, dt.date(2020, 9, 30)), (2, dt.date(2020, 10, 1))], "k int, first_ts date")
    out = ranking.zero_history(e, first, "k", F.lit(dt.date(2020, 10, 1)))
    assert {r["k"]: r["zero_history"] for r in out.collect()} == {1: False, 2: True, 3: True}


def test_association_keeps_what_later_days_need_and_counts_late_rows(spark, tmp_path):
    """Batches give what one batch gives; a batch holds back open days only, and may run again."""
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    kind = "key int, day date, incidents long, events long"
    first = [(1, day(0), 0, 1), (1, day(5), 1, 0), (1, day(5), 1, 1), (1, day(19), 0, 2), (None, day(6), 1, 0), (None, day(6), 0, 1), (3, None, 1, 1)]
    second = [(1, day(20), 1, 0), (1, day(30), 0, 1), (2, day(21), 1, 0), (1, day(4), 1, 1), (5, day(40), 0, 1)]  # day 4 is late
    assoc = feeds.Association(str(tmp_path / "a"), "key", 7, 2)
    tables = [spark.createDataFrame(rows, kind) for rows in (first, second)]
    for batch, rows in [(0, tables[0]), (1, tables[1]), (1, tables[1])]:
        assoc.take(rows, batch)
    got = sorted(assoc.found(tables[0]).collect(), key=lambda r: r["day"])
    assert [(r["key"], r["day"], r["incidents"], r["events"], r["batch"]) for r in got] == [
        (1, day(5), 2, 2, 0), (None, day(6), 1, 0, 0), (1, day(20), 1, 2, 1), (2, day(21), 1, 0, 1),
    ]
    assert [tuple(r) for r in assoc.marks(spark).orderBy("batch").collect()] == [(day(19), 6, 0, 0), (day(40), 5, 1, 1)]
    held = spark.read.parquet(f"{assoc.home}/days/batch=0").where("open")
    assert [(r["key"], r["day"]) for r in held.collect()] == [(1, day(19))]  # nothing older than look-back and delay


def test_batches_of_association_write_no_state_rows(spark, folder, monkeypatch):
    """The landings go through windows over days, not through a state store with a lookup per row."""
    from panelwake.plans import stream_queries

    runs, run = [], feeds.Association.run
    monkeypatch.setattr(feeds.Association, "run", lambda self, stream: runs.append(run(self, stream)) or runs[-1])
    assert stream_queries.stream_assoc_batches(spark, folder).count() > 0
    assert len(runs) > 1
    assert not [op for q in runs for p in q.recentProgress for op in p["stateOperators"]]
