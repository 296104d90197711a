from __future__ import annotations

from panelwake import session


def test_durable_results_go_to_the_named_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_path(spark, "x").startswith(before or session.shared_dir(spark))
    kept = session.durable(spark.range(10))
    assert kept.count() == 10
    assert "ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
