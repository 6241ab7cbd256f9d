"""Quality checks that turn red: storage that can't be read, missing tables and columns."""

from datetime import datetime

from sensorframe import model
from sensorframe.plans.quality import quality_checks

NOW = datetime(2024, 1, 8)


def _rows(spark, *tables):
    return {r.Check: (r.OK, r.Details) for r in quality_checks(spark, *tables, NOW).collect()}


def test_source_reachable_reads_the_storage(spark, facts_df, tmp_path):
    path = tmp_path / "history"
    facts_df([("2024-01-05", 1.0, 1, "tempc")]).coalesce(1).write.parquet(str(path))
    history = spark.read.parquet(str(path))
    env = facts_df([])
    meta = spark.createDataFrame([(1, "t", "x")], "id long, nodeTypeName string, vanity string")
    good = _rows(spark, history, env, meta)
    assert good["Source reachable"] == (True, "OK")
    part = next(p for p in path.iterdir() if p.name.endswith(".parquet"))
    part.write_bytes(b"no longer parquet")
    bad = _rows(spark, history, env, meta)
    assert bad["Source reachable"][0] is False and bad["history columns"][0] is True
    assert _rows(spark, None, env, meta)["Source reachable"] == (False, "No columns or no table: ['history']")
    assert _rows(spark, env.drop("value"), env, meta)["history columns"][0] is False
    assert model.CHECK_SCHEMA.names == ["Check", "OK", "Details"]
