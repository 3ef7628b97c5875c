"""Helpers around tables and sinks."""

import pytest
from pyspark.sql.types import StructType

from tidepanel.sources import tables as t


def test_tables_are_made_anew_when_columns_change(spark):
    a, b = StructType.fromDDL("x int"), StructType.fromDDL("x int, y string")
    assert t.table_or_empty(spark, "panel_a", a).count() == 0
    t.ensure_table(spark, "panel_a", a)
    spark.sql("INSERT INTO panel_a VALUES (1)")
    t.ensure_table(spark, "panel_a", a)
    assert t.table_or_empty(spark, "panel_a", a).count() == 1
    t.ensure_table(spark, "panel_a", b)
    assert spark.table("panel_a").columns == ["x", "y"] and spark.table("panel_a").count() == 0
    spark.sql("DROP TABLE panel_a")


def test_policy_is_checked(spark, tmp_path):
    at = f"file://{tmp_path}/table"
    digest = t.write_policy(spark, at, {"limit": 1})
    t.check_policy(spark, at, digest)
    with pytest.raises(ValueError):
        t.check_policy(spark, at, "0" * 64)


def test_publish_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01", 2.0), (1, "2020-02-01", 3.0)], "k int, at string, x double")
    t.publish(rows, "k", "json", path=f"file://{tmp_path}/out")
    assert {r["value"] for r in spark.read.json(f"file://{tmp_path}/out").collect()} == {'{"k":1,"at":"2020-01-01","x":2.0}', '{"k":1,"at":"2020-02-01","x":3.0}'}
    rows.write.partitionBy("at").parquet(f"{tmp_path}/v")
    assert [r["x"] for r in t.latest_version(spark, f"{tmp_path}/v", "at", "2020-01-15").collect()] == [2.0]
    assert [r["x"] for r in t.latest_version(spark, f"{tmp_path}/v", "at").collect()] == [3.0]
