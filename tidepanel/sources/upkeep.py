"""Publication behind gates, compaction by bytes, retention, and experiment records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .tables import delete, exists, folder, touch, written

#: Marks a version that may be served.
SERVED = "_SERVED"


class Refused(ValueError):
    """A version did not meet its conditions; what was served before still is."""


def publish_checked(rows: DataFrame, root: str, metrics: dict[str, Column], conditions: dict[str, Callable[[dict], bool]]) -> dict:
    """Write rows as the next version under `root` and serve it if all conditions hold on its metrics, which are observed while it is written:
    no second pass, and no gap between what was judged and what is served. Raises Refused, naming the conditions, and drops the version otherwise."""
    spark = rows.sparkSession
    seen = Observation(f"gate-{uuid.uuid4().hex}")
    numbers = [int(n.removeprefix("version=")) for n in folder(spark, root) if n.startswith("version=")]
    at = f"{root}/version={max(numbers, default=-1) + 1}"
    rows.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.parquet(at)
    found = seen.get
    failed = [name for name, holds in conditions.items() if not holds(found)]
    if failed:
        delete(spark, at)
        raise Refused(f"{', '.join(failed)}: {found}")
    touch(spark, f"{at}/{SERVED}")
    return found


def served(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version that was found good, None if there is none."""
    numbers = [int(n.removeprefix("version=")) for n in folder(spark, root) if n.startswith("version=") and exists(spark, f"{root}/{n}/{SERVED}")]
    return spark.read.parquet(f"{root}/version={max(numbers)}") if numbers else None


def file_bins(rows: DataFrame, target: int) -> DataFrame:
    """path, folder, size, bin: files of each folder in order of their names, a new bin where another `target` bytes of them are full. Files of
    three quarters of the target or more stay as they are (bin null). One row a file."""
    files = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.max("size").alias("size"))
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    small = F.when(F.col("size") < 0.75 * target, F.col("size"))
    before = F.sum(small).over(Window.partitionBy("folder").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - small
    return files.withColumn("bin", F.floor(before / target))


def compact(spark: SparkSession, source: str, target_path: str, target: int, partitions: tuple[str, ...] = ()) -> tuple[int, int]:
    """Write the table at `source` to `target_path` with files of about `target` bytes within each folder; returns (files before, files after).

    Each bin of small files becomes one task and so one file; large files are bins of their own. Bins are numbered over the whole table,
    so their number follows the bytes."""
    rows = spark.read.parquet(source)
    bins = written(file_bins(rows, target), "file-bins")
    # a number for each bin: folders and bins in order; files are few beside rows
    ids = bins.select("path", F.dense_rank().over(Window.orderBy("folder", F.coalesce("bin", F.lit(-1)), F.when(F.col("bin").isNull(), F.col("path")))).cast("int").alias("_bin"))
    ids = written(ids, "file-bin-ids")
    n = ids.agg(F.max("_bin")).first()[0] or 0
    if n:
        dealt = rows.select("*", F.col("_metadata.file_path").alias("path")).join(ids, "path").repartitionById(n, F.col("_bin") - 1).drop("path", "_bin")
        (dealt.write.partitionBy(*partitions) if partitions else dealt.write).parquet(target_path)
    return bins.count(), n


def expire(spark: SparkSession, tables: dict[str, str], version: str) -> DataFrame:
    """Drop the versions (folders `version`=...) of each table that lie before the table's own cutoff; the newest one always stays.
    Returns path, dropped. tables: path -> cutoff, compared as text (dates as yyyy-mm-dd)."""
    gone = []
    for path, cutoff in tables.items():
        found = sorted(n.removeprefix(f"{version}=") for n in folder(spark, path) if n.startswith(f"{version}="))
        old = [x for x in found[:-1] if x < cutoff]
        delete(spark, *[f"{path}/{version}={x}" for x in old])
        gone += [(path, x) for x in old]
    return spark.createDataFrame(gone, "path string, dropped string")


def canonical(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


def record_experiment(metrics: DataFrame, path: str, name: str, config: dict, commit: str, snapshot: str) -> None:
    """Append one record: what ran (name, code commit, configuration and its fingerprint), on which snapshot, and the one row of metrics it gave."""
    text = canonical(config)
    record = metrics.select(
        F.lit(name).alias("name"), F.lit(commit).alias("commit"), F.lit(text).alias("config"), F.sha2(F.lit(text), 256).alias("config_id"), F.lit(snapshot).alias("snapshot"), F.current_timestamp().alias("recorded_at"), F.struct("*").alias("metrics")
    )
    record.coalesce(1).write.mode("append").parquet(path)

