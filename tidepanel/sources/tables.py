"""Reading the given tables, and tables that a job writes for itself."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: list[str] = []
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of this process's own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder that no other call has; `clear` deletes it once results are read."""
    _made.append(f"{shared_dir(spark)}/tidepanel/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete every table that this process wrote for itself and still holds. Results are lazy: call this once they have been read."""
    delete(spark, *_made)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    at, system = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file; it is there whole or not at all."""
    at, system = _at(spark, path)
    system.create(at, True).close()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder; one that stands at the target already is replaced, and without a source nothing happens."""
    (a, system), (b, _) = _at(spark, source), _at(spark, target)
    if system.exists(a):
        system.mkdirs(b.getParent())
        system.delete(b, True)
        if not system.rename(a, b):
            raise OSError(f"{source} could not be moved to {target}")


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, system = _at(spark, path)
        system.delete(at, True)
        if path in _made:
            _made.remove(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: lineage ends there."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unless_empty(rows: DataFrame, step):
    """step(rows), or None where there is no row to work on: a stage that has nothing to do is passed over."""
    return None if rows.isEmpty() else step(rows)


def table_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """A catalog table, or no rows of its schema where it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.range(0).selectExpr(*[f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema])


def latest_version(spark: SparkSession, root: str, version: str, at: str | None = None) -> DataFrame:
    """Rows of the newest partition of column `version`, or of the newest one not after `at`; other partitions are not read."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(root)
    known = rows.where(F.col(version) <= F.lit(at)) if at is not None else rows
    newest = known.agg(F.max(version)).first()[0]
    return rows.where(F.col(version) == F.lit(newest))


def file_stats(rows: DataFrame) -> DataFrame:
    """File name, bytes and rows of each file that a frame reads."""
    from pyspark.sql import functions as F

    return rows.select("_metadata.file_name", "_metadata.file_size").groupBy("file_name").agg(F.max("file_size").alias("bytes"), F.count("*").alias("n_rows"))


def ensure_table(spark: SparkSession, name: str, schema: StructType) -> None:
    """Create a Parquet table, or create it anew if its columns have changed."""
    if spark.catalog.tableExists(name):
        if [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in schema]:
            return
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}) USING parquet")


def policy_digest(policy: dict) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()


def write_policy(spark: SparkSession, path: str, policy: dict) -> str:
    """Store the fingerprint of the rules that a table was made under, beside it."""
    digest = policy_digest(policy)
    spark.range(1).selectExpr(f"'{digest}' AS digest").write.mode("overwrite").parquet(f"{path}_policy")
    return digest


def check_policy(spark: SparkSession, path: str, digest: str) -> None:
    """Raise if a table was made under other rules."""
    found = spark.read.parquet(f"{path}_policy").first()["digest"]
    if found != digest:
        raise ValueError(f"{path} was made under policy {found[:12]}, not {digest[:12]}")


def publish(rows: DataFrame, key: str, fmt: str, **options: str) -> None:
    """Write rows as (key, JSON value) to a keyed sink such as kafka, or to files of a format that takes strings."""
    from pyspark.sql import functions as F

    out = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    out.write.format(fmt).options(**options).mode("append").save()
