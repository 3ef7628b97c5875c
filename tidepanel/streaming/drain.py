"""Streams that take what has arrived, split it by validity, and stop.

A source hands out rows with the unit that they came from and their place in it: a file (place 0), or a partition of a topic (the
offset). What a sink has taken is kept beside it as commit records of (unit, until), not in the checkpoint alone and not by batch numbers.
A batch takes only places that no record covers, so nothing is doubled when a checkpoint is lost and everything is read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import delete, finished, folder, rename


def json_files(spark: SparkSession, source: str, schema: StructType, **options: str) -> DataFrame:
    """A stream of JSON lines from files that arrive in a folder."""
    return spark.readStream.options(**options).schema(schema).json(source).select("*", F.col("_metadata.file_path").alias("_unit"), F.lit(0).cast("long").alias("_at"))


def log_topics(spark: SparkSession, fmt: str, schema: StructType, **options: str) -> DataFrame:
    """A stream of JSON values from a log of topics: any source that gives topic, partition, offset, value, as kafka does. The row keeps its topic."""
    raw = spark.readStream.format(fmt).options(**options).load()
    value = F.from_json(F.col("value").cast("string"), schema).alias("v")
    return raw.select(value, "topic", F.concat_ws("/", "topic", "partition").alias("_unit"), F.col("offset").alias("_at")).select("v.*", "topic", "_unit", "_at")


def drain(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], valid: str, invalid: str, checkpoint: str) -> None:
    """Take what has arrived since the last run, add a `reason` column with judge(), and append rows without a reason to `valid`, the others
    to `invalid`; then stop.

    A batch is written aside, then recorded, then moved into the two folders, so readers see recorded batches only. A run starts by
    ending what another one left: recorded batches are moved, others are dropped and read again."""
    spark = stream.sparkSession
    records = f"{valid}/_commits"

    def publish(name: str) -> None:
        for at in (valid, invalid):
            rename(spark, f"{at}/_aside/{name}", f"{at}/{name}")

    for name in folder(spark, f"{valid}/_aside"):
        if finished(spark, f"{records}/{name}"):
            publish(name)

    def split(batch: DataFrame, number: int) -> None:
        known = [f"{records}/{n}" for n in folder(spark, records) if finished(spark, f"{records}/{n}")]
        new = batch
        if known:
            taken = spark.read.schema("_unit string, _until long").parquet(*known).groupBy("_unit").agg(F.max("_until").alias("_until"))
            new = batch.join(taken, "_unit", "left").where("_until is null or _at > _until").drop("_until")
        judged = judge(new).persist()
        units = judged.groupBy("_unit").agg(F.max("_at").alias("_until"))
        # the same places have the same name, so a batch that is written again replaces itself
        mark = units.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("_unit", "_until")), F.lit(0)).alias("h"), F.coalesce(F.bit_xor(F.xxhash64("_until", "_unit")), F.lit(0)).alias("g")).first()
        if mark["n"]:
            name = f"commit={mark['h'] & (1 << 64) - 1:016x}{mark['g'] & (1 << 64) - 1:016x}"
            judged.where("reason is null").drop("reason", "_unit", "_at").write.mode("overwrite").parquet(f"{valid}/_aside/{name}")
            judged.where("reason is not null").drop("_unit", "_at").write.mode("overwrite").parquet(f"{invalid}/_aside/{name}")
            units.write.mode("overwrite").parquet(f"{records}/{name}")
            publish(name)
        judged.unpersist()

    stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_json(spark: SparkSession, source: str, schema: StructType, judge: Callable[[DataFrame], DataFrame], valid: str, invalid: str, checkpoint: str, **options: str) -> None:
    """`drain` of JSON files."""
    drain(json_files(spark, source, schema, **options), judge, valid, invalid, checkpoint)


#: Keyed state on disk, with its changes in the checkpoint instead of whole snapshots.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _newest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key the row with the largest `order`; of those the largest by the other columns."""
    rest = [c for c in columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_s")).select(key, "_s.*").select(*columns)


def follow_latest(spark: SparkSession, source: str, schema: StructType, key: str, order: str, store: str, checkpoint: str, **options: str) -> DataFrame:
    """The newest row of each key of a JSON stream, after taking what has arrived.

    State by key lives in the stream's own store; a batch writes the rows of the keys that it changed, and nothing else, to a folder named
    after the run of the checkpoint and the batch. A key's newest row is the largest over all changes, so late rows lose, and batches that
    come again, by retry or after a lost checkpoint, change nothing. `compact_changes` keeps the log short."""
    own = spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STATE}.items():
        own.conf.set(k, v)
    stream = own.readStream.options(**options).schema(schema).json(source)

    def save(batch: DataFrame, number: int) -> None:
        # the identity of this checkpoint: another one counts its batches from 0 again
        run = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id").alias("id")).first()["id"]
        batch.write.mode("overwrite").parquet(f"{store}/changes={run}-{number}")

    _newest(stream, key, order, schema.names).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_state(spark, schema, key, order, store)


def latest_state(spark: SparkSession, source: str, schema: StructType, key: str, order: str, store: str, checkpoint: str, **options: str) -> str | None:
    """`follow_latest`, and the folder of a table of the result: the changes of all runs put together, once a run that brought any."""
    follow_latest(spark, source, schema, key, order, store, checkpoint, **options)
    compact_changes(spark, schema, key, order, store, more_than=0)
    names = _changes(spark, store)
    return f"{store}/{names[-1]}" if names else None


def _changes(spark: SparkSession, store: str) -> list[str]:
    return [n for n in folder(spark, store) if n.startswith("changes=") and finished(spark, f"{store}/{n}")]


def read_state(spark: SparkSession, schema: StructType, key: str, order: str, store: str) -> DataFrame:
    names = _changes(spark, store)
    rows = spark.read.schema(schema).parquet(*[f"{store}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    return _newest(rows, key, order, schema.names)


def compact_changes(spark: SparkSession, schema: StructType, key: str, order: str, store: str, more_than: int = 16) -> int:
    """Make one set of changes of more than so many; returns how many are left. Sets that are gone are covered by the new one, and where a run
    ends between the two, both stand and say the same."""
    names = _changes(spark, store)
    if len(names) <= more_than or len(names) == 1 and names[0].startswith("changes=compacted-"):
        return len(names)
    read_state(spark, schema, key, order, store).write.parquet(f"{store}/changes=compacted-{uuid.uuid4().hex}")
    for n in names:
        delete(spark, f"{store}/{n}")
    return 1

