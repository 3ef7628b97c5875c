"""Exact dedup by a stateful stream.

Documents arrive in a store of files that never change. A stream over it keeps state on disk (RocksDB, checkpointed in the store,
without watermark or expiry): for each digest the least identifier, the locator of its content (file and row in the store) and how
many came. Rows are pre-aggregated before they are dealt to the state, so a text that a third of all rows have is one row a task.
A digest that came more than once is a hit: the full bytes of its rows are read from the store and compared, and texts that differ
under one digest are told apart by content. Rows of other digests are passed over where they lie: their bytes are not shuffled.

With a store of the caller's own, later calls know all earlier arrivals; without one, each call has a store to itself. Each call's arrivals
lie in a folder of its own, numbered in order of calls and named by the caller's `batch`; a batch that is delivered again under its name is
taken once, whether its first run ended or not. Newest states are written as a snapshot, so a call reads those and its own changes.
What an earlier call gave out as kept stays so there: when a smaller identifier comes later, that row is kept in its own call too, and
keep_id names it from then on.

Texts are equal when identical after each run of white space becomes one space; null counts as empty. The row with the least
identifier stays (null identifiers last; of rows with one identifier that of the earliest call, and of one call one row). An empty table gives no rows. Texts are taken
whole, one row each, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, drop, exists, folder, hot_join, new_path, written

#: State on disk; files grow as they fill, so a partition with little state takes little disk; all stores of an executor share its memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}

KEY = "struct<none:boolean,id:{}>"
STATE = "digest string, first struct<key:{key},call:string,file:string,at:bigint>, n bigint"

#: Bits for each digest of the filter that every task gets of those that came more than once, and how many digests it takes at most (8 MB);
#: more of them are matched by a join.
FILTER_SHARE, FILTER_MOST = 16, 1 << 22


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def first_seen(spark: SparkSession, store: str, key_type: str, max_files: int | None = None) -> DataFrame:
    """Run the stream over what has come to `store`/arrivals since its last run; returns digest, first (key, call, file, at), n of all digests.

    Batches write a row for each digest that they changed. n only grows and first only shrinks, so the newest state of a digest is max(n),
    min(first), also where a batch was written twice. The states are left as a snapshot, which stands for the batches before it. The
    stream's settings hold in a session of its own."""
    log, snapshots, own = f"{store}/log", f"{store}/snapshots", spark.newSession()
    for k, v in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STORE}.items():
        own.conf.set(k, v)
    stream = own.readStream.schema(f"digest string, key {key_type}, call string")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    came = stream.parquet(f"{store}/arrivals").select("digest", "key", "call", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    state = came.groupBy("digest").agg(F.min(F.struct("key", "call", "file", "at")).alias("first"), F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{store}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    types = STATE.format(key=key_type)
    done = [int(n.removeprefix("upto=")) for n in folder(spark, snapshots) if exists(spark, f"{snapshots}/{n}/_SUCCESS")]
    upto = max(done, default=-1)
    new = sorted(n for n in (int(n.removeprefix("batch=")) for n in folder(spark, log)) if n > upto)
    read = [f"{snapshots}/upto={upto}"] * bool(done) + [f"{log}/batch={n}" for n in new]
    if not read:
        return spark.createDataFrame([], types)
    if not new:
        return spark.read.schema(types).parquet(*read)
    newest = f"{snapshots}/upto={new[-1]}"
    spark.read.schema(types).parquet(*read).groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n")).write.mode("overwrite").parquet(newest)
    drop(spark, *read)
    return spark.read.schema(types).parquet(newest)


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, max_files: int | None = None, store: str | None = None, batch: str | None = None
) -> DataFrame:
    """One row per row of docs: row (all its columns as a struct), keep_id, group_size, kept, text_sha256.

    digest: any function of the text; texts stay apart even where it collides. store: a shared folder that keeps arrivals and state
    for later calls (of tables with the same columns); docs are then judged among all that came before, too. batch: a name for these docs;
    delivered again under it they are judged as they were, and count once."""
    _, placed = _placed(docs, doc_id, text, digest, max_files, store, batch)
    sha = F.col("digest") if digest is sha256 else sha256(normalised(F.col("row")[text]))
    return placed.select("row", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", sha.alias("text_sha256"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", store: str | None = None, batch: str | None = None) -> DataFrame:
    """docs without copies; same columns. What goes is named by its locator, one narrow row each."""
    arrived, placed = _placed(docs, doc_id, text, sha256, None, store, batch)
    gone, _ = written(placed.where(~F.col("kept")).select("file", "at"), "dedup-gone")
    return arrived.join(gone, ["file", "at"], "left_anti").select("row.*")


def call_name(batch: str) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()[:32]


def _arrive(rows: DataFrame, store: str, batch: str | None) -> str:
    """Write a call's rows unless its batch is there already; returns the call's name, which sorts by order of calls."""
    spark = rows.sparkSession
    calls = [n.removeprefix("call=") for n in folder(spark, f"{store}/arrivals") if n.startswith("call=")]
    batch = call_name(batch) if batch else new_path(spark, "call").rsplit("-", 1)[1]
    same = [c for c in calls if c[9:] == batch]
    call = same[0] if same else f"{max((int(c[:8]) for c in calls), default=-1) + 1:08d}-{batch}"
    at = f"{store}/arrivals/call={call}"
    if not exists(spark, f"{at}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(at)
    return call


def _hits(every: DataFrame, twice: DataFrame) -> DataFrame:
    """Rows of `every` whose digest is among `twice`, and perhaps a few others: by a filter while the digests are few enough, else by a join."""
    n = twice.count()
    if n > FILTER_MOST:
        return every.join(twice, "digest", "left_semi")
    bits = max(1 << 12, 1 << (FILTER_SHARE * n - 1).bit_length()) if n else 1 << 12
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    bit = f"int(pmod(xxhash64(digest), {bits}) % 64)"
    words = twice.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, {bit})").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words, _ = written(words, "dedup-filter")
    return every.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word").where(F.expr(f"shiftrightunsigned(bits, {bit}) & 1 = 1")).drop("word", "bits")


def _placed(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column], max_files: int | None, store: str | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """(arrivals of this call: row, digest, key, call, file, at; the same with keep_id, kept and group_size)."""
    spark = docs.sparkSession
    store = store or new_path(spark, "dedup-store")
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))  # nulls last
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), digest(normalised(F.col(text))).alias("digest"))
    call = _arrive(rows, store, batch)
    key_type = KEY.format(docs.schema[doc_id].dataType.simpleString())
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    arrived = spark.read.schema(rows.schema).parquet(f"{store}/arrivals/call={call}").select("row", "digest", "key", F.lit(call).alias("call"), *place)
    state = first_seen(spark, store, key_type, max_files)

    # hits of this call, and all rows of their digests, from whichever call
    twice, _ = written(state.where("n > 1").join(arrived.select("digest").distinct(), "digest", "left_semi").select("digest"), "dedup-hits")
    every = spark.read.schema(rows.schema.add("call", "string")).parquet(f"{store}/arrivals").select("row", "digest", "key", "call", *place)
    content = _hits(every, twice).select("digest", normalised(F.col("row")[text]).alias("body"), "key", "call", "file", "at")
    # equal texts become one row in each task before anything is shuffled; a digest with two texts left is a collision
    apart, _ = written(content.select("digest", "body").distinct().groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "dedup-collisions")

    is_first = (F.col("at") == F.col("first.at")) & (F.col("file") == F.col("first.file")) & (F.col("call") == F.col("first.call"))
    placed = hot_join(arrived, state.withColumn("group_size", F.col("n")), ["digest"]).select("row", "file", "at", F.col("first.key.id").alias("keep_id"), is_first.alias("kept"), "group_size", "digest")
    if not apart.isEmpty():
        # one digest, several texts: their rows are grouped by content instead
        split = content.join(apart, "digest", "left_semi")
        groups = split.groupBy("digest", "body").agg(F.min(F.struct("key", "call", "file", "at")).alias("own"), F.count("*").alias("own_n"))
        mine = split.where(F.col("call") == call).select("digest", "body", "file", "at").join(groups, ["digest", "body"]).select("file", "at", "own", "own_n")
        placed = placed.join(mine, ["file", "at"], "left").select(
            "row", "file", "at",
            F.when(F.col("own").isNull(), F.col("keep_id")).otherwise(F.col("own.key.id")).alias("keep_id"),
            F.coalesce((F.col("at") == F.col("own.at")) & (F.col("file") == F.col("own.file")) & (F.col("own.call") == call), "kept").alias("kept"),
            F.coalesce("own_n", "group_size").alias("group_size"),
            "digest",
        )
    return arrived, placed
