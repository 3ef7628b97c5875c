"""Folders and tables that every executor can reach."""

from __future__ import annotations

import ctypes
import gc
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, exists, folder, new_path

__all__ = ["HOT", "SPACE", "WORD", "drop", "exists", "folder", "give_back", "hot_join", "labelled_sample", "new_path", "release", "sparing", "spread_join", "written"]

#: ASCII white space and what it separates; the same class everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot from this share of all rows on: fewer than HOT keys can have that many.
HOT = 10_000
#: Rows of a key below which it is not worth splitting, whatever its share.
SPREAD_ROWS = 4096


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads, and let Spark clear shuffle files that nothing refers to any more."""
    delete(spark, *paths)
    release(spark)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n", total: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key and in column n how many rows the key has; n is dropped. Keys with more than the
    HOTth part of all those rows, fewer than HOT of them, are joined by broadcast, so that none of them fills a task; the rest by shuffle, at every size alike (a small
    right is not broadcast). total: the sum of n, where it is known."""
    if total is None:
        total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(n) * HOT > total))
    rest = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(n) * HOT <= total).hint("merge"), keys)
    return left.join(hot, keys).unionByName(rest).drop(n)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, n: str = "n") -> DataFrame:
    """As hot_join where the rows of right are not small: left's rows of a key with many are dealt by a hash of column `spread` to shares, and
    right's row is copied to each share, so a share has at most SPREAD_ROWS rows, or the HOTth part of all. Only keys and numbers are broadcast, of fewer than HOT keys."""
    total = right.agg(F.sum(n)).first()[0] or 0
    share = max(SPREAD_ROWS, -(-total // HOT))
    shares = F.ceil(F.col(n) / share).cast("int")
    hot = right.where(F.col(n) > share).select(*keys, shares.alias("_shares"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_share", F.pmod(F.xxhash64(spread), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")
    copied = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), shares) - 1))).drop(n)
    return dealt.join(copied.hint("merge"), [*keys, "_share"]).drop("_share")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) to fit a model on in the driver: of at most max_rows labelled documents, those of the least hashes of their ids,
    with max_bytes of text in all. A text that no longer fits is passed over; those after it still count. Null labels and ids do not count, of
    repeated ids the least text and the largest label do. docs: doc_id, text; labels: doc_id and the label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) != 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # so few rows that every task may have them
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows, path = written(rows, "labelled")
    room, taken = max_bytes, []
    for r in rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r["doc_id"],))
    if not taken:
        warnings.warn(f"no labelled text to learn {label} from", stacklevel=2)
        drop(docs.sparkSession, path)
        return [], []
    ids = docs.sparkSession.createDataFrame(taken, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    out = rows.join(F.broadcast(ids), "doc_id").orderBy("doc_id").collect()
    drop(docs.sparkSession, path)
    return [r["text"] for r in out], [r["label"] for r in out]


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the machine: workers outlive their tasks, and what one stage took would
    stand beside the needs of the next. Does nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sparing(run):
    """A function of Arrow batches that gives its memory back when it has seen them all."""

    def kept(batches):
        yield from run(batches)
        give_back()

    return kept


def release(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()
