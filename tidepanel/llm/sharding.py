"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are ordered by doc_id (then by content and arrival, so that repeated rows have a place too) and stay contiguous: shard k
holds the rows whose middle byte lies in the k-th of n equal parts. Only (id, size, checksum) is shuffled, once, by range.
Null texts have no bytes; null ids come first. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, written

#: Bytes that each row takes besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, rows_per_part: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. rows_per_part: rows that one task orders and sums."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow, narrow_at = written(
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("at")),
        "shard-sizes",
    )
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-narrow.count() // rows_per_part))
    order = ["doc_id", "text_crc32", "size", "at"]
    # a written table, so that every later read sees the same cut into parts
    ranged, ranged_at = written(narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-parts")
    drop(spark, narrow_at)

    # one row a part: bounded by `parts`, so its running sums may run in one task and be sent to all
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.select(
        *[c for c in ranged.columns],
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("own_before"),
        (F.row_number().over(inside) - 1).alias("own_row"),
    ).join(F.broadcast(sums), "part")
    cut, _ = written(
        placed.select(
            "doc_id", "size", "text_crc32",
            F.expr(f"int(least({shards - 1}, ((bytes_before + own_before) * 2 + size) * {shards} div (2 * all_bytes)))").alias("shard"),
            (F.col("rows_before") + F.col("own_row")).alias("row"),
        ),
        "shard-rows",
    )
    drop(spark, ranged_at)
    first = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most `shards` rows
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
