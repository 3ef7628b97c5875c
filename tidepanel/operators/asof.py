"""As-of joins as a union and a last-known window: one shuffle by key, no fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, facts: DataFrame, key: str, on: Column, fact_time: Column, columns: list[str], max_age_days: int | None = None) -> DataFrame:
    """Each row of left with the columns of its key's newest fact whose time is not after `on`; null if there is none, or only an older one than max_age_days.
    Facts of one time: the one that is greatest by `columns`."""
    payload = F.struct(fact_time.alias("_at"), *columns)
    kind = facts.select(payload.alias("_f")).schema["_f"].dataType
    l_side = left.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), on.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_f"))
    r_side = facts.select(F.lit(None).cast(left.select(F.struct("*").alias("_row")).schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), fact_time.alias("_t"), F.lit(0).alias("_side"), payload.alias("_f"))
    seen = Window.partitionBy("_k").orderBy("_t", "_side", "_f").rowsBetween(Window.unboundedPreceding, 0)
    out = l_side.unionAll(r_side).withColumn("_f", F.last("_f", ignorenulls=True).over(seen)).where("_side = 1")
    known = F.col("_f") if max_age_days is None else F.when(F.datediff("_t", F.col("_f._at")) <= max_age_days, F.col("_f"))
    return out.select("_row.*", *[known[c].alias(c) for c in columns])


def newest_known(days: DataFrame, facts: DataFrame, key: str, on: Column, seen: Column, order: list[str]) -> DataFrame:
    """Each row of days with the greatest fact of its key, by the columns `order`, among those seen by `on`; rows without one go.
    A running maximum over one shuffle by key, so no day meets all facts of its key."""
    best = F.struct(*order)
    kind = facts.select(best.alias("_f")).schema["_f"].dataType
    l_side = days.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), on.alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_f"))
    r_side = facts.select(F.lit(None).cast(l_side.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), seen.alias("_t"), F.lit(0).alias("_side"), best.alias("_f"))
    so_far = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l_side.unionAll(r_side).withColumn("_f", F.max("_f").over(so_far)).where("_side = 1 and _f is not null").select("_row.*", "_f.*")


def next_within(rows: DataFrame, events: DataFrame, key: str, start: Column, until: Column, at: Column) -> DataFrame:
    """Rows whose key has an event from `start` to `until`, both included: the next event looked up by a running minimum from the end."""
    l_side = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_k"), start.alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("date").alias("_e"), until.alias("_until"))
    r_side = events.select(F.lit(None).cast(l_side.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), at.alias("_t"), F.lit(1).alias("_side"), at.alias("_e"), F.lit(None).cast("date").alias("_until"))
    later = Window.partitionBy("_k").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return l_side.unionAll(r_side).withColumn("_e", F.min("_e").over(later)).where("_side = 0 and _e <= _until").select("_row.*")
