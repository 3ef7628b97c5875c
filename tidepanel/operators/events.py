"""Event windows beside series: where rows lie among them, and which intervals meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _windows(events: DataFrame, key: str) -> DataFrame:
    """Windows that have both ends, in order; others say nothing."""
    return events.where("impact_start <= impact_end").select(key, "impact_start", "impact_end")


def mark_segments(bars: DataFrame, events: DataFrame, key: str = "symbol", time: str = "session") -> DataFrame:
    """bars with segment (window starts up to this row and ends before it), ended (ends before it) and impacted (inside a window).

    A sweep: bars, starts and ends of a key are one ordered series, and running sums of starts and ends tell the rest, whatever the number
    of windows and however they overlap. One shuffle by key; windows of other keys add nothing."""
    w = _windows(events, key)
    point = lambda at, order, start, end: w.select(key, F.col(at).alias("_t"), F.lit(order).alias("_o"), F.lit(start).alias("_s"), F.lit(end).alias("_e"), F.lit(None).cast(bars.select(F.struct("*")).schema[0].dataType).alias("_row"))
    rows = bars.select(key, F.col(time).alias("_t"), F.lit(1).alias("_o"), F.lit(0).alias("_s"), F.lit(0).alias("_e"), F.struct("*").alias("_row"))
    run = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(point("impact_start", 0, 1, 0)).unionByName(point("impact_end", 2, 0, 1))
    swept = swept.withColumn("_began", F.sum("_s").over(run)).withColumn("_ended", F.sum("_e").over(run)).where("_o = 1")
    return swept.select("_row.*", (F.col("_began") + F.col("_ended")).alias("segment"), F.col("_ended").alias("ended"), (F.col("_began") > F.col("_ended")).alias("impacted"))


def crossed(rows: DataFrame, events: DataFrame, key: str, entry: str, exit_: str) -> DataFrame:
    """rows with `crossed`: whether a window of its key meets [entry, exit]; false where an end is unknown.

    Some window does if, of those that start by the exit, the latest end is not before the entry: one ordered series and a running maximum."""
    w = _windows(events, key).select(key, F.col("impact_start").alias("_t"), F.lit(0).alias("_o"), F.col("impact_end").alias("_until"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    r = rows.select(key, F.col(exit_).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast("date").alias("_until"), F.struct("*").alias("_row"))
    run = Window.partitionBy(key).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(w).withColumn("_latest", F.max("_until").over(run)).where("_o = 1")
    meets = F.coalesce((F.col("_latest") >= F.col("_row")[entry]) & F.col("_t").isNotNull(), F.lit(False))
    return out.select("_row.*", meets.alias("crossed"))


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)


def meeting_pairs(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str], right_ends: tuple[str, str], days: int = 64) -> DataFrame:
    """Pairs of rows of one key whose closed intervals of days meet, all columns of both (the key once). Both sides are laid out over buckets of so many
    days and joined by (key, bucket): a pair is compared only where it can meet, and given out in the bucket of its later start only. `days` of
    about the longer side's usual length keeps both the copies and the comparisons few."""
    lay = lambda df, ends, name: df.where(F.col(ends[0]) <= F.col(ends[1])).select(F.col(key), F.struct("*").alias(name), F.explode(F.sequence(_bucket(F.col(ends[0]), days), _bucket(F.col(ends[1]), days))).alias("_b"))
    both = lay(left, left_ends, "_l").join(lay(right, right_ends, "_r"), [key, "_b"])
    ls, le, rs, re = (F.col(side)[c] for side, ends in (("_l", left_ends), ("_r", right_ends)) for c in ends)
    both = both.where((ls <= re) & (rs <= le) & (F.col("_b") == _bucket(F.greatest(ls, rs), days)))
    return both.select("_l.*", *[F.col(f"_r.{c}") for c in right.columns if c != key])
