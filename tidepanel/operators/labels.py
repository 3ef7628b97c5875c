"""Forward returns, splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_return(close: Column, h: int, over) -> Column:
    """Return of the next h rows."""
    return F.lead(close, h).over(over) / close - 1


def calendar_forward_return(bars: DataFrame, h: int, key: str = "symbol", idx: str = "idx") -> Column:
    """As forward_return, null where the series' own h-th next row is not the calendar's h-th next session."""
    w = Window.partitionBy(key).orderBy(idx)
    return F.when(F.lead(idx, h).over(w) == F.col(idx) + h, F.lead("close", h).over(w) / F.col("close") - 1)


def assign_split(calendar: DataFrame, test: float, embargo: int) -> DataFrame:
    """calendar (session, idx) with split: train, embargo, test."""
    n = calendar.agg(F.count("*").alias("n"))
    start = F.floor(F.col("n") * (1 - test))
    split = F.when(F.col("idx") >= start, "test").when(F.col("idx") >= start - embargo, "embargo").otherwise("train")
    return calendar.join(F.broadcast(n)).withColumn("split", split).drop("n")


def expanding_folds(calendar: DataFrame, folds: int, embargo: int, first: float = 0.4) -> DataFrame:
    """fold, idx, role: sessions before a fold's test block less the embargo train it."""
    n = calendar.agg(F.count("*").alias("n"))
    c = calendar.join(F.broadcast(n)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    base, step = F.floor(F.col("n") * first), F.floor(F.col("n") * (1 - first) / folds)
    start = base + F.col("fold") * step
    end = F.when(F.col("fold") == folds - 1, F.col("n")).otherwise(start + step)
    role = F.when((F.col("idx") >= start) & (F.col("idx") < end), "test").when(F.col("idx") < start - embargo, "train")
    return c.withColumn("role", role).where("role is not null").select("fold", "idx", "role")


def purged_folds(calendar: DataFrame, folds: int, embargo: int) -> DataFrame:
    """fold, idx, role: test blocks in turn, training sessions at least `embargo` away on either side."""
    n = calendar.agg(F.count("*").alias("n"))
    c = calendar.join(F.broadcast(n)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = F.floor(F.col("fold") * F.col("n") / folds)
    end = F.floor((F.col("fold") + 1) * F.col("n") / folds)
    role = F.when((F.col("idx") >= start) & (F.col("idx") < end), "test").when((F.col("idx") < start - embargo) | (F.col("idx") >= end + embargo), "train")
    return c.withColumn("role", role).where("role is not null").select("fold", "idx", "role")

