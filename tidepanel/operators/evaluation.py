"""Measures of rankings and of the portfolios they make."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import finite
from ..sources.tables import new_path
from .ranks import ranked


def rank_ic(panel: DataFrame, score: str, ret: str, keys: list[str], least: int = 2) -> DataFrame:
    """keys, n, ic: correlation of average ranks; null where either side is constant. Rows whose score or return is not a finite
    number have no rank and do not count; groups below `least` rows go."""
    known = panel.select(*keys, finite(F.col(score).cast("double")).alias(score), finite(F.col(ret).cast("double")).alias(ret)).where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    r = ranked(known, {"_a": F.col(score), "_b": F.col(ret)}, *keys, keep=())
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"), F.covar_pop("_a", "_b").alias("_c"))
    ic = F.when((F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / (F.col("_sa") * F.col("_sb")))
    return g.where(F.col("n") >= least).select(*keys, "n", ic.alias("ic"))


def top_k(panel: DataFrame, score: str, k: int, date: str = "session", key: str = "symbol", bottom: bool = False) -> DataFrame:
    """The k highest (or lowest) of each date; ties by key."""
    order = F.asc(score) if bottom else F.desc(score)
    return panel.withColumn("place", F.row_number().over(Window.partitionBy(date).orderBy(order, key))).where(F.col("place") <= k)


def indexed(series: DataFrame, date: str = "session") -> DataFrame:
    """A series of one row a date with `i` from 0; dates are few."""
    return series.withColumn("i", (F.row_number().over(Window.orderBy(date)) - 1).cast("long"))


def turnover(members: DataFrame, date: str = "session", key: str = "symbol") -> DataFrame:
    """date, i, turnover: share of members that the date before did not have; null for the first."""
    dates = indexed(members.select(date).distinct(), date)
    m = members.select(date, key).join(F.broadcast(dates), date)
    before = m.select((F.col("i") + 1).alias("i"), key).withColumn("held", F.lit(1))
    g = m.join(before, ["i", key], "left").groupBy(date, "i").agg(F.count("*").alias("size"), F.count("held").alias("kept"))
    return g.select(date, "i", F.when(F.col("i") > 0, 1 - F.col("kept") / F.col("size")).alias("turnover"))


def newey_west(series: DataFrame, value: str, date: str = "session") -> DataFrame:
    """One row: n, lags, mean, t_stat with Bartlett weights and floor(4 (n/100)^(2/9)) lags."""
    s = indexed(series.where(F.col(value).isNotNull()).select(date, F.col(value).alias("x")), date)
    stats = s.agg(F.count("*").alias("n"), F.avg("x").alias("mean")).withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))
    e = s.join(F.broadcast(stats)).select("i", "lags", (F.col("x") - F.col("mean")).alias("e"))
    far = e.select(F.col("i").alias("j"), F.col("e").alias("f"), "lags", F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("lag"))
    far = far.withColumn("i", F.col("j") + F.col("lag"))
    pairs = far.join(e.select("i", "e"), "i")
    w = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    total = pairs.agg(F.sum(w * F.col("e") * F.col("f")).alias("s"))
    return stats.join(F.broadcast(total)).select("n", "lags", "mean", F.when(F.col("s") > 0, F.col("mean") / F.sqrt(F.col("s") / F.col("n") / F.col("n"))).alias("t_stat"))


def compounded(value: Column) -> Column:
    """Total return of returns in a group."""
    return F.exp(F.sum(F.log1p(value))) - 1


def cumulative_mass(rows: DataFrame, value: str, mass: Column, *keys: str) -> DataFrame:
    """keys, value, mass, upto (mass of the group's values up to this one), total. Mass is summed by value first; the distinct values are
    then range-partitioned, written, and each partition adds up its own on top of the totals of those before it, so no group has to fit
    one task. Rows whose value or mass is unknown do not count."""
    spark = rows.sparkSession
    known = rows.select(*keys, F.col(value).alias("value"), mass.cast("double").alias("mass")).where("value is not null and mass is not null")
    summed = known.groupBy(*keys, "value").agg(F.sum("mass").alias("mass")).repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id())
    path = new_path(spark, "mass")
    summed.write.parquet(path)
    t = spark.read.schema(summed.schema).parquet(path)
    parts, by = t.groupBy(*keys, "_part").agg(F.sum("mass").alias("_own")), Window.partitionBy(*keys)
    parts = parts.select(*keys, "_part", (F.sum("_own").over(by.orderBy("_part")) - F.col("_own")).alias("_before"), F.sum("_own").over(by).alias("total"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "_part")]
    both = t.alias("t").join(parts.alias("p"), same).select("t.*", "_before", "total")
    upto = F.col("_before") + F.sum("mass").over(Window.partitionBy(*keys, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return both.select(*keys, "value", "mass", upto.alias("upto"), "total")


def weighted_quantiles(rows: DataFrame, value: str, mass: str, quantiles: dict[str, float], *keys: str) -> DataFrame:
    """keys and, by name, the least value whose cumulative mass reaches each share of the total."""
    c = cumulative_mass(rows, value, F.col(mass), *keys)
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= q * F.col("total") - 1e-12, F.col("value"))).alias(name) for name, q in quantiles.items()])


def weighted_quantile(rows: DataFrame, value: str, mass: str, q: float, *keys: str) -> DataFrame:
    """Least value whose cumulative mass reaches q of the total."""
    return weighted_quantiles(rows, value, mass, {"quantile": q}, *keys)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys, n and, by name, exact percentiles, interpolated between the two values that hold the place."""
    c = cumulative_mass(rows, value, F.lit(1), *keys)
    ends = []
    for name, q in shares.items():
        place = q * (F.col("total") - 1)
        ends += [F.min(F.when(F.col("upto") > F.floor(place), F.col("value"))).alias(f"_{name}_lo"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("value"))).alias(f"_{name}_hi")]
    g = c.groupBy(*keys).agg(F.sum("mass").cast("long").alias("n"), *ends)
    at = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return g.select(*keys, "n", *[(F.col(f"_{k}_lo") + at(q) * (F.col(f"_{k}_hi") - F.col(f"_{k}_lo"))).alias(k) for k, q in shares.items()])


def bootstrap_interval(diffs: DataFrame, value: str, draws: int, seed: int = 7) -> DataFrame:
    """mean, low, high (2.5 % and 97.5 % of resampled means). diffs: one row a date, numbered by `i` from 0."""
    n = diffs.agg(F.count("*").alias("n"))
    grid = diffs.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    picked = grid.select("draw", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.col("n")).alias("i")).join(F.broadcast(diffs.select("i", F.col(value).alias("x"))), "i")
    means = picked.groupBy("draw").agg(F.avg("x").alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return diffs.agg(F.avg(value).alias("mean")).join(F.broadcast(ends))


def _draw_weights(date: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each draw takes each date: Poisson(1) counts from a hash of (seed, date, draw), the same wherever a row of the date lies."""
    with np.errstate(over="ignore"):
        x = (date.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(draws, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    share = (x >> np.uint64(11)).astype(float) / 2.0**53
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, share, side="right").astype(float)


def bootstrap_family(diffs: DataFrame, pair: str, date: str, value: str, draws: int = 2000, level: float = 0.05, seed: int = 7) -> DataFrame:
    """Per pair of a family: n, mean, low and high (quantiles of its resampled means at level / (2 pairs) on either side), and simultaneous_low and
    _high (the mean -+ the quantile of the draws' largest deviation among all pairs, in each pair's own standard deviations).

    All pairs share the draws: a draw takes a date as often as a hash of both says, so the pairs' dependence is kept, and rows may lie
    anywhere. Tasks add up weights and weighted values of all draws; (pairs x draws) sums leave each, whatever its rows; no row is copied."""
    names = [r[0] for r in diffs.select(F.col(pair).cast("string")).distinct().orderBy(pair).collect()]  # a family is a handful
    place = {p: k for k, p in enumerate(names)}

    def sums(frames):
        total = np.zeros((len(names), draws, 2))
        for pdf in frames:
            pdf = pdf[pdf["x"].notna()]
            for name, part in pdf.groupby("pair"):
                for at in range(0, len(part), 512):
                    w = _draw_weights(part["i"].to_numpy(np.int64)[at : at + 512], draws, seed)
                    total[place[name], :, 0] += w.sum(axis=0)
                    total[place[name], :, 1] += part["x"].to_numpy(float)[at : at + 512] @ w
        p, d = np.meshgrid(np.arange(len(names)), np.arange(draws), indexing="ij")
        yield pd.DataFrame({"p": p.ravel(), "draw": d.ravel(), "w": total[..., 0].ravel(), "s": total[..., 1].ravel()})

    rows = diffs.select(F.col(pair).cast("string").alias("pair"), F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    means = rows.mapInPandas(sums, "p int, draw int, w double, s double").groupBy("p", "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    stats = rows.groupBy("pair").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    spread = means.groupBy("p").agg(F.stddev_samp("m").alias("sd"))
    key = F.create_map(*[F.lit(x) for k, p in enumerate(names) for x in (p, k)]) if names else F.create_map().cast("map<string,int>")
    stats = stats.withColumn("p", key[F.col("pair")])
    both = means.join(F.broadcast(stats.join(spread, "p").select("p", "mean", "sd")), "p")  # one row a pair
    largest = both.groupBy("draw").agg(F.max(F.abs(F.col("m") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("t")).agg(F.percentile("t", F.lit(1 - level)).alias("c"))
    tail = level / (2 * max(1, len(names)))
    ends = means.groupBy("p").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    out = stats.join(ends, "p").join(spread, "p").join(F.broadcast(largest))
    reach = F.coalesce(F.col("c") * F.col("sd"), F.lit(0.0))
    return out.select(F.col("pair"), "n", "mean", "low", "high", (F.col("mean") - reach).alias("simultaneous_low"), (F.col("mean") + reach).alias("simultaneous_high"))
