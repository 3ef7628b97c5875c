"""Average ranks within groups of any size.

Rows are range-partitioned by group and value into parts of a bounded number of rows and written with their place in the part, its mean over
rows of one value. One row a group and part tells where the group begins there and how many of its known rows lie in parts before; adding
those gives the rank by native expressions. So a task holds one part, whatever the size of a group; only rows that share one value of one
group stay together, and the window over them spills."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import finite
from ..sources.tables import written

#: Rows of a part.
PART_ROWS = 250_000


def _ordered(x: pd.Series) -> pd.Series:
    """Whole numbers in the order of the finite numbers x; range partitions and windows agree on those, while windows put a float in a normal form first."""
    bits = (x.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _placed(kept: DataFrame, key: str, name: str, keys: tuple[str, ...], parts: int) -> DataFrame:
    """kept with `name` (average rank of the whole number `key`, ascending, within keys) and n_name (rows that have one), without `key`."""
    dealt = kept.repartitionByRange(parts, *keys, key).sortWithinPartitions(*keys, key).withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    t = written(dealt.withColumn("_mean", F.avg("_at").over(Window.partitionBy(*keys, key))), "rank-parts")
    groups, by = t.groupBy(*keys, "_part").agg(F.min(F.when(F.col(key).isNotNull(), F.col("_at"))).alias("_from"), F.count(key).alias("_own")), Window.partitionBy(*keys)
    groups = groups.select(*keys, "_part", "_from", (F.sum("_own").over(by.orderBy("_part")) - F.col("_own")).alias("_before"), F.sum("_own").over(by).alias(f"n_{name}"))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in (*keys, "_part")]
    both = t.alias("t").join(F.broadcast(groups.alias("g")), same)  # one row a group and part
    rank = F.when(F.col(f"t.{key}").isNotNull(), F.col("_before") + (F.col("_mean") - F.col("_from")) + 1)
    return both.select(*[f"t.{c}" for c in kept.columns if c != key], rank.alias(name), f"n_{name}")


def ranked(rows: DataFrame, values: dict[str, Column], *keys: str, keep: tuple[str, ...] | None = None, descending: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """rows (or their columns `keep` and the keys) with, by name, the average rank of each value within keys and n_<name>, how many rows within keys
    have one; highest first for names in `descending`. What is unknown (null, or not a finite number) has no rank and takes no place."""
    number, ordered = {}, F.pandas_udf(_ordered, "long")
    for name, x in values.items():
        x = finite(x.cast("double"))
        whole = ordered(F.coalesce(x, F.lit(0.0)))
        number[name] = F.when(x.isNotNull(), F.bitwise_not(whole) if name in descending else whole)
    columns = rows.columns if keep is None else [*keys, *[c for c in keep if c not in keys]]
    kept = written(rows.select(*columns, *[x.alias(f"_v_{name}") for name, x in number.items()]), "rank-rows")
    n = kept.count()
    parts = max(-(-n // part_rows), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000 + 1))
    for name in values:
        kept = _placed(kept, f"_v_{name}", name, keys, parts)
    return kept
