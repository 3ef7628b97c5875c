"""What became of signals: entries, stops, exits, and cohorts of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import mark_segments


def _cells(bars: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame, int]:
    """(blocks of about sqrt(horizon) sessions with their bars, spans of as many blocks and those of the next span with each block's least low)."""
    size = max(8, math.isqrt(max(1, horizon) - 1) + 1)
    cell = F.struct(F.col("idx").alias("i"), "low", "open")
    low = bars.groupBy("symbol", F.expr(f"idx div {size}").alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.min("low").alias("low"))
    spans = low.withColumn("span", F.explode(F.array(F.expr(f"block div {size}"), F.expr(f"block div {size} - 1"))))
    return low.select("symbol", "block", "cells"), spans.groupBy("symbol", "span").agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("b"), "low"))).alias("blocks")), size


def first_passage(rows: DataFrame, bars: DataFrame, start: str, end: str, level: str, horizon: int) -> DataFrame:
    """rows with `hit`: (i, low, open) of the symbol's first bar after session `start` and up to `end` whose low is at or under `level`, or null.

    Minima answer for whole blocks: the rest of the start's own block is looked through, then the least lows of the blocks after it name
    the first block that gets under the level, and only that block is opened. A row meets three arrays of about sqrt(horizon), whatever
    the horizon; it is never laid out over its sessions. end - start must not exceed horizon. bars: symbol, idx, open, low."""
    blocks, spans, size = _cells(bars, horizon)
    under = lambda cells: F.get(F.filter(cells, lambda c: (c["i"] > F.col(start)) & (c["i"] <= F.col(end)) & (c["low"] <= F.col(level))), F.lit(0))
    r = rows.withColumn("_block", F.expr(f"`{start}` div {size}")).withColumn("_span", F.expr(f"`{start}` div {size} div {size}"))
    r = r.join(blocks.withColumnRenamed("block", "_block"), ["symbol", "_block"], "left").withColumn("_own", under(F.col("cells"))).drop("cells")
    later = F.filter("blocks", lambda b: (b["b"] > F.col("_block")) & (b["b"] <= F.expr(f"`{end}` div {size}")) & (b["low"] <= F.col(level)))
    r = r.join(spans.withColumnRenamed("span", "_span"), ["symbol", "_span"], "left").withColumn("_next", F.when(F.col("_own").isNull(), F.get(later, F.lit(0))["b"])).drop("blocks")
    r = r.join(blocks.withColumnRenamed("block", "_next"), ["symbol", "_next"], "left").withColumn("hit", F.coalesce("_own", under(F.col("cells"))))
    return r.select(*rows.columns, "hit")


def trade_outcomes(signals: DataFrame, bars: DataFrame, events: DataFrame, horizon: int, stop: float | Column, fee: float | Column, slippage: float | Column, last_idx: DataFrame, delay: int | Column = 1) -> DataFrame:
    """Per signal (symbol, idx, and any other columns): status, entry_idx, exit_idx, net.

    Entry at the close `delay` sessions on; from the session after it the first low at or under the stop exits at min(open, stop), else
    the close `horizon` sessions after entry does. A missing price before the exit, or an event window met before it, decides instead.
    What does not depend on the stop, the next event, the next gap and the planned exit's price, is known of every bar by windows over its
    symbol; a signal costs one look at its entry bar and the search for the stop, not `horizon` rows.
    bars: symbol, idx, session, open, low, close; events: symbol, impact_start, impact_end; last_idx: one row (last)."""
    keys = signals.columns
    col = lambda c: c if isinstance(c, Column) else F.lit(c)
    w = Window.partitionBy("symbol").orderBy("idx")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    known = mark_segments(bars.select("symbol", "idx", "session", "open", "low", "close").where("close is not null"), events)
    gap = F.when(F.coalesce(F.lead("idx").over(w) != F.col("idx") + 1, F.lit(True)), F.col("idx") + 1)
    known = known.withColumn("_gap", gap).select(
        "symbol", F.col("idx").alias("entry_idx"), F.col("close").alias("entry_price"), F.min(F.when(F.col("impacted"), F.col("idx"))).over(ahead).alias("_event"),
        F.min("_gap").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_gap"), F.when(F.lead("idx", horizon).over(w) == F.col("idx") + horizon, F.lead("close", horizon).over(w)).alias("_plan_price"),
    )
    s = signals.withColumn("entry_idx", F.col("idx") + col(delay)).withColumn("plan_idx", F.col("idx") + col(delay) + horizon).withColumn("_stop", col(stop)).withColumn("_fee", col(fee)).withColumn("_slip", col(slippage))
    x = s.join(known, ["symbol", "entry_idx"], "left").withColumn("_level", F.col("entry_price") * (1 - F.col("_stop")))
    x = first_passage(x, bars.select("symbol", "idx", "open", "low").where("low is not null"), "entry_idx", "plan_idx", "_level", horizon).join(F.broadcast(last_idx))
    # the first of the three decides; of one session the event, then the gap
    far = F.col("plan_idx") + 1
    event, missing, hit = (F.coalesce(c, far) for c in (F.col("_event"), F.col("_gap"), F.col("hit.i")))
    at = F.least(event, missing, hit, far)
    kind = F.when(at > F.col("plan_idx"), F.lit("plan")).when(event == at, "event").when(missing == at, "gap").otherwise("stop")
    x = x.withColumn("_at", F.least(at, F.col("plan_idx"))).withColumn("_kind", kind)
    status = (
        F.when(F.col("entry_price").isNull() & (F.col("entry_idx") <= F.col("last")), "missing_price")
        .when((F.col("plan_idx") > F.col("last")) & ~(F.col("entry_price").isNotNull() & (F.col("_kind") == "stop")), "immature")
        .when(F.col("_kind") == "event", "corporate_action")
        .when(F.col("_kind") == "gap", "missing_price")
        .otherwise("complete")
    )
    price = F.when(F.col("_kind") == "stop", F.least("hit.open", "_level")).otherwise(F.col("_plan_price"))
    net = price * ((1 - F.col("_fee")) * (1 - F.col("_slip"))) / (F.col("entry_price") * ((1 + F.col("_fee")) * (1 + F.col("_slip")))) - 1
    x = x.withColumn("status", status)
    done = F.col("status") == "complete"
    return x.select(*keys, "status", "entry_idx", F.when(done, F.col("_at")).alias("exit_idx"), F.when(done, net).alias("net"))


def cohorts(picks: DataFrame, bars: DataFrame, index: DataFrame, horizon: int, cost: float) -> DataFrame:
    """Per cohort date idx: members, known, status, equal-weight gross and net, index return, hit rate, worst.

    All members enter at the close of the next session and leave `horizon` later; one unknown member leaves the cohort incomplete.
    bars and index: symbol, idx, close."""
    b = bars.select("symbol", F.col("idx").alias("_i"), "close")
    e = picks.select("symbol", "idx").withColumn("_in", F.col("idx") + 1).withColumn("_out", F.col("idx") + 1 + horizon)
    x = e.join(b.select("symbol", F.col("_i").alias("_in"), F.col("close").alias("p0")), ["symbol", "_in"], "left").join(b.select("symbol", F.col("_i").alias("_out"), F.col("close").alias("p1")), ["symbol", "_out"], "left")
    x = x.withColumn("g", F.col("p1") / F.col("p0") - 1)
    g = x.groupBy("idx").agg(F.count("*").alias("members"), F.count("g").alias("known"), F.avg("g").alias("_g"), F.avg((F.col("g") > 0).cast("double")).alias("_h"), F.min("g").alias("_w"))
    i = index.select((F.col("idx") - 1).alias("idx"), F.col("close").alias("i0"))
    o = index.select((F.col("idx") - 1 - horizon).alias("idx"), F.col("close").alias("i1"))
    g = g.join(F.broadcast(i), "idx", "left").join(F.broadcast(o), "idx", "left")
    whole = F.col("members") == F.col("known")
    from ..functions.windows import net_return

    return g.select(
        "idx", "members", "known", F.when(whole, "complete").otherwise("incomplete").alias("status"),
        F.when(whole, F.col("_g")).alias("gross"), F.when(whole, net_return(F.col("_g"), cost)).alias("net"), (F.col("i1") / F.col("i0") - 1).alias("index_ret"),
        F.when(whole, F.col("_h")).alias("hit_rate"), F.when(whole, F.col("_w")).alias("worst"),
    )
