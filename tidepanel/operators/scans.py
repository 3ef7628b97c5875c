"""Recursive filters over long series as a parallel scan.

Rows are range-partitioned by series and time into blocks and written. One row a block tells where its first series began, so every block
knows whether it goes on with the series of the block before, after how many rows, and from which last value. Each block then runs the
filter on its own, a series that goes on from zero: the filters are linear in their state, so a row's true state is its own plus a known
matrix times the state at the block's start. Those states follow from one row a block, block after block, in the driver (their number is
that of the blocks, not of series or rows), and are added by native expressions. No series has to fit one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a block.
BLOCK_ROWS = 250_000


def blocks(rows: DataFrame, keys: list[str], order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `block` and `at` (place in the block), as a table: series after series, in order."""
    spark = rows.sparkSession
    kept = written(rows, "scan-rows")
    n = kept.count()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000 + 1)
    ranged = kept.repartitionByRange(max(spread, -(-n // block_rows), 1), *keys, order).sortWithinPartitions(*keys, order)
    place = F.monotonically_increasing_id()
    return written(ranged.withColumn("_id", place).withColumn("block", F.shiftright("_id", 33).cast("int")).withColumn("at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "scan-blocks")


def beginnings(table: DataFrame, keys: list[str], value: str) -> dict[int, tuple[int, float]]:
    """Of each block whose first series began in an earlier one: how many of its rows came before, and the value of the last of them."""
    runs = table.groupBy("block", *keys).agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max_by(value, "at").alias("last"))
    ends = F.struct(F.struct(*keys).alias("key"), "n", "last")
    rows = runs.groupBy("block").agg(F.min_by(ends, "at").alias("head"), F.max_by(ends, "at").alias("tail")).orderBy("block").collect()  # one row a block
    out, key, n, last = {}, None, 0, 0.0
    for r in rows:
        if r["head"]["key"] == key:
            out[r["block"]] = (n, last)
            n = n + r["head"]["n"] if r["tail"]["key"] == key else r["tail"]["n"]
        else:
            n = r["tail"]["n"]
        key, last = r["tail"]["key"], r["tail"]["last"]
    return out


#: Longer series than this run by themselves; shorter ones of a batch run side by side, row by row of all of them at once.
SIDE_BY_SIDE = 1024


def beside(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: Callable[[dict | None, np.ndarray, int], dict], state: list[str], out: dict[str, np.ndarray]) -> None:
    """Run many whole series at once and put their states into `out`. step(state, value, n) makes row n of series from their state at the row before (None at n = 1)."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, now = starts[order], sizes[order], None
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left") if len(sizes) else []  # series that have a row of each number
    for k, m in enumerate(running):
        at = starts[:m] + k
        now = step(now and {s: x[:m] for s, x in now.items()}, values[at], k + 1)
        for s in state:
            out[s][at] = now[s]


def scan(table: DataFrame, keys: list[str], time: str, value: str, start: dict[int, tuple[int, float]], run: Callable, step: Callable, state: list[str], rest: dict[str, float] | None = None) -> DataFrame:
    """Local filters of all blocks: keys, time, block, at, n (row of the series, from 1), k (row of the block if its first series goes on, else null),
    the state columns, and those of `rest`, which hold its values in series that began in the block. run(values, before, carried, goes_on) gives those
    columns of some consecutive rows of a series as a dict; before: (rows that came before, the last value or None); carried: what run() gave as
    "_next" for the rows just before, None at a start. step: as `beside` takes it, for series that lie whole in a batch, where run() would cost more
    for a series than for its rows."""
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    rest = rest or {}
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, time)] + ["block int, at long, n long, k long", *[f"{s} double" for s in (*state, *rest)]])

    def local(frames):
        now, n, goes_on, first, carried = None, 0, False, 0, None
        for pdf in frames:
            if not len(pdf):
                continue
            ids = pdf[["block", *keys]]
            before = ids.shift()
            starts = np.flatnonzero(((ids != before) & ~(ids.isna() & before.isna())).any(axis=1).to_numpy() | (np.arange(len(pdf)) == 0))
            sizes = np.diff(starts, append=len(pdf))
            blocks, values = pdf["block"].to_numpy(), pdf[value].to_numpy(float)
            out = {s: np.empty(len(pdf)) for s in state} | {s: np.full(len(pdf), x) for s, x in rest.items()}
            place = np.arange(len(pdf)) - np.repeat(starts, sizes) + 1
            begun = np.zeros(len(pdf), np.int64)  # rows of the series before the block, where it goes on
            known = np.zeros(len(pdf), bool)
            opens = np.fromiter((b in start for b in blocks[starts]), bool, len(starts)) & (pdf["at"].to_numpy()[starts] == 0)
            alone = opens | (sizes > SIDE_BY_SIDE)
            alone[[0, -1]] = True  # these may come from the batch before, or go on in the next one
            beside(values, starts[~alone], sizes[~alone], step, state, out)
            for j in np.flatnonzero(alone):
                here, span = tuple(None if pd.isna(x) else x for x in ids.iloc[starts[j]]), slice(starts[j], starts[j] + sizes[j])
                last = None
                if here != now:
                    goes_on = bool(opens[j])
                    first, last = start[here[0]] if goes_on else (0, None)
                    now, n, carried = here, first, None
                made = run(values[span], (n, last), carried, goes_on)
                carried = made.pop("_next")
                for s, x in made.items():
                    out[s][span] = x
                place[span] += n
                begun[span], known[span] = first, goes_on
                n += sizes[j]
            k = pd.arrays.IntegerArray(place - begun, ~known)
            yield pdf[[*keys, time, "block", "at"]].assign(n=place, k=k, **out)

    dealt = table.repartition("block").sortWithinPartitions("block", "at").select(*keys, time, "block", "at", value)
    return written(dealt.mapInPandas(local, schema), "scan-local")


def carries(local: DataFrame, state: list[str], start: dict[int, tuple[int, float]], carry_over: Callable[[dict, dict], dict], extra: tuple[str, ...] = ()) -> DataFrame | None:
    """block, and the state at its start (columns c_...), of blocks that go on. carry_over(end, carry): the true state at the end of a block's first series."""
    if not start:
        return None
    cols = F.struct("n", "k", *state, *extra)
    rows = local.groupBy("block").agg(F.max_by(cols, F.when(F.col("k").isNotNull(), F.col("at"))).alias("head"), F.max_by(cols, "at").alias("tail")).orderBy("block").collect()  # one row a block
    out, true = [], None
    for r in rows:
        tail = r["tail"].asDict()
        if r["block"] in start:
            out.append((r["block"], *[true[s] for s in state]))
            if tail["k"] is not None:  # the whole block is one series that goes on
                true = carry_over(r["head"].asDict(), true)
                continue
        true = {s: tail[s] for s in state}
    return local.sparkSession.createDataFrame([(b, *[float(x) for x in xs]) for b, *xs in out], ", ".join(["block int", *[f"c_{s} double" for s in state]]))


def with_carries(local: DataFrame, carry: DataFrame | None, state: list[str]) -> DataFrame:
    """local with columns c_...: the state at the start of the row's block, 0 where nothing is carried."""
    if carry is None:
        return local.select("*", *[F.lit(0.0).alias(f"c_{s}") for s in state])
    joined = local.join(F.broadcast(carry), "block", "left")  # one row a block
    mine = F.col("k").isNotNull()
    for s in state:
        joined = joined.withColumn(f"c_{s}", F.when(mine, F.coalesce(f"c_{s}", F.lit(0.0))).otherwise(0.0))
    return joined


# exponential averages, MACD and RSI


def _decayed(x: np.ndarray, alpha: float, before: float) -> np.ndarray:
    return pd.Series(np.append(before, x)).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


FAST, SLOW, SIGNAL, WILDER = 2 / 13, 2 / 27, 2 / 10, 1 / 14
EMA_STATE = ["fast", "slow", "signal", "gain", "loss"]


def _ema_run(close: np.ndarray, before: tuple[int, float | None], carried: dict | None, goes_on: bool) -> dict:
    n, last = before
    if carried is None:
        level = 0.0 if goes_on else close[0]
        carried = {"fast": level, "slow": level, "signal": 0.0, "gain": 0.0 if n > 1 else None, "loss": 0.0 if n > 1 else None, "last": last}
    fast, slow = _decayed(close, FAST, carried["fast"]), _decayed(close, SLOW, carried["slow"])
    signal = _decayed(fast - slow, SIGNAL, carried["signal"])
    move = np.diff(close, prepend=close[0] if carried["last"] is None else carried["last"])
    out = {"fast": fast, "slow": slow, "signal": signal}
    for name, x in (("gain", np.maximum(move, 0)), ("loss", np.maximum(-move, 0))):
        state = carried[name]
        if state is None and carried["last"] is None:  # a series' first row has no move; its second one starts the average
            out[name] = np.append(0.0, _decayed(x[1:], WILDER, x[1])) if len(x) > 1 else np.zeros(1)
            carried[name] = None if len(x) == 1 else 0.0
        else:
            out[name] = _decayed(x, WILDER, x[0] if state is None else state)
            carried[name] = 0.0
    nxt = {s: float(out[s][-1]) for s in EMA_STATE} | {"last": float(close[-1])}
    return out | {"_next": nxt | {s: None for s in ("gain", "loss") if carried[s] is None}}


def _ema_step(now: dict | None, close: np.ndarray, n: int) -> dict:
    if now is None:
        zero = np.zeros(len(close))
        return {"fast": close, "slow": close, "signal": zero, "gain": zero, "loss": zero, "last": close}
    out, move = {"last": close}, close - now["last"]
    for s, rate in (("fast", FAST), ("slow", SLOW)):
        out[s] = now[s] + (close - now[s]) * rate
    out["signal"] = now["signal"] + (out["fast"] - out["slow"] - now["signal"]) * SIGNAL
    for s, x in (("gain", np.maximum(move, 0)), ("loss", np.maximum(-move, 0))):
        out[s] = x if n == 2 else now[s] + (x - now[s]) * WILDER
    return out


def _response(rate: float, k: Column) -> Column:
    """What k rows make of a unit in an average that decays by `rate`, in the average over it that is the signal."""
    keep = 1 - SIGNAL
    return SIGNAL * rate * (F.pow(F.lit(rate), k) - F.pow(F.lit(keep), k)) / (rate - keep)


def ema_macd_rsi(bars: DataFrame, key: str = "symbol", time: str = "trade_date", close: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Averages start at the first bar; RSI is known from bar 15, 100 without a loss, null where nothing moved."""
    table = blocks(bars.select(key, time, F.col(close).cast("double").alias("close")).where("close is not null"), [key], time, block_rows)
    start = beginnings(table, [key], "close")
    local = scan(table, [key], time, "close", start, _ema_run, _ema_step, EMA_STATE)
    keep = {"fast": 1 - FAST, "slow": 1 - SLOW, "signal": 1 - SIGNAL, "gain": 1 - WILDER, "loss": 1 - WILDER}

    def carry_over(end: dict, carry: dict) -> dict:
        k = end["k"]
        true = {s: end[s] + keep[s] ** k * carry[s] for s in EMA_STATE}
        q = keep["signal"]
        for s, sign in (("fast", 1), ("slow", -1)):
            true["signal"] += sign * carry[s] * SIGNAL * keep[s] * (keep[s] ** k - q**k) / (keep[s] - q)
        if end["n"] - k == 1:  # the averages of moves began in this block
            true |= {s: end[s] for s in ("gain", "loss")}
        return true

    x = with_carries(local, carries(local, EMA_STATE, start, carry_over), EMA_STATE)
    k = F.coalesce("k", F.lit(0)).cast("double")
    term = {s: F.col(s) + F.pow(F.lit(keep[s]), k) * F.col(f"c_{s}") for s in EMA_STATE}
    signal = term["signal"] + F.col("c_fast") * _response(keep["fast"], k) - F.col("c_slow") * _response(keep["slow"], k)
    began = (F.col("n") - F.coalesce("k", F.lit(0))) == 1
    gain, loss = (F.when(began, F.col(s)).otherwise(term[s]) for s in ("gain", "loss"))
    rsi = F.when(loss != 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0)
    return x.select(key, time, term["fast"].alias("ema_12"), term["slow"].alias("ema_26"), (term["fast"] - term["slow"]).alias("macd"), signal.alias("macd_signal"), F.when(F.col("n") >= 15, rsi).alias("rsi_14"))


# local linear trend


def trend_gains(level: float, slope: float, noise: float, most: int = 20_000) -> np.ndarray:
    """Of row n = 1, 2, ... of any series: both gains and the slope's variance. They do not depend on the data, and stand still from some row on; the
    last row of the table holds for all later ones."""
    p, out = np.eye(2), []
    step, drift = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([level**2, slope**2])
    while len(out) < most:
        p = step @ p @ step.T + drift
        gain = p[:, 0] / (p[0, 0] + noise**2)
        p = p - np.outer(gain, p[0])
        out.append((gain[0], gain[1], p[1, 1]))
        if len(out) > 1 and max(abs(a - b) for a, b in zip(out[-1], out[-2], strict=True)) < 1e-17:
            break
    return np.array(out)


TREND_STATE = ["x", "v"]
TREND_MAP = ["xx", "xv", "vx", "vv"]


def kalman_trend(bars: DataFrame, level: float = 0.01, slope: float = 0.0001, noise: float = 0.05, key: str = "symbol", part: str = "segment", time: str = "trade_date", close: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Local linear trend filter of log closes per (symbol, segment): filtered slope and its standard score. The state is (level, slope); what a
    row makes of the state at its block's start is a 2x2 map, kept beside it where a series goes on."""
    table = blocks(bars.select(key, part, time, F.log(close).alias("y")).where("y is not null"), [key, part], time, block_rows)
    start, gains = beginnings(table, [key, part], "y"), trend_gains(level, slope, noise)

    def run(y: np.ndarray, before: tuple[int, float | None], carried: tuple | None, goes_on: bool) -> dict:
        n, _ = before
        (x, v), m = carried or (((0.0, 0.0) if goes_on else (float(y[0]), 0.0)), (1.0, 0.0, 0.0, 1.0))
        out = np.empty((len(y), 6))
        for k, value in enumerate(y.tolist()):
            a, b, _ = gains[min(n + k, len(gains) - 1)]
            x, v = (1 - a) * (x + v) + a * value, v + b * (value - x - v)
            if goes_on:
                top, low = (m[0] + m[2], m[1] + m[3]), m[2:]
                m = ((1 - a) * top[0], (1 - a) * top[1], low[0] - b * top[0], low[1] - b * top[1])
            out[k] = x, v, *m
        cols = dict(zip(TREND_STATE + TREND_MAP, out.T, strict=True))
        return cols | {"_next": ((x, v), m)}

    def step(now: dict | None, y: np.ndarray, n: int) -> dict:
        (a, b, _), x, v = gains[min(n, len(gains)) - 1], *((now["x"], now["v"]) if now else (y, np.zeros(len(y))))
        return {"x": (1 - a) * (x + v) + a * y, "v": v + b * (y - x - v)}

    local = scan(table, [key, part], time, "y", start, run, step, TREND_STATE, dict(zip(TREND_MAP, (1.0, 0.0, 0.0, 1.0), strict=True)))

    def carry_over(end: dict, carry: dict) -> dict:
        return {"x": end["x"] + end["xx"] * carry["x"] + end["xv"] * carry["v"], "v": end["v"] + end["vx"] * carry["x"] + end["vv"] * carry["v"]}

    x = with_carries(local, carries(local, TREND_STATE, start, carry_over, tuple(TREND_MAP)), TREND_STATE)
    trend = F.col("v") + F.when(F.col("k").isNotNull(), F.col("vx") * F.col("c_x") + F.col("vv") * F.col("c_v")).otherwise(0.0)
    spread = local.sparkSession.createDataFrame([(k + 1, float(g[2])) for k, g in enumerate(gains)], "_row int, _var double")  # as many rows as gains
    x = x.withColumn("_row", F.least("n", F.lit(len(gains))).cast("int")).join(F.broadcast(spread), "_row")
    return x.select(key, part, time, trend.alias("trend"), (trend / F.sqrt("_var")).alias("trend_score"))
