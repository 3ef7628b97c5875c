"""Filters over blocks against plain loops over whole series."""

import datetime
import math
import random

import numpy as np
import pytest

from tidepanel.operators import scans

DAY = datetime.date(2020, 1, 1)


def series(spark, sizes, seed=1):
    rng, rows = random.Random(seed), []
    for k, n in enumerate(sizes):
        price = 100.0
        for i in range(n):
            price = max(1.0, round(price + rng.choice([-1.0, 0.0, 0.5, 1.0]), 2))
            rows.append((k, i // 40 if k % 2 else 0, DAY + datetime.timedelta(i), price))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol long, segment long, trade_date date, close double").repartition(3), rows


def plain_ema(closes):
    out, fast, slow, sig, gain, loss = [], closes[0], closes[0], 0.0, None, None
    for i, c in enumerate(closes):
        fast, slow = fast + (c - fast) * 2 / 13, slow + (c - slow) * 2 / 27
        sig += (fast - slow - sig) * 2 / 10
        if i:
            up, down = max(c - closes[i - 1], 0), max(closes[i - 1] - c, 0)
            gain, loss = (up, down) if gain is None else (gain + (up - gain) / 14, loss + (down - loss) / 14)
        rsi = None if i < 14 else (100 - 100 / (1 + gain / loss)) if loss else (100.0 if gain > 0 else None)
        out.append((fast, slow, fast - slow, sig, rsi))
    return out


#: One series over many blocks, series that end with a block or a row after its start, single rows.
SIZES = [130, 1, 2, 37, 16, 60, 1, 15, 90, 3]


@pytest.mark.parametrize("block", [7, 16, 40, 1000])
def test_averages_by_a_plain_loop(spark, block):
    frame, rows = series(spark, SIZES)
    got = {(r["symbol"], r["trade_date"]): (r["ema_12"], r["ema_26"], r["macd"], r["macd_signal"], r["rsi_14"]) for r in scans.ema_macd_rsi(frame, block_rows=block).collect()}
    assert len(got) == len(rows)
    for k in range(len(SIZES)):
        mine = sorted((d, c) for s, _, d, c in rows if s == k)
        for (d, _), want in zip(mine, plain_ema([c for _, c in mine]), strict=True):
            assert got[k, d] == tuple(w if w is None else pytest.approx(w, abs=1e-8) for w in want), (k, d)


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_trend_by_a_plain_loop(spark, block):
    frame, rows = series(spark, SIZES, 2)
    got = {(r["symbol"], r["trade_date"]): (r["trend"], r["trend_score"]) for r in scans.kalman_trend(frame, block_rows=block).collect()}
    assert len(got) == len(rows)
    step, drift = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([0.01**2, 0.0001**2])
    for key in {(s, g) for s, g, _, _ in rows}:
        mine = sorted((d, c) for s, g, d, c in rows if (s, g) == key)
        x, p = np.array([math.log(mine[0][1]), 0.0]), np.eye(2)
        for d, c in mine:
            x, p = step @ x, step @ p @ step.T + drift
            gain = p[:, 0] / (p[0, 0] + 0.05**2)
            x, p = x + gain * (math.log(c) - x[0]), p - np.outer(gain, p[0])
            assert got[key[0], d] == (pytest.approx(x[1], abs=1e-9), pytest.approx(x[1] / math.sqrt(p[1, 1]), abs=1e-6))


def test_no_rows(spark):
    frame, _ = series(spark, [3])
    assert scans.ema_macd_rsi(frame.limit(0)).count() == 0 and scans.kalman_trend(frame.limit(0)).count() == 0


def test_short_series_run_side_by_side(spark):
    """Only series at the ends of a batch, and one that goes on from the block before, run by themselves; all others of a batch step at once."""
    frame, _ = series(spark, [3] * 400)
    table = scans.blocks(frame.select("symbol", "trade_date", "close"), ["symbol"], "trade_date", 100_000)

    def run(values, before, carried, goes_on):
        return {"alone": np.ones(len(values)), "rest": np.zeros(len(values)), "_next": 0}

    step = lambda now, values, n: {"alone": np.zeros(len(values))}
    got = scans.scan(table, ["symbol"], "trade_date", "close", {}, run, step, ["alone"], {"rest": 1.0}).collect()
    tasks = len({r["block"] for r in got})
    assert len(got) == 1200 and sum(r["alone"] for r in got) <= 6 * tasks and all(r["alone"] + r["rest"] == 1 for r in got)
    assert sorted(r["n"] for r in got) == [1] * 400 + [2] * 400 + [3] * 400 and all(r["k"] is None for r in got)


@pytest.mark.parametrize("batch", [5, 64, 10_000])
def test_batches_cut_series_anywhere(spark, batch):
    """Series that span batches, blocks or both, short ones and ones too long to run beside others."""
    frame, rows = series(spark, [1500, 4, 4, 1, 700, 9], 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for block in (300, 100_000):
            got = {(r["symbol"], r["trade_date"]): (r["ema_12"], r["ema_26"], r["macd"], r["macd_signal"], r["rsi_14"]) for r in scans.ema_macd_rsi(frame, block_rows=block).collect()}
            assert len(got) == len(rows)
            for k in range(6):
                mine = sorted((d, c) for s, _, d, c in rows if s == k)
                for (d, _), want in zip(mine, plain_ema([c for _, c in mine]), strict=True):
                    assert got[k, d] == tuple(w if w is None else pytest.approx(w, abs=1e-8) for w in want), (k, d)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
