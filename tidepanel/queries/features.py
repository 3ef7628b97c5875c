"""Indicators, time-series features, cross-sections and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import change, need, r4, r6, ratio, rows, series, rnd
from ..operators import indicators as ind
from ..operators import labels as lab
from ..operators.ranks import ranked
from ..operators.events import crossed, mark_segments, meeting_pairs
from ..plans import views as v
from .registry import query

D, S = DataFrame, SparkSession


def wd():
    return series()


def ws():
    return series("session")


def wx():
    return series("idx")


_W = "WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"


def _need(n: int, agg: str, x: str, t: str = "trade_date", least: int | None = None) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY {t} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg}({x}) {frame} END"


@query("sma", f"SELECT symbol, trade_date, round({_need(20, 'avg', 'close')}, 4) AS sma_20, round({_need(50, 'avg', 'close')}, 4) AS sma_50, round({_need(200, 'avg', 'close')}, 4) AS sma_200 FROM bars_d", ("bars_d",))
def sma(spark: S, d: str) -> D:
    return v.bars_d(spark, d).select("symbol", "trade_date", *[r4(need(n, F.col("close"), F.avg, wd())).alias(f"sma_{n}") for n in (20, 50, 200)])


@query("ema_macd_rsi", """WITH RECURSIVE b AS (SELECT symbol, trade_date, close, row_number() OVER w AS n, close - lag(close) OVER w AS m FROM bars_d WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  e AS (SELECT symbol, n, close AS a, close AS b, 0.0::DOUBLE AS s, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM b WHERE n = 1
    UNION ALL SELECT b.symbol, b.n, e.a + (b.close - e.a) * 2 / 13, e.b + (b.close - e.b) * 2 / 27,
      e.s + ((e.a + (b.close - e.a) * 2 / 13) - (e.b + (b.close - e.b) * 2 / 27) - e.s) * 2 / 10,
      CASE WHEN e.g IS NULL THEN greatest(b.m, 0) ELSE e.g + (greatest(b.m, 0) - e.g) / 14 END, CASE WHEN e.l IS NULL THEN greatest(-b.m, 0) ELSE e.l + (greatest(-b.m, 0) - e.l) / 14 END
    FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1)
  SELECT b.symbol, trade_date, round(e.a, 4) AS ema_12, round(e.b, 4) AS ema_26, round(e.a - e.b, 4) AS macd, round(e.s, 4) AS macd_signal,
    CASE WHEN b.n >= 15 THEN round(CASE WHEN e.l = 0 THEN CASE WHEN e.g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + e.g / e.l) END, 4) END AS rsi_14 FROM b JOIN e ON b.symbol = e.symbol AND b.n = e.n""", ("bars_d",))
def ema_macd_rsi(spark: S, d: str) -> D:
    out = ind.ema_macd_rsi(v.bars_d(spark, d))
    return out.select("symbol", "trade_date", *[r4(F.col(c)).alias(c) for c in ("ema_12", "ema_26", "macd", "macd_signal", "rsi_14")])


@query("kalman_trend")
def kalman_trend(spark: S, d: str) -> D:
    s = mark_segments(v.bars_w(spark, d), v.ledger(spark, d)).withColumnRenamed("session", "trade_date")
    return ind.kalman_trend(s).drop("segment")


_RET = "SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS r FROM bars_d"


@query("volatility", f"WITH x AS ({_RET}) SELECT symbol, trade_date, round({_need(20, 'stddev_samp', 'r')}, 6) AS vol_20 FROM x", ("bars_d",))
def volatility(spark: S, d: str) -> D:
    b = v.bars_d(spark, d).withColumn("r", change(F.col("close"), 1, wd()))
    return b.select("symbol", "trade_date", r6(need(20, F.col("r"), F.stddev_samp, wd())).alias("vol_20"))


@query("volume_ratio", f"WITH x AS (SELECT *, {_need(20, 'avg', 'volume')} AS m FROM bars_d) SELECT symbol, trade_date, round(m, 4) AS avg_volume_20, CASE WHEN m <> 0 THEN round(volume / m, 6) END AS volume_ratio FROM x", ("bars_d",))
def volume_ratio(spark: S, d: str) -> D:
    m = need(20, F.col("volume"), F.avg, wd())
    return v.bars_d(spark, d).withColumn("m", m).select("symbol", "trade_date", r4(F.col("m")).alias("avg_volume_20"), r6(ratio(F.col("volume"), F.col("m"))).alias("volume_ratio"))


@query("distance_52w", f"SELECT symbol, trade_date, round(close / max(close) OVER x - 1, 6) AS from_high, round(close / min(close) OVER x - 1, 6) AS from_low FROM bars_d WINDOW x AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", ("bars_d",))
def distance_52w(spark: S, d: str) -> D:
    w, c = rows(252, wd()), F.col("close")
    return v.bars_d(spark, d).select("symbol", "trade_date", r6(c / F.max(c).over(w) - 1).alias("from_high"), r6(c / F.min(c).over(w) - 1).alias("from_low"))


def _mom(n: int, name: str) -> str:
    return f"round(close / lag(close, {n}) OVER w - 1, 6) AS {name}"


@query("momentum", f"SELECT symbol, trade_date, {_mom(21, 'mom_1m')}, {_mom(63, 'mom_3m')}, {_mom(126, 'mom_6m')} FROM bars_d {_W}", ("bars_d",))
def momentum(spark: S, d: str) -> D:
    return v.bars_d(spark, d).select("symbol", "trade_date", *[r6(change(F.col("close"), n, wd())).alias(a) for n, a in ((21, "mom_1m"), (63, "mom_3m"), (126, "mom_6m"))])


@query("ts_features", f"""WITH x AS (SELECT *, close / lag(close) OVER w - 1 AS r, abs(close / lag(close) OVER w - 1) / (close * volume) AS ill FROM bars_d {_W})
  SELECT symbol, trade_date, round(-(close / lag(close, 5) OVER w - 1), 6) AS reversal_5, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) AS mom_12_1,
    round({_need(5, 'avg', 'volume')} / {_need(60, 'avg', 'volume')}, 6) AS volume_trend, round({_need(21, 'max', 'r')}, 6) AS max_ret_21, round(ln({_need(21, 'avg', 'ill')} * 1e9 + 1e-12), 6) AS illiquidity FROM x {_W}""", ("bars_d",))
def ts_features(spark: S, d: str) -> D:
    c, vol = F.col("close"), F.col("volume")
    b = v.bars_d(spark, d).withColumn("r", change(c, 1, wd())).withColumn("ill", F.abs("r") / (c * vol))
    return b.select(
        "symbol", "trade_date",
        r6(-change(c, 5, wd())).alias("reversal_5"),
        r6(F.lag(c, 21).over(wd()) / F.lag(c, 252).over(wd()) - 1).alias("mom_12_1"),
        r6(need(5, vol, F.avg, wd()) / need(60, vol, F.avg, wd())).alias("volume_trend"),
        r6(need(21, F.col("r"), F.max, wd())).alias("max_ret_21"),
        r6(F.log(need(21, F.col("ill"), F.avg, wd()) * 1e9 + 1e-12)).alias("illiquidity"),
    )


@query("rolling_beta", """WITH i AS (SELECT session, close / lag(close) OVER (ORDER BY session) - 1 AS m FROM index_w),
  x AS (SELECT symbol, session, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS r, m FROM bars_w JOIN i USING (session)),
  y AS (SELECT *, CASE WHEN count(r) OVER f >= 60 AND var_samp(m) OVER f <> 0 THEN covar_samp(r, m) OVER f / var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER f END AS beta FROM x WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)),
  z AS (SELECT *, r - beta * m AS e FROM y)
  SELECT symbol, session, round(beta, 6) AS beta, CASE WHEN count(e) OVER f >= 20 THEN round(stddev_samp(e) OVER f, 6) END AS idio_vol FROM z WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", ("bars_w", "index_w"))
def rolling_beta(spark: S, d: str) -> D:
    i = v.index_w(spark, d).select("session", change(F.col("close"), 1, ws()).alias("m"))  # one row a session
    x = v.bars_w(spark, d).join(F.broadcast(i), "session").withColumn("r", change(F.col("close"), 1, ws()))
    f = rows(120, ws())
    known = F.when(F.col("r").isNotNull(), F.col("m"))
    y = x.withColumn("beta", F.when((F.count("r").over(f) >= 60) & (F.var_samp("m").over(f) != 0), F.covar_samp("r", "m").over(f) / F.var_samp(known).over(f)))
    z = y.withColumn("e", F.col("r") - F.col("beta") * F.col("m"))
    return z.select("symbol", "session", r6(F.col("beta")).alias("beta"), r6(need(20, F.col("e"), F.stddev_samp, ws())).alias("idio_vol"))


@query("derived_features", f"""WITH x AS (SELECT symbol, trade_date, close, {_need(20, 'avg', 'close')} AS s20, {_need(50, 'avg', 'close')} AS s50 FROM bars_d)
  SELECT symbol, trade_date, round(close / s20 - 1, 6) AS price_to_sma_20, round(close / s50 - 1, 6) AS price_to_sma_50, round(s20 / s50 - 1, 6) AS trend FROM x""", ("bars_d",))
def derived_features(spark: S, d: str) -> D:
    c = F.col("close")
    b = v.bars_d(spark, d).withColumn("s20", need(20, c, F.avg, wd())).withColumn("s50", need(50, c, F.avg, wd()))
    return b.select("symbol", "trade_date", r6(ratio(c, F.col("s20")) - 1).alias("price_to_sma_20"), r6(ratio(c, F.col("s50")) - 1).alias("price_to_sma_50"), r6(ratio(F.col("s20"), F.col("s50")) - 1).alias("trend"))


# cross-sections of the scored panel


def by():
    return Window.partitionBy("session")


@query("sector_relative", "SELECT symbol, session, round(score - avg(score) OVER (PARTITION BY session, industry), 6) AS rel_momentum FROM panel_w", ("panel_w",))
def sector_relative(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", r6(F.col("score") - F.avg("score").over(Window.partitionBy("session", "industry"))).alias("rel_momentum"))


_WINSOR = """q AS (SELECT session, quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi, count(*) AS n FROM panel_w GROUP BY 1),
  c AS (SELECT symbol, session, industry, CASE WHEN n >= 2 THEN least(greatest(score, lo), hi) ELSE score END AS x FROM panel_w JOIN q USING (session))"""
_Z = "CASE WHEN stddev_pop(x) OVER s < 1e-12 THEN 0.0 ELSE (x - avg(x) OVER s) / stddev_pop(x) OVER s END"


def winsorized(p: D, column: str, *keys: str) -> D:
    """p with column clipped to its 1 % and 99 % quantiles by keys, where there are two values or more."""
    q = p.groupBy(*keys).agg(F.percentile(column, F.lit(0.01)).alias("_lo"), F.percentile(column, F.lit(0.99)).alias("_hi"), F.count(column).alias("_n"))
    x = F.when(F.col("_n") >= 2, F.least(F.greatest(F.col(column), F.col("_lo")), F.col("_hi"))).otherwise(F.col(column))
    return p.join(q, list(keys)).withColumn(column, x).drop("_lo", "_hi", "_n")


def zscore(column: str, over) -> F.Column:
    x, s = F.col(column), F.stddev_pop(column).over(over)
    return F.when(s < 1e-12, 0.0).otherwise((x - F.avg(x).over(over)) / s)


@query("winsor_zscore", f"WITH {_WINSOR} SELECT symbol, session, round({_Z}, 6) AS z FROM c WINDOW s AS (PARTITION BY session)", ("panel_w",))
def winsor_zscore(spark: S, d: str) -> D:
    return winsorized(v.panel_w(spark, d), "score", "session").select("symbol", "session", r6(zscore("score", by())).alias("z"))


_AVG_RANK = "(rank() OVER (PARTITION BY session ORDER BY {x}) + (count(*) OVER (PARTITION BY session, {x}) - 1) / 2.0)"


@query("rank_normalize", f"SELECT symbol, session, round({_AVG_RANK.format(x='score')} / count(*) OVER (PARTITION BY session) - 0.5, 6) AS r FROM panel_w", ("panel_w",))
def rank_normalize(spark: S, d: str) -> D:
    r = ranked(v.panel_w(spark, d).select("symbol", "session", "score"), {"place": F.col("score")}, "session", keep=("symbol",))
    return r.select("symbol", "session", r6(F.col("place") / F.col("n_place") - 0.5).alias("r"))


def _gappy(column: str, shift: int = 0) -> F.Column:
    """The column with some values unknown, in each of the ways that are met."""
    key = F.col("symbol") + shift
    return F.when(key % 7 == 0, None).when(key % 7 == 1, float("nan")).when(key % 13 == 2, float("inf")).when(key % 13 == 3, float("-inf")).otherwise(F.floor(F.col(column) * 20) / 20)


_GAPPY = "CASE WHEN symbol % 7 = 0 OR symbol % 7 = 1 OR symbol % 13 = 2 OR symbol % 13 = 3 THEN NULL ELSE floor({0} * 20) / 20 END AS {0}"


@query("rank_unknowns", f"""WITH g AS (SELECT symbol, session, {_GAPPY.format('score')}, {_GAPPY.format('vol').replace('symbol', '(symbol + 2)')}, {_GAPPY.format('ret').replace('symbol', '(symbol + 1)')} FROM panel_w),
  k AS (SELECT *, count(score) OVER s AS ns, count(ret) OVER s AS nr, count(vol) OVER s AS nv,
    CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY session ORDER BY score NULLS LAST) + (count(score) OVER (PARTITION BY session, score) - 1) / 2.0 END AS a,
    CASE WHEN ret IS NOT NULL THEN rank() OVER (PARTITION BY session ORDER BY ret NULLS LAST) + (count(ret) OVER (PARTITION BY session, ret) - 1) / 2.0 END AS b,
    CASE WHEN vol IS NOT NULL THEN rank() OVER (PARTITION BY session ORDER BY vol DESC NULLS LAST) + (count(vol) OVER (PARTITION BY session, vol) - 1) / 2.0 END AS c FROM g WINDOW s AS (PARTITION BY session))
  SELECT symbol, session, a AS place, round(a / ns - 0.5, 6) AS r, round(CASE WHEN nr > 1 THEN (b - 1) / (nr - 1) - 0.5 END, 6) AS y, round((a / ns + c / nv) / 2, 6) AS blend FROM k""", ("panel_w",))
def rank_unknowns(spark: S, d: str) -> D:
    """Ranks, normalized ranks, labels and a blend where values are null, not numbers, or infinite: those have no rank and do not count."""
    g = v.panel_w(spark, d).select("symbol", "session", _gappy("score").alias("score"), _gappy("vol", 2).alias("vol"), _gappy("ret", 1).alias("ret"))
    g = ranked(g, {"place": F.col("score"), "b": F.col("ret"), "c": F.col("vol")}, "session", keep=("symbol",), descending=("c",))
    a, c = F.col("place") / F.col("n_place"), F.col("c") / F.col("n_c")
    return g.select("symbol", "session", "place", r6(a - 0.5).alias("r"), r6(_y()).alias("y"), r6((a + c) / 2).alias("blend"))


@query("sector_neutral_z", f"WITH c AS (SELECT symbol, session, score - avg(score) OVER (PARTITION BY session, industry) AS x FROM panel_w) SELECT symbol, session, round({_Z}, 5) AS z FROM c WINDOW s AS (PARTITION BY session)", ("panel_w",))
def sector_neutral_z(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).withColumn("x", F.col("score") - F.avg("score").over(Window.partitionBy("session", "industry")))
    return p.select("symbol", "session", rnd(zscore("x", by()), 5).alias("z"))


@query("model_features", f"WITH {_WINSOR}, q2 AS (SELECT session, quantile_cont(vol, 0.01) AS lo, quantile_cont(vol, 0.99) AS hi, count(vol) AS n FROM panel_w GROUP BY 1), c2 AS (SELECT symbol, session, CASE WHEN n >= 2 THEN least(greatest(vol, lo), hi) ELSE vol END AS x FROM panel_w JOIN q2 USING (session) WHERE vol IS NOT NULL), a AS (SELECT symbol, session, round({_Z}, 5) AS momentum_z FROM c WINDOW s AS (PARTITION BY session)), b AS (SELECT symbol, session, round({_Z}, 5) AS vol_z FROM c2 WINDOW s AS (PARTITION BY session)) SELECT a.symbol, a.session, momentum_z, coalesce(vol_z, 0.0) AS vol_z FROM a LEFT JOIN b ON a.symbol = b.symbol AND a.session = b.session", ("panel_w",))
def model_features(spark: S, d: str) -> D:
    p = winsorized(winsorized(v.panel_w(spark, d), "score", "session"), "vol", "session")
    z = p.select("symbol", "session", rnd(zscore("score", by()), 5).alias("momentum_z"), rnd(zscore("vol", by()), 5).alias("vol_z"))
    return z.na.fill({"vol_z": 0.0})


@query("regime_features", "SELECT session, round(avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END), 6) AS breadth, round(avg(vol), 6) AS mean_vol, round(avg(score), 6) AS mean_momentum FROM panel_w GROUP BY 1", ("panel_w",))
def regime_features(spark: S, d: str) -> D:
    return v.panel_w(spark, d).groupBy("session").agg(r6(F.avg((F.col("score") > 0).cast("double"))).alias("breadth"), r6(F.avg("vol")).alias("mean_vol"), r6(F.avg("score")).alias("mean_momentum"))


@query("peer_loo_mean", "SELECT symbol, session, CASE WHEN count(*) OVER g - 1 >= 3 THEN round((sum(score) OVER g - score) / (count(*) OVER g - 1), 6) END AS peer_mean FROM panel_w WINDOW g AS (PARTITION BY session, industry)", ("panel_w",))
def peer_loo_mean(spark: S, d: str) -> D:
    g = Window.partitionBy("session", "industry")
    n = F.count("*").over(g) - 1
    return v.panel_w(spark, d).select("symbol", "session", F.when(n >= 3, r6((F.sum("score").over(g) - F.col("score")) / n)).alias("peer_mean"))


@query("peer_dispersion", "WITH p AS (SELECT *, count(*) OVER g - 1 AS n, sum(score) OVER g - score AS s1, sum(score * score) OVER g - score * score AS s2 FROM panel_w WINDOW g AS (PARTITION BY session, industry)) SELECT symbol, session, CASE WHEN n >= 3 THEN round(sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))), 5) END AS dispersion FROM p", ("panel_w",))
def peer_dispersion(spark: S, d: str) -> D:
    g, x = Window.partitionBy("session", "industry"), F.col("score")
    p = v.panel_w(spark, d).withColumn("n", F.count("*").over(g) - 1).withColumn("s1", F.sum(x).over(g) - x).withColumn("s2", F.sum(x * x).over(g) - x * x)
    m = F.col("s1") / F.col("n")
    return p.select("symbol", "session", F.when(F.col("n") >= 3, rnd(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - m * m)), 5)).alias("dispersion"))


# dense calendar


def dense(spark: S, d: str) -> D:
    """symbol, session, idx, close, volume on every session of the calendar; gaps stay null."""
    grid = v.universe(spark, d).select("symbol").join(F.broadcast(v.calendar_w(spark, d)))
    return grid.join(v.bars_w(spark, d).select("symbol", "session", "close", "volume"), ["symbol", "session"], "left")


DENSE = "dense AS (SELECT u.symbol, c.session, c.idx, b.close, b.volume FROM universe u CROSS JOIN calendar_w c LEFT JOIN bars_w b ON b.symbol = u.symbol AND b.session = c.session)"
DV = ("universe", "calendar_w", "bars_w")


@query("dense_panel", f"WITH {DENSE} SELECT symbol, session, idx, close FROM dense", DV)
def dense_panel(spark: S, d: str) -> D:
    return dense(spark, d).select("symbol", "session", "idx", "close")


@query("missing_cells", f"WITH {DENSE} SELECT symbol, session FROM dense WHERE close IS NULL", DV)
def missing_cells(spark: S, d: str) -> D:
    cal = v.calendar_w(spark, d).select("session")
    grid = v.universe(spark, d).select("symbol").join(F.broadcast(cal))
    return grid.join(v.bars_w(spark, d).select("symbol", "session"), ["symbol", "session"], "left_anti")


@query("calendar_labels", "SELECT symbol, session, CASE WHEN lead(idx, 4) OVER w = idx + 4 THEN round(lead(close, 4) OVER w / close - 1, 6) END AS fwd_4 FROM bars_x WINDOW w AS (PARTITION BY symbol ORDER BY idx)", ("bars_x",))
def calendar_labels(spark: S, d: str) -> D:
    b = v.bars_x(spark, d)
    return b.select("symbol", "session", r6(lab.calendar_forward_return(b, 4)).alias("fwd_4"))


@query("calendar_momentum", "SELECT symbol, session, CASE WHEN lag(idx, 13) OVER w = idx - 13 THEN round(close / lag(close, 13) OVER w - 1, 6) END AS momentum FROM bars_x WINDOW w AS (PARTITION BY symbol ORDER BY idx)", ("bars_x",))
def calendar_momentum(spark: S, d: str) -> D:
    m = F.when(F.lag("idx", 13).over(wx()) == F.col("idx") - 13, change(F.col("close"), 13, wx()))
    return v.bars_x(spark, d).select("symbol", "session", r6(m).alias("momentum"))


@query("forward_returns", "SELECT symbol, trade_date, round(lead(close, 5) OVER w / close - 1, 6) AS fwd_5, round(lead(close, 21) OVER w / close - 1, 6) AS fwd_21 FROM bars_d " + _W, ("bars_d",))
def forward_returns(spark: S, d: str) -> D:
    return v.bars_d(spark, d).select("symbol", "trade_date", *[r6(lab.forward_return(F.col("close"), h, wd())).alias(f"fwd_{h}") for h in (5, 21)])


@query("excess_returns", "WITH i AS (SELECT session, round(lead(close, 4) OVER (ORDER BY session) / close - 1, 6) AS index_ret FROM index_w) SELECT symbol, p.session, round(ret - avg(ret) OVER (PARTITION BY p.session), 6) AS excess, round(ret - index_ret, 6) AS over_index FROM panel_w p LEFT JOIN i ON p.session = i.session", ("panel_w", "index_w"))
def excess_returns(spark: S, d: str) -> D:
    i = v.index_w(spark, d).select("session", r6(lab.forward_return(F.col("close"), 4, ws())).alias("index_ret"))
    p = v.panel_w(spark, d).join(F.broadcast(i), "session", "left")
    return p.select("symbol", "session", r6(F.col("ret") - F.avg("ret").over(by())).alias("excess"), r6(F.col("ret") - F.col("index_ret")).alias("over_index"))


@query("complete_mean", "WITH x AS (SELECT session, lead(close, 4) OVER w / close - 1 AS r FROM bars_x WINDOW w AS (PARTITION BY symbol ORDER BY idx)) SELECT session, CASE WHEN count(r) = count(*) THEN round(avg(r), 6) END AS universe_ret, count(r) AS known FROM x GROUP BY 1", ("bars_x",))
def complete_mean(spark: S, d: str) -> D:
    from ..functions.windows import complete_mean as cm

    b = v.bars_x(spark, d)
    return b.select("session", lab.forward_return(F.col("close"), 4, wx()).alias("r")).groupBy("session").agg(r6(cm(F.col("r"))).alias("universe_ret"), F.count("r").alias("known"))


@query("rank_label", "SELECT symbol, session, round(percent_rank() OVER (PARTITION BY session ORDER BY ret) - 0.5, 6) AS y FROM panel_w", ("panel_w",))
def rank_label(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", r6(F.percent_rank().over(by().orderBy("ret")) - 0.5).alias("y"))


@query("rank_scores", "SELECT symbol, session, score, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS rank FROM panel_w", ("panel_w",))
def rank_scores(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", "score", F.row_number().over(by().orderBy(F.desc("score"), "symbol")).cast("long").alias("rank"))


_Y = f"CASE WHEN count(*) OVER (PARTITION BY session) > 1 THEN ({_AVG_RANK.format(x='ret')} - 1) / (count(*) OVER (PARTITION BY session) - 1) - 0.5 END"


def _y(place: str = "b") -> F.Column:
    """The label of a ranked return."""
    n = F.col(f"n_{place}")
    return F.when(n > 1, (F.col(place) - 1) / (n - 1) - 0.5)


@query("rank_labels_avg", f"SELECT symbol, session, round({_Y}, 6) AS y FROM panel_w", ("panel_w",))
def rank_labels_avg(spark: S, d: str) -> D:
    return ranked(v.panel_w(spark, d).select("symbol", "session", "ret"), {"b": F.col("ret")}, "session", keep=("symbol",)).select("symbol", "session", r6(_y()).alias("y"))


@query("relevance_labels", f"WITH p AS (SELECT symbol, session, {_Y} AS y, dense_rank() OVER (PARTITION BY session ORDER BY ret) - 1 AS dense FROM panel_w) SELECT symbol, session, dense, CAST(least(9, floor(round((y + 0.5) * 10, 9))) AS BIGINT) AS grade FROM p", ("panel_w",))
def relevance_labels(spark: S, d: str) -> D:
    p = ranked(v.panel_w(spark, d).select("symbol", "session", "ret"), {"b": F.col("ret")}, "session").select("symbol", "session", _y().alias("y"), (F.dense_rank().over(by().orderBy("ret")) - 1).cast("long").alias("dense"))
    return p.select("symbol", "session", "dense", F.least(F.lit(9), F.floor(rnd((F.col("y") + 0.5) * 10, 9))).cast("long").alias("grade"))


@query("date_weights", "WITH w AS (SELECT symbol, session, 1.0 / count(*) OVER (PARTITION BY session) AS w FROM panel_w) SELECT symbol, session, round(w / (SELECT avg(w) FROM w), 5) AS weight FROM w", ("panel_w",))
def date_weights(spark: S, d: str) -> D:
    w = v.panel_w(spark, d).select("symbol", "session", (1.0 / F.count("*").over(by())).alias("w"))
    return w.join(F.broadcast(w.agg(F.avg("w").alias("m")))).select("symbol", "session", rnd(F.col("w") / F.col("m"), 5).alias("weight"))


@query("rank_percentile", "SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS rank, count(*) OVER (PARTITION BY session) AS universe_size, round(row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) / count(*) OVER (PARTITION BY session), 6) AS percentile FROM panel_w", ("panel_w",))
def rank_percentile(spark: S, d: str) -> D:
    r, n = F.row_number().over(by().orderBy(F.desc("score"), "symbol")), F.count("*").over(by())
    return v.panel_w(spark, d).select("symbol", "session", r.cast("long").alias("rank"), n.alias("universe_size"), r6(r / n).alias("percentile"))


_EQ = f"""WITH {DENSE}, i AS (SELECT session, ln(close / lag(close) OVER (ORDER BY session)) AS m FROM index_w),
  x AS (SELECT dense.*, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY idx)) AS r, m FROM dense JOIN i USING (session)),
  y AS (SELECT symbol, session, close, count(close) OVER f AS n, ln(lag(close, 1) OVER w / lag(close, 12) OVER w) AS mom, stddev_samp(r) OVER f AS sd, avg(r) OVER q AS recent, max(close) OVER p AS prior_high,
    covar_samp(r, m) OVER f / nullif(var_samp(m) OVER f, 0) AS beta, sum(r) OVER q AS sr, sum(m) OVER q AS sm FROM x
    WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), q AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), p AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
  SELECT symbol, session, round(mom, 5) AS log_momentum, round(mom / sd, 4) AS risk_adjusted, round(-recent / sd, 4) AS reversal_z, round(sr - beta * sm, 4) AS market_residual, round(close / prior_high - 1, 5) AS breakout FROM y WHERE n = 13"""


@query("quant_equations", _EQ, (*DV, "index_w"))
def quant_equations(spark: S, d: str) -> D:
    return equations(spark, d).select("symbol", "session", rnd(F.col("log_momentum"), 5).alias("log_momentum"), rnd(F.col("risk_adjusted"), 4).alias("risk_adjusted"), rnd(F.col("reversal_z"), 4).alias("reversal_z"), rnd(F.col("market_residual"), 4).alias("market_residual"), rnd(F.col("breakout"), 5).alias("breakout"))


def equations(spark: S, d: str, span: int = 13, skip: int = 1, recent: int = 4) -> D:
    """Fixed equations on the dense calendar; rows whose last `span` sessions are all known (a quarter here; of a year's 52 hardly
    any series of these tables has all). Momentum leaves out the last `skip` sessions; reversal, residual and breakout look at `recent` ones."""
    c = F.col("close")
    i = v.index_w(spark, d).select("session", F.log(c / F.lag(c).over(ws())).alias("m"))
    x = dense(spark, d).join(F.broadcast(i), "session").withColumn("r", F.log(c / F.lag(c).over(wx())))
    f, q = rows(span, wx()), rows(recent, wx())
    sd, mom = F.stddev_samp("r").over(f), F.log(F.lag(c, skip).over(wx()) / F.lag(c, span - 1).over(wx()))
    var = F.var_samp("m").over(f)
    beta = F.when(var != 0, F.covar_samp("r", "m").over(f) / var)
    y = x.select(
        "symbol", "session", F.count(c).over(f).alias("n"), mom.alias("log_momentum"), (mom / sd).alias("risk_adjusted"), (-F.avg("r").over(q) / sd).alias("reversal_z"),
        (F.sum("r").over(q) - beta * F.sum("m").over(q)).alias("market_residual"), (c / F.max(c).over(wx().rowsBetween(-recent, -1)) - 1).alias("breakout"),
    )
    return y.where(F.col("n") == span).drop("n")


@query("rank_blend", f"WITH e AS ({_EQ}), p AS (SELECT symbol, session, {_AVG_RANK.format(x='log_momentum')} / count(*) OVER s AS a, {_AVG_RANK.format(x='reversal_z')} / count(*) OVER s AS b, {_AVG_RANK.format(x='breakout')} / count(*) OVER s AS c FROM e WINDOW s AS (PARTITION BY session)) SELECT symbol, session, round((a + b + c) / 3, 6) AS blend FROM p".replace("WITH e AS (WITH ", "WITH e AS (WITH "), (*DV, "index_w"))
def rank_blend(spark: S, d: str) -> D:
    e = quant_equations(spark, d)
    parts = ("log_momentum", "reversal_z", "breakout")
    r = ranked(e.select("symbol", "session", *parts), {f"r_{c}": F.col(c) for c in parts}, "session", keep=("symbol",))
    p = [F.col(f"r_{c}") / F.col(f"n_r_{c}") for c in parts]
    return r.select("symbol", "session", r6(sum(p[1:], p[0]) / 3).alias("blend"))


@query("market_context", """WITH i AS (SELECT session, close, r, close / lag(close, 4) OVER o - 1 AS r4, close / lag(close, 13) OVER o - 1 AS r13, close / avg(close) OVER l - 1 AS trend, stddev_samp(r) OVER s AS mvol, count(r) OVER s AS n FROM (SELECT *, close / lag(close) OVER (ORDER BY session) - 1 AS r FROM index_w)
    WINDOW o AS (ORDER BY session), l AS (ORDER BY session ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), s AS (ORDER BY session ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)),
  x AS (SELECT symbol, b.session, b.close / lag(b.close) OVER (PARTITION BY symbol ORDER BY b.session) - 1 AS own, i.r AS m FROM bars_w b JOIN i ON b.session = i.session),
  y AS (SELECT symbol, session, CASE WHEN count(own) OVER f = 13 AND count(m) OVER f = 13 THEN covar_samp(own, m) OVER f / var_samp(m) OVER f END AS beta FROM x WINDOW f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
  SELECT p.symbol, p.session, round(r, 6) AS market_ret_1, round(r4, 6) AS market_ret_4, round(r13, 6) AS market_ret_13, round(trend, 6) AS market_trend, CASE WHEN n >= 13 THEN round(mvol, 6) END AS market_vol, round(beta, 5) AS beta
  FROM panel_w p JOIN i ON p.session = i.session JOIN y ON p.symbol = y.symbol AND p.session = y.session""", ("panel_w", "index_w", "bars_w"))
def market_context(spark: S, d: str) -> D:
    c = F.col("close")
    i = v.index_w(spark, d).withColumn("r", change(c, 1, ws()))
    i = i.select(
        "session", "r", r6(F.col("r")).alias("market_ret_1"), *[r6(change(c, n, ws())).alias(f"market_ret_{n}") for n in (4, 13)],
        r6(c / F.avg(c).over(rows(40, ws())) - 1).alias("market_trend"), r6(need(13, F.col("r"), F.stddev_samp, ws())).alias("market_vol"),
    )
    own, f = series("session"), rows(13, series("session"))
    b = v.bars_w(spark, d).withColumn("own", change(c, 1, own)).join(F.broadcast(i), "session")
    known = (F.count("own").over(f) == 13) & (F.count("r").over(f) == 13)
    b = b.withColumn("beta", F.when(known, rnd(F.covar_samp("own", "r").over(f) / F.var_samp("r").over(f), 5))).drop("own", "r", "open", "high", "low", "close", "volume")
    return v.panel_w(spark, d).select("symbol", "session").join(b, ["symbol", "session"])


@query("drawdown_curve", "WITH x AS (SELECT symbol, session, close / max(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS dd FROM bars_w) SELECT symbol, session, round(dd, 6) AS drawdown, round(min(dd) OVER (PARTITION BY symbol ORDER BY session), 6) AS worst FROM x", ("bars_w",))
def drawdown_curve(spark: S, d: str) -> D:
    run = ws().rowsBetween(Window.unboundedPreceding, 0)
    x = v.bars_w(spark, d).withColumn("dd", F.col("close") / F.max("close").over(run) - 1)
    return x.select("symbol", "session", r6(F.col("dd")).alias("drawdown"), r6(F.min("dd").over(run)).alias("worst"))


@query("segment_reset", """WITH s AS (SELECT b.symbol, session, close, coalesce(session BETWEEN impact_start AND impact_end, false) AS impacted, coalesce(CAST(session > impact_end AS INT), 0) AS segment FROM bars_w b LEFT JOIN ledger l ON b.symbol = l.symbol),
  k AS (SELECT *, count(*) OVER f AS n, avg(close) OVER f AS m FROM s WHERE NOT impacted WINDOW f AS (PARTITION BY symbol, segment ORDER BY session ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))
  SELECT s.symbol, s.session, s.segment, CASE WHEN n >= 13 THEN round(m, 4) END AS sma_13 FROM s LEFT JOIN k ON s.symbol = k.symbol AND s.session = k.session""", ("bars_w", "ledger"))
def segment_reset(spark: S, d: str) -> D:
    s = mark_segments(v.bars_w(spark, d), v.ledger(spark, d))
    w = Window.partitionBy("symbol", "segment").orderBy("session")
    return s.select("symbol", "session", F.col("ended").cast("int").alias("segment"), F.when(~F.col("impacted"), r4(need(13, F.col("close"), F.avg, w))).alias("sma_13"))


_MANY = """s AS (SELECT symbol, session, close, (SELECT count(*) FROM ledger_many l WHERE l.symbol = b.symbol AND impact_start <= session) + (SELECT count(*) FROM ledger_many l WHERE l.symbol = b.symbol AND impact_end < session) AS segment,
  EXISTS (SELECT 1 FROM ledger_many l WHERE l.symbol = b.symbol AND session BETWEEN impact_start AND impact_end) AS impacted FROM bars_w b)"""


@query("segments_many", f"""WITH {_MANY} SELECT symbol, session, segment, impacted, CASE WHEN NOT impacted AND count(*) OVER f = 5 THEN round(avg(close) OVER f, 4) END AS sma_5 FROM s
  WINDOW f AS (PARTITION BY symbol, segment ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", ("bars_w", "ledger_many"))
def segments_many(spark: S, d: str) -> D:
    """Features start anew at each start and end of any of a symbol's windows, and are unknown inside."""
    s = mark_segments(v.bars_w(spark, d), v.ledger_many(spark, d))
    w = Window.partitionBy("symbol", "segment").orderBy("session")
    return s.select("symbol", "session", "segment", "impacted", F.when(~F.col("impacted"), r4(need(5, F.col("close"), F.avg, w))).alias("sma_5"))


@query("trend_segments", f"""WITH RECURSIVE {_MANY}, b AS (SELECT symbol, segment, session, ln(close) AS y, row_number() OVER (PARTITION BY symbol, segment ORDER BY session) AS n FROM s),
  g AS (SELECT 1 AS n, 1.0::DOUBLE AS p, 0.0::DOUBLE AS c, 1.0::DOUBLE AS q, 0.0::DOUBLE AS a, 0.0::DOUBLE AS h UNION ALL SELECT n + 1, (1 - a2) * pp, (1 - a2) * pc, pq - h2 * pc, a2, h2 FROM
    (SELECT *, pp / (pp + 0.0025) AS a2, pc / (pp + 0.0025) AS h2 FROM (SELECT n, p + 2 * c + q + 0.0001 AS pp, c + q AS pc, q + 0.00000001 AS pq FROM g WHERE n <= 400))),
  e AS (SELECT symbol, segment, n, y AS x0, 0.0::DOUBLE AS v0, y, 1 AS k FROM b WHERE n = 1),
  f AS (SELECT e.symbol, e.segment, e.n, (1 - g.a) * (x0 + v0) + g.a * e.y AS x, v0 + g.h * (e.y - x0 - v0) AS v FROM e JOIN g ON g.n = 2
    UNION ALL SELECT b.symbol, b.segment, b.n, (1 - g.a) * (f.x + f.v) + g.a * b.y, f.v + g.h * (b.y - f.x - f.v) FROM f JOIN b ON b.symbol = f.symbol AND b.segment = f.segment AND b.n = f.n + 1 JOIN g ON g.n = b.n + 1)
  SELECT b.symbol, b.session, round(f.v, 6) AS trend, round(f.v / sqrt(g.q), 4) AS trend_score FROM f JOIN b ON b.symbol = f.symbol AND b.segment = f.segment AND b.n = f.n JOIN g ON g.n = f.n + 1""", ("bars_w", "ledger_many"))
def trend_segments(spark: S, d: str) -> D:
    """The trend filter, begun anew in each segment of several windows a symbol."""
    s = mark_segments(v.bars_w(spark, d), v.ledger_many(spark, d)).withColumnRenamed("session", "trade_date")
    return ind.kalman_trend(s).select("symbol", F.col("trade_date").alias("session"), r6(F.col("trend")).alias("trend"), r4(F.col("trend_score")).alias("trend_score"))


@query("mask_labels", """WITH x AS (SELECT symbol, session, lead(session, 4) OVER w AS exit, lead(close, 4) OVER w / close - 1 AS r FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session))
  SELECT x.symbol, session, CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.symbol = x.symbol AND x.session <= impact_end AND x.exit >= impact_start) THEN NULL ELSE round(r, 6) END AS fwd_4 FROM x WHERE exit IS NOT NULL""", ("bars_w", "ledger"))
def mask_labels(spark: S, d: str) -> D:
    x = v.bars_w(spark, d).select("symbol", "session", F.lead("session", 4).over(ws()).alias("exit"), lab.forward_return(F.col("close"), 4, ws()).alias("r")).where("exit is not null")
    return crossed(x, v.ledger(spark, d), "symbol", "session", "exit").select("symbol", "session", F.when(~F.col("crossed"), r6(F.col("r"))).alias("fwd_4"))


@query("mask_labels_many", """WITH x AS (SELECT symbol, session, lead(session, 4) OVER w AS exit, lead(close, 4) OVER w / close - 1 AS r FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session))
  SELECT x.symbol, session, CASE WHEN EXISTS (SELECT 1 FROM ledger_many l WHERE l.symbol = x.symbol AND x.session <= impact_end AND x.exit >= impact_start) THEN NULL ELSE round(r, 6) END AS fwd_4 FROM x""", ("bars_w", "ledger_many"))
def mask_labels_many(spark: S, d: str) -> D:
    """Labels whose holding window meets any of several, also overlapping, event windows of the symbol are unknown."""
    x = v.bars_w(spark, d).select("symbol", "session", F.lead("session", 4).over(ws()).alias("exit"), lab.forward_return(F.col("close"), 4, ws()).alias("r"))
    return crossed(x, v.ledger_many(spark, d), "symbol", "session", "exit").select("symbol", "session", F.when(~F.col("crossed"), r6(F.col("r"))).alias("fwd_4"))


@query("event_overlap", "SELECT symbol, session, event_id FROM bars_w JOIN ledger USING (symbol) WHERE session <= impact_end AND session + 28 >= impact_start", ("bars_w", "ledger"))
def event_overlap(spark: S, d: str) -> D:
    return _overlaps(spark, d, v.ledger(spark, d))


@query("event_overlap_many", "SELECT symbol, session, event_id FROM bars_w JOIN ledger_many USING (symbol) WHERE session <= impact_end AND session + 28 >= impact_start", ("bars_w", "ledger_many"))
def event_overlap_many(spark: S, d: str) -> D:
    return _overlaps(spark, d, v.ledger_many(spark, d))


def _overlaps(spark: S, d: str, events: D) -> D:
    held = v.bars_w(spark, d).select("symbol", "session", F.date_add("session", 28).alias("until"))
    return meeting_pairs(held, events, "symbol", ("session", "until"), ("impact_start", "impact_end")).select("symbol", "session", "event_id")


@query("sequences", "SELECT symbol, session, round(first_close, 4) AS first_close, CAST(20 AS BIGINT) AS n FROM (SELECT symbol, session, idx, first_value(idx) OVER f AS i0, first_value(close) OVER f AS first_close, count(*) OVER f AS n FROM bars_x WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20 AND idx - i0 = 19", ("bars_x",))
def sequences(spark: S, d: str) -> D:
    f = rows(20, wx())
    x = v.bars_x(spark, d).select("symbol", "session", "idx", F.collect_list(F.struct("idx", "close", "volume")).over(f).alias("seq"))
    x = x.where((F.size("seq") == 20) & (F.col("idx") - F.get("seq", F.lit(0))["idx"] == 19))
    return x.select("symbol", "session", r4(F.get("seq", F.lit(0))["close"]).alias("first_close"), F.size("seq").cast("long").alias("n"))


@query("peer_inputs", f"""WITH {DENSE} SELECT symbol, session, CASE WHEN count(close) OVER f = 40 THEN close > avg(close) OVER f END AS above_40, CASE WHEN count(close) OVER s = 5 THEN close / lag(close, 4) OVER w > 1 END AS up_4, CASE WHEN count(volume) OVER s = 5 AND count(volume) OVER l = 20 THEN round(avg(volume) OVER s / avg(volume) OVER l, 6) END AS volume_ratio FROM dense
  WINDOW w AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), l AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", DV)
def peer_inputs(spark: S, d: str) -> D:
    c, vol = F.col("close"), F.col("volume")
    return dense(spark, d).select(
        "symbol", "session",
        (c > need(40, c, F.avg, wx())).alias("above_40"),
        F.when(F.count(c).over(rows(5, wx())) == 5, c / F.lag(c, 4).over(wx()) > 1).alias("up_4"),
        r6(need(5, vol, F.avg, wx()) / need(20, vol, F.avg, wx())).alias("volume_ratio"),
    )


@query("sector_forward", f"""WITH {DENSE}, r AS (SELECT d.symbol, industry, session, lead(close, 4) OVER (PARTITION BY d.symbol ORDER BY idx) / close - 1 AS r FROM dense d JOIN universe u ON d.symbol = u.symbol),
  g AS (SELECT *, count(*) OVER k - 1 AS peers, count(r) OVER k - CAST(r IS NOT NULL AS INT) AS known, coalesce(sum(r) OVER k, 0) - coalesce(r, 0) AS s FROM r WINDOW k AS (PARTITION BY session, industry))
  SELECT symbol, session, CASE WHEN peers >= 5 AND known >= 0.5 * peers AND known > 0 THEN round(s / known, 6) END AS sector_ret FROM g""", DV)
def sector_forward(spark: S, d: str) -> D:
    k = Window.partitionBy("session", "industry")
    x = dense(spark, d).join(v.universe(spark, d).select("symbol", "industry"), "symbol").withColumn("r", lab.forward_return(F.col("close"), 4, wx()))
    peers, known = F.count("*").over(k) - 1, F.count("r").over(k) - F.col("r").isNotNull().cast("int")
    s = F.coalesce(F.sum("r").over(k), F.lit(0.0)) - F.coalesce("r", F.lit(0.0))
    return x.select("symbol", "session", F.when((peers >= 5) & (known >= 0.5 * peers) & (known > 0), r6(s / known)).alias("sector_ret"))


@query("nonoverlap_schedule", """WITH RECURSIVE c AS (SELECT idx, session FROM calendar_w), s AS (SELECT min(idx) AS idx FROM c UNION ALL SELECT (SELECT min(c.idx) FROM c WHERE c.idx > s.idx + 4) FROM s WHERE s.idx IS NOT NULL)
  SELECT session, idx FROM c WHERE idx IN (SELECT idx FROM s WHERE idx IS NOT NULL)""", ("calendar_w",))
def nonoverlap_schedule(spark: S, d: str) -> D:
    """Greedy: the next entry is the first candidate after the previous exit, 4 sessions on. One strategy's sessions are one short list."""
    c = v.calendar_w(spark, d).agg(F.sort_array(F.collect_list(F.struct("idx", "session"))).alias("cs"))
    start = F.struct(F.lit(None).cast("array<struct<idx:bigint,session:date>>").alias("taken"), F.lit(-5).cast("long").alias("last"))
    empty = F.array().cast("array<struct<idx:bigint,session:date>>")
    fold = F.aggregate(
        "cs", start, lambda a, x: F.when(x["idx"] > a["last"] + 4, F.struct(F.concat(F.coalesce(a["taken"], empty), F.array(x)).alias("taken"), x["idx"].alias("last"))).otherwise(a), lambda a: F.coalesce(a["taken"], empty)
    )
    return c.select(F.explode(fold).alias("x")).select("x.session", "x.idx")


@query("version_availability", """SELECT o_custkey AS source, o_orderkey, CAST(o_orderdate AS DATE) AS first_seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN CAST(o_orderdate AS DATE) ELSE (CAST(o_orderdate AS DATE) + 1)::DATE END AS available FROM orders""")
def version_availability(spark: S, d: str) -> D:
    from ..sources.tables import table

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("source"), "o_orderkey", day.alias("first_seen"), n.cast("long").alias("version"), F.when(n == 1, day).otherwise(F.date_add(day, 1)).alias("available"))


_CONTENT = "SELECT o_custkey AS source, CAST(year(o_orderdate) AS BIGINT) AS published, o_orderkey, o_orderstatus || o_orderpriority AS content, CAST(o_orderdate AS DATE) AS seen, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) + 1 AS available FROM orders"


@query("content_versions", f"""WITH c AS ({_CONTENT}), n AS (SELECT *, row_number() OVER (PARTITION BY source, published ORDER BY seen, o_orderkey) AS place, row_number() OVER (PARTITION BY source, published, content ORDER BY seen, o_orderkey) AS again FROM c)
  SELECT source, published, o_orderkey, place > 1 AND again = 1 AS changed, CASE WHEN place > 1 AND again = 1 THEN greatest((seen + 1)::DATE, available::DATE) ELSE available::DATE END AS available FROM n""")
def content_versions(spark: S, d: str) -> D:
    """Documents that a source shows under one date of publication: contents that come back are not new, and a new one counts from the day after it was seen."""
    from ..operators.ingest import version_availability as va
    from ..sources.tables import table

    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("source"), F.year("o_orderdate").cast("long").alias("published"), "o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("content"), day.alias("seen"), F.date_add(day, 1 - (F.col("o_orderkey") % 3).cast("int")).alias("available")
    )
    return va(o, ["source", "published"], "content", ["seen", "o_orderkey"], "available").select("source", "published", "o_orderkey", "changed", "available")
