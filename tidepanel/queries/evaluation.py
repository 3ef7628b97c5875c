"""Rank quality, backtests, calibration, coverage, folds and model choice."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import PPF_A, PPF_B, PPF_C, PPF_D, PPF_TAIL, change, normal_cdf, normal_ppf, r4, r6, series, sigmoid, rnd
from ..operators import evaluation as ev
from ..operators import labels as lab
from ..operators.ranks import ranked
from ..plans import views as v
from ..sources.tables import written
from ..sources.tables import table
from .registry import query

D, S = DataFrame, SparkSession


def by():
    return Window.partitionBy("session")

P = ("panel_w",)


def _ic_sql(score: str = "score", keys: str = "session", source: str = "panel_w", least: int = 2) -> str:
    rk = lambda x: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
    return f"SELECT {keys}, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM (SELECT {keys}, {rk(score)} AS a, {rk('ret')} AS b FROM {source} WHERE {score} IS NOT NULL AND ret IS NOT NULL) GROUP BY {keys} HAVING count(*) >= {least}"


@query("information_coefficient", f"SELECT count(ic) AS n_dates, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / stddev_samp(ic), 5) AS ir FROM ({_ic_sql()})", P)
def information_coefficient(spark: S, d: str) -> D:
    ic = ev.rank_ic(v.panel_w(spark, d), "score", "ret", ["session"])
    return ic.agg(F.count("ic").alias("n_dates"), r6(F.avg("ic")).alias("mean_ic"), r6(F.stddev_samp("ic")).alias("std_ic"), rnd(F.avg("ic") / F.stddev_samp("ic"), 5).alias("ir"))


@query("rank_ic_min", f"SELECT session, n, round(ic, 6) AS ic FROM ({_ic_sql(least=20)})", P)
def rank_ic_min(spark: S, d: str) -> D:
    return ev.rank_ic(v.panel_w(spark, d), "score", "ret", ["session"], 20).select("session", "n", r6(F.col("ic")).alias("ic"))


@query("rank_ic_gaps", f"WITH g AS (SELECT panel_w.symbol, panel_w.session, ret, CASE WHEN volume > 20 THEN score END AS thick FROM panel_w) SELECT session, n, round(ic, 6) AS ic FROM ({_ic_sql('thick', source='g', least=3)})", P)
def rank_ic_gaps(spark: S, d: str) -> D:
    """Scores are unknown for thinly traded weeks; those rows have no rank."""
    g = v.panel_w(spark, d).select("session", "ret", F.when(F.col("volume") > 20, F.col("score")).alias("thick"))
    return ev.rank_ic(g, "thick", "ret", ["session"], 3).select("session", "n", r6(F.col("ic")).alias("ic"))


@query("sector_neutral_ic", f"WITH s AS (SELECT session, round(score - avg(score) OVER g, 9) AS score, round(ret - avg(ret) OVER g, 9) AS ret FROM panel_w WINDOW g AS (PARTITION BY session, industry)) SELECT session, round(ic, 6) AS ic FROM ({_ic_sql(source='s')})", P)
def sector_neutral_ic(spark: S, d: str) -> D:
    g = Window.partitionBy("session", "industry")
    p = v.panel_w(spark, d).select("session", *[rnd(F.col(c) - F.avg(c).over(g), 9).alias(c) for c in ("score", "ret")])
    return ev.rank_ic(p, "score", "ret", ["session"]).select("session", r6(F.col("ic")).alias("ic"))


@query("ic_by_group", f"WITH p AS (SELECT *, year(session) * 10 + quarter(session) AS q FROM panel_w), x AS ({_ic_sql(keys='session, industry', least=3)}) SELECT year(session) * 10 + quarter(session) AS q, industry, count(ic) AS n_dates, round(avg(ic), 6) AS mean_ic FROM x GROUP BY 1, 2", P)
def ic_by_group(spark: S, d: str) -> D:
    ic = ev.rank_ic(v.panel_w(spark, d), "score", "ret", ["session", "industry"], 3)
    q = (F.year("session") * 10 + F.quarter("session")).cast("long")
    return ic.groupBy(q.alias("q"), "industry").agg(F.count("ic").alias("n_dates"), r6(F.avg("ic")).alias("mean_ic"))


@query("newey_west", f"""WITH s AS (SELECT row_number() OVER (ORDER BY session) - 1 AS i, ic AS x FROM ({_ic_sql()}) WHERE ic IS NOT NULL), k AS (SELECT count(*) AS n, avg(x) AS m, CAST(floor(4 * pow(count(*) / 100.0, 2.0 / 9)) AS INT) AS lags FROM s),
  e AS (SELECT i, x - m AS e, lags, n FROM s, k), p AS (SELECT a.e * b.e * CASE WHEN l = 0 THEN 1.0 ELSE 2 * (1 - l / (a.lags + 1.0)) END AS z FROM e a, (SELECT unnest(range(0, 50)) AS l), e b WHERE l <= a.lags AND b.i = a.i + l)
  SELECT n, lags, round(m, 6) AS mean, round(m / sqrt((SELECT sum(z) FROM p) / n / n), 4) AS t_stat FROM k""", P)
def newey_west(spark: S, d: str) -> D:
    ic = ev.rank_ic(v.panel_w(spark, d), "score", "ret", ["session"])
    return ev.newey_west(ic, "ic").select("n", "lags", r6(F.col("mean")).alias("mean"), r4(F.col("t_stat")).alias("t_stat"))


_TOP = "(SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS place FROM panel_w)"


@query("deflated_sharpe", f"""WITH r AS (SELECT session, avg(ret) AS x FROM {_TOP} WHERE place <= 5 GROUP BY 1), m AS (SELECT count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd, skewness(x) AS g1, kurtosis(x) AS g2 FROM r),
  s AS (SELECT *, mu / sd AS sr FROM m), z AS (SELECT *, (sr - 0.05) * sqrt(n - 1) / sqrt(1 - g1 * sr + (g2 + 2) / 4 * sr * sr) AS z FROM s),
  t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), q AS (SELECT *, exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t)
  SELECT n, round(sr, 5) AS sharpe, round(g1, 4) AS skew, round(g2, 4) AS excess_kurtosis, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 4) AS probability FROM q""", P)
def deflated_sharpe(spark: S, d: str) -> D:
    """Probability that the Sharpe ratio of top-5 returns exceeds 0.05, with bias-corrected skewness and excess kurtosis."""
    r = ev.top_k(v.panel_w(spark, d), "score", 5).groupBy("session").agg(F.avg("ret").alias("x"))
    m = r.agg(F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    n, g2 = F.col("n"), F.col("k")
    m = m.select("n", (F.col("mu") / F.col("sd")).alias("sr"), (F.col("s") * F.sqrt(n * (n - 1)) / (n - 2)).alias("g1"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("g2"))
    sr = F.col("sr")
    z = (sr - 0.05) * F.sqrt(n - 1) / F.sqrt(1 - F.col("g1") * sr + (F.col("g2") + 2) / 4 * sr * sr)
    return m.select("n", rnd(sr, 5).alias("sharpe"), r4(F.col("g1")).alias("skew"), r4(F.col("g2")).alias("excess_kurtosis"), r4(normal_cdf(z)).alias("probability"))


@query("precision_at_k", f"WITH m AS (SELECT *, avg(ret) OVER (PARTITION BY session) AS bench FROM {_TOP}), x AS (SELECT session, avg(CASE WHEN ret > bench THEN 1.0 ELSE 0.0 END) AS p FROM m WHERE place <= 10 GROUP BY 1) SELECT count(*) AS n_dates, round(avg(p), 6) AS precision_at_10 FROM x", P)
def precision_at_k(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).withColumn("bench", F.avg("ret").over(by()))
    x = ev.top_k(p, "score", 10).groupBy("session").agg(F.avg((F.col("ret") > F.col("bench")).cast("double")).alias("p"))
    return x.agg(F.count("*").alias("n_dates"), r6(F.avg("p")).alias("precision_at_10"))


@query("topk_return", f"SELECT session, round(avg(ret), 6) AS mean_ret FROM {_TOP} WHERE place <= 5 GROUP BY 1", P)
def topk_return(spark: S, d: str) -> D:
    return ev.top_k(v.panel_w(spark, d), "score", 5).groupBy("session").agg(r6(F.avg("ret")).alias("mean_ret"))


_TURN = f"m AS (SELECT session, symbol, dense_rank() OVER (ORDER BY session) - 1 AS i FROM {_TOP} WHERE place <= 10), t AS (SELECT a.session, a.i, CASE WHEN a.i > 0 THEN 1 - count(b.symbol) / count(*) END AS turnover FROM m a LEFT JOIN m b ON a.symbol = b.symbol AND b.i = a.i - 1 GROUP BY 1, 2)"


@query("turnover", f"WITH {_TURN} SELECT session, i, round(turnover, 6) AS turnover FROM t", P)
def turnover(spark: S, d: str) -> D:
    return ev.turnover(ev.top_k(v.panel_w(spark, d), "score", 10)).select("session", "i", r6(F.col("turnover")).alias("turnover"))


_BT = """dts AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i FROM (SELECT DISTINCT session FROM panel_w)), reb AS (SELECT session, i // 4 AS i FROM dts WHERE i % 4 = 0),
  px AS (SELECT p.*, i FROM panel_w p JOIN reb USING (session)), lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS n FROM px) WHERE n <= 5), sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score, symbol) AS n FROM px) WHERE n <= 5),
  tl AS (SELECT a.i, 1 - count(b.symbol) / count(*) AS t, avg(a.ret) AS r FROM lg a LEFT JOIN lg b ON a.symbol = b.symbol AND b.i = a.i - 1 GROUP BY 1), ts AS (SELECT a.i, 1 - count(b.symbol) / count(*) AS t, avg(a.ret) AS r FROM sh a LEFT JOIN sh b ON a.symbol = b.symbol AND b.i = a.i - 1 GROUP BY 1),
  bt AS (SELECT session, tl.i, tl.r - ts.r AS gross, 0.001 * 2 * (tl.t + ts.t) AS cost FROM tl JOIN ts USING (i) JOIN reb USING (i))"""


def backtest(panel: D, h: int = 4, k: int = 5, rate: float = 0.001) -> D:
    """session, i, gross, cost of a long/short book renewed every h-th date; the first date is all new."""
    dates = ev.indexed(panel.select("session").distinct()).where(F.col("i") % h == 0).select("session", F.expr(f"i div {h}").alias("i"))
    px = panel.join(F.broadcast(dates), "session")
    sides = []
    for name, low in (("l", False), ("s", True)):
        m = ev.top_k(px, "score", k, bottom=low)
        held = m.select((F.col("i") + 1).alias("i"), "symbol").withColumn("held", F.lit(1))
        g = m.join(held, ["i", "symbol"], "left").groupBy("session", "i").agg((1 - F.count("held") / F.count("*")).alias(f"t_{name}"), F.avg("ret").alias(f"r_{name}"))
        sides.append(g)
    both = sides[0].join(sides[1].drop("session"), "i")
    return both.select("session", "i", (F.col("r_l") - F.col("r_s")).alias("gross"), (rate * 2 * (F.col("t_l") + F.col("t_s"))).alias("cost"))


@query("backtest_periods", f"WITH {_BT} SELECT session, i, round(gross, 6) AS gross, round(cost, 6) AS cost, round(gross - cost, 6) AS net FROM bt", P)
def backtest_periods(spark: S, d: str) -> D:
    b = backtest(v.panel_w(spark, d))
    return b.select("session", F.col("i").cast("long").alias("i"), r6(F.col("gross")).alias("gross"), r6(F.col("cost")).alias("cost"), r6(F.col("gross") - F.col("cost")).alias("net"))


def stats(curve: D, per_year: float) -> D:
    """One row of totals of a net return series (i, net)."""
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row a rebalance
    e = curve.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))
    e = e.withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    years = F.count("*") / per_year
    return e.agg(
        F.count("*").alias("n"), r4(ev.compounded(F.col("net"))).alias("total"), r4(F.exp(F.sum(F.log1p("net")) / years) - 1).alias("annual_return"), r4(F.stddev_samp("net") * per_year**0.5).alias("annual_vol"),
        r4(F.avg("net") / F.stddev_samp("net") * per_year**0.5).alias("sharpe"), r4(F.min("dd")).alias("max_drawdown"), r4(F.avg((F.col("net") > 0).cast("double"))).alias("hit_rate"),
    )


_STATS = """SELECT count(*) AS n, round(exp(sum(ln(1 + net))) - 1, 4) AS total, round(exp(sum(ln(1 + net)) / (count(*) / 13.0)) - 1, 4) AS annual_return, round(stddev_samp(net) * sqrt(13), 4) AS annual_vol, round(avg(net) / stddev_samp(net) * sqrt(13), 4) AS sharpe,
  round(min(dd), 4) AS max_drawdown, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate FROM (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY i)) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY i)) AS equity FROM {0}))"""


@query("backtest_stats", f"WITH {_BT}, nt AS (SELECT i, (gross - cost) / 1000 AS net FROM bt) {_STATS.format('nt')}", P)
def backtest_stats(spark: S, d: str) -> D:
    return stats(backtest(v.panel_w(spark, d)).select("i", ((F.col("gross") - F.col("cost")) / 1000).alias("net")), 13.0)


@query("regression_metrics", "SELECT round(sqrt(avg((score / 10 - ret) * (score / 10 - ret))), 6) AS rmse, round(avg(abs(score / 10 - ret)), 6) AS mae FROM panel_w", P)
def regression_metrics(spark: S, d: str) -> D:
    e = F.col("score") / 10 - F.col("ret")
    return v.panel_w(spark, d).agg(r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"))


@query("rule_baseline_eval", f"WITH r AS (SELECT session, CAST(score > 0 AS INT) + CAST(vol < 0.3 AS INT) + CAST(volume > 300 AS INT) AS score, ret FROM panel_w WHERE vol IS NOT NULL) SELECT count(ic) AS n_dates, round(avg(ic), 6) AS mean_ic FROM ({_ic_sql(source='r')})", P)
def rule_baseline_eval(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).where("vol is not null").select("session", "ret", F.expr("int(score > 0) + int(vol < 0.3) + int(volume > 300)").alias("score"))
    return ev.rank_ic(p, "score", "ret", ["session"]).agg(F.count("ic").alias("n_dates"), r6(F.avg("ic")).alias("mean_ic"))


# calibration: p is a probability that ret > 0, y whether it is

_CAL = "cal AS (SELECT symbol, session, industry, 1 / (1 + exp(-2 * score)) AS p, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS y, ret, score, 1.0 / count(*) OVER (PARTITION BY session) AS w FROM panel_w)"


def cal(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", "industry", sigmoid(2 * F.col("score")).alias("p"), (F.col("ret") > 0).cast("double").alias("y"), "ret", "score", (1.0 / F.count("*").over(by())).alias("w"))


@query("weighted_quantile", f"WITH {_CAL}, c AS (SELECT industry, ret, sum(w) OVER (PARTITION BY industry ORDER BY ret RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY industry) AS t FROM cal) SELECT industry, min(ret) AS quantile FROM c WHERE c >= 0.9 * t - 1e-12 GROUP BY 1", P)
def weighted_quantile(spark: S, d: str) -> D:
    return ev.weighted_quantile(cal(spark, d), "ret", "w", 0.9, "industry")


@query("brier_by_date", f"WITH {_CAL}, x AS (SELECT session, avg((p - y) * (p - y)) AS b, -avg(y * ln(greatest(p, 1e-9)) + (1 - y) * ln(greatest(1 - p, 1e-9))) AS l FROM cal GROUP BY 1) SELECT count(*) AS n_dates, round(avg(b), 6) AS brier, round(avg(l), 6) AS log_loss FROM x", P)
def brier_by_date(spark: S, d: str) -> D:
    p, y, least = F.col("p"), F.col("y"), F.lit(1e-9)
    x = cal(spark, d).groupBy("session").agg(F.avg((p - y) * (p - y)).alias("b"), (-F.avg(y * F.log(F.greatest(p, least)) + (1 - y) * F.log(F.greatest(1 - p, least)))).alias("l"))
    return x.agg(F.count("*").alias("n_dates"), r6(F.avg("b")).alias("brier"), r6(F.avg("l")).alias("log_loss"))


@query("reliability_ece", f"WITH {_CAL}, b AS (SELECT CAST(least(4, floor(p * 5)) AS BIGINT) AS bin, sum(w) AS mass, sum(w * p) / sum(w) AS mean_p, sum(w * y) / sum(w) AS rate FROM cal GROUP BY 1) SELECT bin, round(mass, 4) AS mass, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(mass / (SELECT sum(mass) FROM b) * abs(mean_p - rate), 6) AS ece_part FROM b", P)
def reliability_ece(spark: S, d: str) -> D:
    w = F.col("w")
    b = cal(spark, d).groupBy(F.least(F.lit(4), F.floor(F.col("p") * 5)).cast("long").alias("bin")).agg(F.sum(w).alias("mass"), (F.sum(w * F.col("p")) / F.sum(w)).alias("mean_p"), (F.sum(w * F.col("y")) / F.sum(w)).alias("rate"))
    b = b.join(F.broadcast(b.agg(F.sum("mass").alias("all"))))
    return b.select("bin", r4(F.col("mass")).alias("mass"), r6(F.col("mean_p")).alias("mean_p"), r6(F.col("rate")).alias("rate"), r6(F.col("mass") / F.col("all") * F.abs(F.col("mean_p") - F.col("rate"))).alias("ece_part"))


@query("block_means", "WITH x AS (SELECT session, avg(ret) AS r, row_number() OVER (ORDER BY session) - 1 AS i FROM panel_w GROUP BY 1) SELECT i // 4 AS block, round(avg(r), 6) AS mean_ret FROM x GROUP BY 1 HAVING count(*) = 4", P)
def block_means(spark: S, d: str) -> D:
    x = ev.indexed(v.panel_w(spark, d).groupBy("session").agg(F.avg("ret").alias("r")))
    return x.groupBy(F.expr("i div 4").alias("block")).agg(r6(F.avg("r")).alias("mean_ret"), F.count("*").alias("n")).where("n = 4").drop("n")


@query("range_bands", f"""WITH {_CAL}, g AS (SELECT *, least(3, (row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) - 1) // 5) AS bucket, CASE WHEN session < DATE '1998-01-01' THEN 'fit' WHEN session < DATE '1999-01-01' THEN 'expand' ELSE 'assess' END AS part FROM cal),
  f AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY session, bucket) AS wb FROM g WHERE part = 'fit'), c AS (SELECT bucket, ret, sum(wb) OVER (PARTITION BY bucket ORDER BY ret RANGE UNBOUNDED PRECEDING) AS c, sum(wb) OVER (PARTITION BY bucket) AS t FROM f),
  b AS (SELECT bucket, min(ret) FILTER (WHERE c >= 0.1 * t - 1e-12) AS lo, min(ret) FILTER (WHERE c >= 0.5 * t - 1e-12) AS mid, min(ret) FILTER (WHERE c >= 0.9 * t - 1e-12) AS hi FROM c GROUP BY 1),
  bc AS (SELECT ret, sum(w) OVER (ORDER BY ret RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM f), base AS (SELECT min(ret) AS base FROM bc WHERE c >= 0.5 * t - 1e-12),
  e AS (SELECT greatest(lo - ret, ret - hi, 0) AS e, w FROM g JOIN b USING (bucket) WHERE part = 'expand'), ec AS (SELECT e, sum(w) OVER (ORDER BY e RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM e), x AS (SELECT min(e) AS x FROM ec WHERE c >= 0.8 * t - 1e-12),
  d AS (SELECT bucket, session, avg(CASE WHEN ret BETWEEN greatest(-1, lo - x) AND hi + x THEN 1.0 ELSE 0.0 END) AS cov, avg(hi + x - greatest(-1, lo - x)) AS width, avg(abs(ret - mid)) AS m, avg(abs(ret - base)) AS n FROM g JOIN b USING (bucket), base, x WHERE part = 'assess' GROUP BY 1, 2)
  SELECT bucket, count(*) AS n_dates, round(avg(cov), 5) AS coverage, round(avg(width), 5) AS width, round(avg(m), 5) AS median_mae, round(avg(n), 5) AS baseline_mae FROM d GROUP BY 1""", P)
def range_bands(spark: S, d: str) -> D:
    """Return bands of rank groups, fitted on one span, widened by how far returns of a second one lie outside, and assessed on a third."""
    place = F.row_number().over(by().orderBy(F.desc("score"), "symbol"))
    g = cal(spark, d).withColumn("bucket", F.least(F.lit(3), F.floor((place - 1) / 5)).cast("long"))
    fit = g.where("session < '1998-01-01'").withColumn("wb", 1.0 / F.count("*").over(Window.partitionBy("session", "bucket")))
    bands = ev.weighted_quantiles(fit, "ret", "wb", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, "bucket")
    base = ev.weighted_quantiles(fit, "ret", "w", {"base": 0.5})
    off = g.where("session >= '1998-01-01' and session < '1999-01-01'").join(bands, "bucket").select(F.greatest(F.col("lo") - F.col("ret"), F.col("ret") - F.col("hi"), F.lit(0.0)).alias("e"), "w")
    wider = ev.weighted_quantiles(off, "e", "w", {"x": 0.8})
    one = bands.join(F.broadcast(base)).join(F.broadcast(wider)).withColumn("lo", F.greatest(F.lit(-1.0), F.col("lo") - F.col("x"))).withColumn("hi", F.col("hi") + F.col("x"))
    near = [F.avg(F.abs(F.col("ret") - F.col(k))).alias(f"mae_{k}") for k in ("mid", "base")]
    inside = F.col("ret").between(F.col("lo"), F.col("hi")).cast("double")
    x = g.where("session >= '1999-01-01'").join(one, "bucket").groupBy("bucket", "session").agg(F.avg(inside).alias("cov"), F.avg(F.col("hi") - F.col("lo")).alias("width"), *near)
    r5 = lambda c, name: rnd(F.avg(c), 5).alias(name)
    return x.groupBy("bucket").agg(F.count("*").alias("n_dates"), r5("cov", "coverage"), r5("width", "width"), r5("mae_mid", "median_mae"), r5("mae_base", "baseline_mae"))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark: S, d: str) -> D:
    p = ev.percentiles(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")
    return p.select("event_type", r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95"))


@query("split_counts", "WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w) SELECT CASE WHEN idx >= floor(n * 0.8) THEN 'test' WHEN idx >= floor(n * 0.8) - 21 THEN 'embargo' ELSE 'train' END AS split, count(*) AS n_rows FROM bars_w JOIN c USING (session) GROUP BY 1", ("calendar_w", "bars_w"))
def split_counts(spark: S, d: str) -> D:
    s = lab.assign_split(v.calendar_w(spark, d), 0.2, 21).select("session", "split")
    return v.bars_w(spark, d).join(F.broadcast(s), "session").groupBy("split").agg(F.count("*").alias("n_rows"))


@query("full_history_symbols", "SELECT symbol, count(*) AS n_sessions FROM bars_w GROUP BY 1 HAVING count(*) >= 0.8 * (SELECT count(DISTINCT session) FROM bars_w)", ("bars_w",))
def full_history_symbols(spark: S, d: str) -> D:
    b = v.bars_w(spark, d)
    n = b.agg(F.countDistinct("session").alias("n"))
    return b.groupBy("symbol").agg(F.count("*").alias("n_sessions")).join(F.broadcast(n)).where("n_sessions >= 0.8 * n").drop("n")


@query("feature_coverage", "SELECT 'vol' AS feature, round(avg(CASE WHEN vol IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM panel_w UNION ALL SELECT 'score', round(avg(CASE WHEN score IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM panel_w", P)
def feature_coverage(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).agg(*[r6(F.avg(F.col(c).isNotNull().cast("double"))).alias(c) for c in ("vol", "score")])
    return p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in ("vol", "score")])).alias("x")).select("x.*")


_PAIR = f"a AS (SELECT session, avg(ret) AS r FROM {_TOP} WHERE place <= 5 GROUP BY 1), b AS (SELECT session, avg(ret) AS r FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY vol, symbol) AS n FROM panel_w WHERE vol IS NOT NULL) WHERE n <= 5 GROUP BY 1)"


def _pairs(spark: S, d: str) -> D:
    p = v.panel_w(spark, d)
    a = ev.top_k(p, "score", 5).groupBy("session").agg(F.avg("ret").alias("a"))
    b = ev.top_k(p.where("vol is not null"), "vol", 5, bottom=True).groupBy("session").agg(F.avg("ret").alias("b"))
    return a.join(b, "session").select("session", (F.col("a") - F.col("b")).alias("diff"))


@query("paired_difference", f"WITH {_PAIR} SELECT count(*) AS n_pairs, round(avg(a.r - b.r), 6) AS mean_diff, round(avg(a.r - b.r) FILTER (WHERE a.r <> b.r), 6) AS active_mean FROM a JOIN b USING (session)", P)
def paired_difference(spark: S, d: str) -> D:
    x = _pairs(spark, d)
    return x.agg(F.count("*").alias("n_pairs"), r6(F.avg("diff")).alias("mean_diff"), r6(F.avg(F.when(F.col("diff") != 0, F.col("diff")))).alias("active_mean"))


@query("bootstrap_ci")
def bootstrap_ci(spark: S, d: str) -> D:
    return ev.bootstrap_interval(ev.indexed(_pairs(spark, d)), "diff", 2000)


@query("bootstrap_family")
def bootstrap_family(spark: S, d: str) -> D:
    """Advantages of momentum over three other picks, with intervals that hold for all three at once."""
    p = v.panel_w(spark, d).where("vol is not null")
    mean = lambda df, name: df.groupBy("session").agg(F.avg("ret").alias(name))
    a = mean(ev.top_k(p, "score", 5), "a")
    rivals = {"calm": ev.top_k(p, "vol", 5, bottom=True), "losers": ev.top_k(p, "score", 5, bottom=True), "all": p}
    parts = [a.join(mean(r, "b"), "session").select(F.lit(name).alias("pair"), "session", (F.col("a") - F.col("b")).alias("diff")) for name, r in rivals.items()]
    return ev.bootstrap_family(parts[0].unionByName(parts[1]).unionByName(parts[2]), "pair", "session", "diff")


@query("prospective_summary")
def prospective_summary(spark: S, d: str) -> D:
    """Pairs on a prescheduled grid, gated on coverage of 98 % and 8 pairs, with an interval."""
    x = ev.indexed(_pairs(spark, d)).where("i % 4 = 0")
    n = v.panel_w(spark, d).agg((F.countDistinct("session") / 4).alias("expected"))
    ci = ev.bootstrap_interval(x.withColumn("i", F.expr("i div 4")), "diff", 2000)
    got = x.agg(F.count("*").alias("n_pairs")).join(F.broadcast(n)).withColumn("ready", (F.col("n_pairs") >= 8) & (F.col("n_pairs") >= 0.98 * F.floor("expected")))
    return got.join(F.broadcast(ci))


@query("score_distribution", "SELECT CAST(least(9, greatest(0, floor((score + 1) * 5))) AS BIGINT) AS bucket, count(*) AS n FROM panel_w GROUP BY 1", P)
def score_distribution(spark: S, d: str) -> D:
    return v.panel_w(spark, d).groupBy(F.least(F.lit(9), F.greatest(F.lit(0), F.floor((F.col("score") + 1) * 5))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("score_stability", "SELECT symbol, round(stddev_samp(score), 6) AS score_vol, round(regr_slope(score, epoch(session) / 86400.0) * 365, 5) AS trend FROM panel_w GROUP BY 1", P)
def score_stability(spark: S, d: str) -> D:
    day = F.datediff("session", F.lit("1970-01-01").cast("date")).cast("double")
    return v.panel_w(spark, d).groupBy("symbol").agg(r6(F.stddev_samp("score")).alias("score_vol"), rnd(F.regr_slope(F.col("score"), day) * 365, 5).alias("trend"))


@query("event_counts_7d", """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) // 1000000 - 604800 >= (SELECT min(epoch_us(ts) // 1000000) FROM events) AS covered FROM events)
  SELECT event_id, CASE WHEN covered THEN count(*) FILTER (WHERE event_type = 'purchase') OVER w END AS purchases, CASE WHEN covered THEN count(*) FILTER (WHERE event_type IN ('error', 'signup')) OVER w END AS notices FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)""")
def event_counts_7d(spark: S, d: str) -> D:
    """Counts of a user's last seven days by kind of event; unknown where the archive begins within those days."""
    e = table(spark, d, "events").withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    e = e.join(F.broadcast(e.agg(F.min("sec").alias("since"))))
    w = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-7 * 86400, 0)
    counted = lambda kinds: F.when(F.col("sec") - 7 * 86400 >= F.col("since"), F.count_if(F.col("event_type").rlike(kinds)).over(w))
    return e.select("event_id", counted("^purchase$").alias("purchases"), counted("error|signup").alias("notices"))


@query("liquidity_median", "WITH l AS (SELECT *, idx > (SELECT max(idx) FROM calendar_w) - 26 AS recent FROM bars_x) SELECT symbol, round(quantile_cont(close * volume, 0.5), 4) AS median_value FROM l WHERE recent GROUP BY 1 HAVING count(*) >= 20", ("bars_x", "calendar_w"))
def liquidity_median(spark: S, d: str) -> D:
    last = v.calendar_w(spark, d).agg(F.max("idx").alias("last"))
    b = v.bars_x(spark, d).join(F.broadcast(last)).where("idx > last - 26")
    return b.groupBy("symbol").agg(r4(F.percentile(F.col("close") * F.col("volume"), F.lit(0.5))).alias("median_value"), F.count("*").alias("n")).where("n >= 20").drop("n")


@query("coverage_readiness", """WITH dd AS (SELECT c.session, count(b.close) / count(*) AS frac FROM universe u CROSS JOIN calendar_w c LEFT JOIN bars_w b ON b.symbol = u.symbol AND b.session = c.session GROUP BY 1), q AS (SELECT year(session) * 10 + quarter(session) AS q, avg(frac) AS mean_frac, avg(CASE WHEN frac >= 0.9 THEN 1.0 ELSE 0.0 END) AS pass FROM dd GROUP BY 1)
  SELECT q, round(mean_frac, 6) AS mean_coverage, round(pass, 6) AS days_passed, CASE WHEN mean_frac < 0.8 THEN 'coverage' WHEN pass < 0.9 THEN 'days' END AS reason FROM q""", ("universe", "calendar_w", "bars_w"))
def coverage_readiness(spark: S, d: str) -> D:
    """How much of the grid of symbols and sessions has a bar, by quarter, and why a quarter is not ready."""
    from .features import dense

    day = dense(spark, d).groupBy("session").agg((F.count("close") / F.count("*")).alias("frac"))
    q = day.groupBy((F.year("session") * 10 + F.quarter("session")).cast("long").alias("q")).agg(F.avg("frac").alias("m"), F.avg((F.col("frac") >= 0.9).cast("double")).alias("pass"))
    return q.select("q", r6(F.col("m")).alias("mean_coverage"), r6(F.col("pass")).alias("days_passed"), F.when(F.col("m") < 0.8, "coverage").when(F.col("pass") < 0.9, "days").alias("reason"))


@query("trade_attribution", f"""WITH t AS (SELECT industry, CAST(year(session) * 10 + quarter(session) AS VARCHAR) AS q, ret AS gross, (1 + ret) * 0.999 / 1.001 - 1 AS net FROM {_TOP} WHERE place <= 5)
  SELECT dim, member, count(*) AS trades, round(sum(gross), 5) AS gross, round(sum(net), 5) AS net, round(sum(gross - net), 5) AS cost FROM (SELECT 'total' AS dim, 'all' AS member, gross, net FROM t UNION ALL SELECT 'sector', industry, gross, net FROM t UNION ALL SELECT 'quarter', q, gross, net FROM t) GROUP BY 1, 2""", P)
def trade_attribution(spark: S, d: str) -> D:
    from ..functions.windows import net_return

    t = ev.top_k(v.panel_w(spark, d), "score", 5).withColumn("net", net_return(F.col("ret"), 0.001))
    q = (F.year("session") * 10 + F.quarter("session")).cast("string")
    dims = F.array(*[F.struct(F.lit(a).alias("dim"), b.alias("member")) for a, b in (("total", F.lit("all")), ("sector", F.col("industry")), ("quarter", q))])
    x = t.select(F.explode(dims).alias("x"), "ret", "net").select("x.*", "ret", "net")
    return x.groupBy("dim", "member").agg(F.count("*").alias("trades"), rnd(F.sum("ret"), 5).alias("gross"), rnd(F.sum("net"), 5).alias("net"), rnd(F.sum(F.col("ret") - F.col("net")), 5).alias("cost"))


@query("portfolio_robustness", f"""WITH i AS (SELECT session, close / lag(close, 4) OVER (ORDER BY session) - 1 AS m FROM index_w), r AS (SELECT session, avg(ret) AS r FROM {_TOP} WHERE place <= 5 GROUP BY 1), x AS (SELECT r, m, year(session) AS y FROM r JOIN i USING (session) WHERE m IS NOT NULL)
  SELECT y, count(*) AS n, round(covar_samp(r, m) / var_samp(m), 4) AS beta, round(avg(r) - covar_samp(r, m) / var_samp(m) * avg(m), 5) AS residual, round(exp(sum(ln(1 + r / 10))) - 1, 5) AS compounded FROM x GROUP BY 1""", ("panel_w", "index_w"))
def portfolio_robustness(spark: S, d: str) -> D:
    i = v.index_w(spark, d).select("session", change(F.col("close"), 4, series("session")).alias("m"))
    r = ev.top_k(v.panel_w(spark, d), "score", 5).groupBy("session").agg(F.avg("ret").alias("r"))
    x = r.join(F.broadcast(i), "session").where("m is not null")
    beta = F.covar_samp("r", "m") / F.var_samp("m")
    return x.groupBy(F.year("session").cast("long").alias("y")).agg(F.count("*").alias("n"), r4(beta).alias("beta"), rnd(F.avg("r") - beta * F.avg("m"), 5).alias("residual"), rnd(ev.compounded(F.col("r") / 10), 5).alias("compounded"))


@query("pnl_concentration", f"""WITH t AS (SELECT year(session) AS y, symbol, greatest(sum(ret), 0) AS gain FROM {_TOP} WHERE place <= 5 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY gain DESC, symbol) AS place FROM t)
  SELECT y, count(*) AS n_symbols, CASE WHEN sum(gain) > 0 THEN round(max(gain) / sum(gain), 5) END AS top_share, CASE WHEN sum(gain) > 0 THEN round(sum(gain) FILTER (WHERE place <= 5) / sum(gain), 5) END AS top_five_share FROM o GROUP BY 1""", P)
def pnl_concentration(spark: S, d: str) -> D:
    """Share of a year's gains that the best symbol, and the best five, made."""
    t = ev.top_k(v.panel_w(spark, d), "score", 5).groupBy(F.year("session").cast("long").alias("y"), "symbol").agg(F.greatest(F.sum("ret"), F.lit(0.0)).alias("gain"))
    o = t.withColumn("place", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("gain"), "symbol")))
    share = lambda part: F.when(F.sum("gain") > 0, rnd(part / F.sum("gain"), 5))
    return o.groupBy("y").agg(F.count("*").alias("n_symbols"), share(F.max("gain")).alias("top_share"), share(F.sum(F.when(F.col("place") <= 5, F.col("gain")))).alias("top_five_share"))


@query("regime_contribution", f"""WITH i AS (SELECT session, CASE WHEN close >= avg(close) OVER (ORDER BY session ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) THEN 'above' ELSE 'below' END AS regime FROM index_w), r AS (SELECT session, avg(ret) AS r, count(*) / 10 AS exposure FROM {_TOP} WHERE place <= 5 GROUP BY 1)
  SELECT regime, count(*) AS n_dates, round(sum(ln(1 + r * exposure)), 5) AS log_growth, round(avg(exposure), 5) AS mean_exposure FROM r JOIN i USING (session) GROUP BY 1""", ("panel_w", "index_w"))
def regime_contribution(spark: S, d: str) -> D:
    """What a portfolio of a tenth of the capital in each of five picks made while the market stood above its average, and below."""
    c = F.col("close")
    above = c >= F.avg(c).over(Window.orderBy("session").rowsBetween(-39, 0))
    i = v.index_w(spark, d).select("session", F.when(above, "above").otherwise("below").alias("regime"))
    r = ev.top_k(v.panel_w(spark, d), "score", 5).groupBy("session").agg(F.avg("ret").alias("r"), (F.count("*") / 10).alias("exposure"))
    x = r.join(F.broadcast(i), "session")
    return x.groupBy("regime").agg(F.count("*").alias("n_dates"), rnd(F.sum(F.log1p(F.col("r") * F.col("exposure"))), 5).alias("log_growth"), rnd(F.avg("exposure"), 5).alias("mean_exposure"))


# folds and model choice


@query("time_validation_split", "WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w) SELECT session, CASE WHEN idx >= floor(n * 0.85) THEN 'validation' WHEN idx < floor(n * 0.85) - 4 THEN 'fit' END AS part FROM c WHERE NOT (idx >= floor(n * 0.85) - 4 AND idx < floor(n * 0.85))", ("calendar_w",))
def time_validation_split(spark: S, d: str) -> D:
    s = lab.assign_split(v.calendar_w(spark, d), 0.15, 4).where("split <> 'embargo'")
    return s.select("session", F.when(F.col("split") == "test", "validation").otherwise("fit").alias("part"))


@query("walk_forward_folds", """WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w), f AS (SELECT unnest(range(5)) AS fold), x AS (SELECT fold, idx, n, floor(n * 0.4) + fold * floor(n * (1 - 0.4) / 5) AS s FROM c, f), y AS (SELECT *, CASE WHEN fold = 4 THEN n ELSE s + floor(n * (1 - 0.4) / 5) END AS e FROM x)
  SELECT fold, idx, CASE WHEN idx >= s AND idx < e THEN 'test' ELSE 'train' END AS role FROM y WHERE (idx >= s AND idx < e) OR idx < s - 4""", ("calendar_w",))
def walk_forward_folds(spark: S, d: str) -> D:
    return lab.expanding_folds(v.calendar_w(spark, d), 5, 4).withColumn("fold", F.col("fold").cast("long"))


@query("purged_kfold", """WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w), f AS (SELECT unnest(range(5)) AS fold), x AS (SELECT fold, idx, floor(fold * n / 5) AS s, floor((fold + 1) * n / 5) AS e FROM c, f)
  SELECT fold, idx, CASE WHEN idx >= s AND idx < e THEN 'test' ELSE 'train' END AS role FROM x WHERE (idx >= s AND idx < e) OR idx < s - 4 OR idx >= e + 4""", ("calendar_w",))
def purged_kfold(spark: S, d: str) -> D:
    return lab.purged_folds(v.calendar_w(spark, d), 5, 4).withColumn("fold", F.col("fold").cast("long"))


@query("maturity_purge", "SELECT p.symbol, p.session FROM panel_w p JOIN calendar_w c ON p.session = c.session WHERE c.idx + 4 < (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM calendar_w)", ("panel_w", "calendar_w"))
def maturity_purge(spark: S, d: str) -> D:
    c = v.calendar_w(spark, d)
    start = c.agg(F.floor(F.count("*") * 0.8).alias("start"))
    ripe = c.join(F.broadcast(start)).where("idx + 4 < start").select("session")
    return v.panel_w(spark, d).select("symbol", "session").join(F.broadcast(ripe), "session", "left_semi")


def fold_metrics(spark: S, d: str) -> D:
    """label, fold, ic, net: measures of two formula models by year."""
    p = v.panel_w(spark, d).where("vol is not null")
    both = p.withColumn("m", F.explode(F.array(F.struct(F.lit("momentum").alias("label"), F.col("score").alias("s")), F.struct(F.lit("calm").alias("label"), (-F.col("vol")).alias("s"))))).select("m.*", "session", "symbol", "ret")
    ic = ev.rank_ic(both, "s", "ret", ["label", "session"])
    return ic.groupBy("label", F.year("session").cast("long").alias("fold")).agg(F.avg("ic").alias("ic"), (F.avg("ic") / F.stddev_samp("ic")).alias("ir"))


_FM = f"both_ AS (SELECT 'momentum' AS label, session, symbol, score AS s, ret FROM panel_w WHERE vol IS NOT NULL UNION ALL SELECT 'calm', session, symbol, -vol, ret FROM panel_w WHERE vol IS NOT NULL), ic_ AS ({_ic_sql('s', 'label, session', 'both_')}), fm AS (SELECT label, year(session) AS fold, avg(ic) AS ic, avg(ic) / stddev_samp(ic) AS ir FROM ic_ GROUP BY 1, 2)"


@query("select_best", f"WITH {_FM} SELECT fold, arg_max(label, ic) AS best, round(max(ic), 6) AS ic FROM fm GROUP BY 1", P)
def select_best(spark: S, d: str) -> D:
    b = fold_metrics(spark, d).groupBy("fold").agg(F.max(F.struct("ic", "ir", "label")).alias("b"))
    return b.select("fold", F.col("b.label").alias("best"), r6(F.col("b.ic")).alias("ic"))


@query("selection_gate", f"WITH {_FM} SELECT label, round(avg(ic), 6) AS mean_ic, avg(ic) > 0 AS adopted, count(*) FILTER (WHERE ic > 0) AS folds_positive FROM fm GROUP BY 1", P)
def selection_gate(spark: S, d: str) -> D:
    return fold_metrics(spark, d).groupBy("label").agg(r6(F.avg("ic")).alias("mean_ic"), (F.avg("ic") > 0).alias("adopted"), F.count_if(F.col("ic") > 0).alias("folds_positive"))


@query("choose_config", f"WITH {_FM}, c AS (SELECT label, round(avg(ic), 2) AS metric, CASE label WHEN 'momentum' THEN 0 ELSE 1 END AS idx FROM fm GROUP BY 1) SELECT label AS chosen, metric FROM c ORDER BY metric DESC, idx LIMIT 1", P)
def choose_config(spark: S, d: str) -> D:
    c = fold_metrics(spark, d).groupBy("label").agg(rnd(F.avg("ic"), 2).alias("metric")).withColumn("idx", F.when(F.col("label") == "momentum", 0).otherwise(1))
    return c.agg(F.max(F.struct("metric", (-F.col("idx")).alias("o"), "label")).alias("b")).select(F.col("b.label").alias("chosen"), "b.metric")


@query("qualify_reasons", f"WITH {_FM} SELECT label, fold, concat_ws(',', CASE WHEN ic <= 0 THEN 'ic' END, CASE WHEN ir < 0.1 THEN 'ir' END, CASE WHEN fold < 1996 THEN 'short' END) AS reasons FROM fm", P)
def qualify_reasons(spark: S, d: str) -> D:
    why = F.array_compact(F.array(F.when(F.col("ic") <= 0, "ic"), F.when(F.col("ir") < 0.1, "ir"), F.when(F.col("fold") < 1996, "short")))
    return fold_metrics(spark, d).select("label", "fold", F.array_join(why, ",").alias("reasons"))


def _split(spark: S, d: str) -> tuple[D, D]:
    """(rows that end before the last fifth of the sessions and an embargo, rows of that fifth), with known features."""
    p = v.panel_w(spark, d).where("vol is not null")
    parts = F.broadcast(lab.assign_split(v.calendar_w(spark, d), 0.2, 4).select("session", "split"))  # one row a session
    both = written(p.join(parts, "session"), "split-panel")  # learners read it many times
    return both.where("split not in ('test', 'embargo')").drop("split"), both.where("split = 'test'").drop("split")


@query("model_score")
def model_score(spark: S, d: str) -> D:
    """Fit on the past, score the last fifth of the sessions with an ensemble of two learners, rank each session."""
    from ..operators.learning import ensemble_scores

    return ensemble_scores(*_split(spark, d), ["score", "vol"], "ret")


@query("model_reload", "WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w) SELECT session, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM panel_w JOIN c USING (session) WHERE idx >= floor(n * 0.8) AND vol IS NOT NULL GROUP BY 1", ("panel_w", "calendar_w"))
def model_reload(spark: S, d: str) -> D:
    """Scores of an ensemble that was saved and loaded again, against those of the one that was fitted."""
    from ..operators.learning import ensemble_mean, fitted, load_ensemble, save_ensemble
    from ..sources.tables import new_path

    rename = lambda df: df.withColumnRenamed("score", "momentum")
    train, rows = map(rename, _split(spark, d))
    models, path = {k: fitted(train, ["momentum", "vol"], "ret", k) for k in ("linear", "forest")}, new_path(spark, "ensemble")
    save_ensemble(models, path)
    first, again = (ensemble_mean(m, rows.select("symbol", "session", "momentum", "vol")) for m in (models, load_ensemble(path, list(models))))
    both = first.join(again.select("symbol", "session", F.col("score").alias("again")), ["symbol", "session"])
    return both.groupBy("session").agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") != F.col("again")).alias("n_changed"))


@query("assembled_rows", "SELECT session, count(*) AS n_rows, round(sum(score + 2 * vol), 4) AS total FROM panel_w WHERE vol IS NOT NULL GROUP BY 1", P)
def assembled_rows(spark: S, d: str) -> D:
    """Rows whose features are all known, as vectors; the others are passed over."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=["score", "vol"], outputCol="features", handleInvalid="skip").transform(v.panel_w(spark, d))
    x = vector_to_array("features")
    return rows.groupBy("session").agg(F.count("*").alias("n_rows"), r4(F.sum(x[0] + 2 * x[1])).alias("total"))


_RIDGES = (0.0, 0.05, 0.5, 5.0)


@query("grid_choice", f"""WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w), p AS (SELECT panel_w.*, CASE WHEN idx >= floor(n * 0.8) THEN 'test' WHEN idx < floor(n * 0.8) - 4 THEN 'train' END AS part FROM panel_w JOIN c ON c.session = panel_w.session WHERE vol IS NOT NULL),
  m AS (SELECT avg(ret) AS my, avg(score) AS mx, covar_pop(ret, score) / var_pop(score) AS w, stddev_samp(ret) AS sy FROM p WHERE part = 'train'), g AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in _RIDGES)}]) AS ridge),
  e AS (SELECT ridge, sqrt(avg((ret - my - w / (1 + ridge / sy) * (score - mx)) * (ret - my - w / (1 + ridge / sy) * (score - mx)))) AS rmse FROM g, m, p WHERE part = 'test' GROUP BY 1)
  SELECT ridge, round(rmse, 5) AS rmse, rmse = (SELECT min(rmse) FROM e) AS chosen FROM e""", ("panel_w", "calendar_w"))
def grid_choice(spark: S, d: str) -> D:
    """A grid of penalties by the error on later sessions; one that the learner refuses is passed over."""
    from ..operators.learning import tune

    train, check = _split(spark, d)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        best, _ = tune(train, check, ["score"], "ret", "linear", [{"regParam": -1.0}, *[{"regParam": r} for r in _RIDGES]])
    found = [(r, tune(train, check, ["score"], "ret", "linear", [{"regParam": r}])[1], best["regParam"] == r) for r in _RIDGES]  # one row a setting
    return spark.createDataFrame(found, "ridge double, rmse double, chosen boolean").withColumn("rmse", rnd(F.col("rmse"), 5))


@query("prospective_gate", f"WITH {_PAIR}, x AS (SELECT row_number() OVER (ORDER BY session) - 1 AS i, a.r - b.r AS diff FROM a JOIN b USING (session)), g AS (SELECT count(*) AS n_pairs, avg(diff) AS m FROM x WHERE i % 4 = 0) SELECT n_pairs, (SELECT count(DISTINCT session) FROM panel_w) / 4.0 AS expected, n_pairs >= 8 AND n_pairs >= 0.98 * floor((SELECT count(DISTINCT session) FROM panel_w) / 4.0) AS ready, round(m, 6) AS mean FROM g", P)
def prospective_gate(spark: S, d: str) -> D:
    """As prospective_summary, without the interval that is drawn."""
    return prospective_summary(spark, d).select("n_pairs", "expected", "ready", r6(F.col("mean")).alias("mean"))


@query("feature_ablation")
def feature_ablation(spark: S, d: str) -> D:
    """Every feature set, label and learner, fitted on the past and checked on the last fifth of the sessions."""
    from ..operators.learning import ablation

    parts = []
    for x in _split(spark, d):  # written with the label: every learner reads it several times
        means = F.broadcast(x.groupBy("session").agg(F.avg("ret").alias("mean")))  # one row a session
        parts.append(written(x.select("session", "score", "vol", "ret").join(means, "session").select("score", "vol", "ret", (F.col("ret") - F.col("mean")).alias("demeaned")), "ablation"))
    train, rows = parts
    sets = {"momentum": ["score"], "risk": ["vol"], "both": ["score", "vol"]}
    found = ablation(train, rows, sets, ["ret", "demeaned"], ["linear", "forest"])  # one row a combination
    return spark.createDataFrame(found, "feature_set string, label string, learner string, n_rows long, rmse double")


@query("platt_probability")
def platt_probability(spark: S, d: str) -> D:
    """Chance of a positive return by a curve that was fitted on the scores of the sessions before the last fifth."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.learning import platt

    train, rows = (x.withColumn("up", (F.col("ret") > 0).cast("double")) for x in _split(spark, d))
    model = platt(train, "score", "up")
    if model is None:
        return rows.select("symbol", "session", "score", F.lit(None).cast("double").alias("probability"))
    return model.transform(rows).select("symbol", "session", "score", vector_to_array("platt")[1].alias("probability"))


_PPF = {k: list(map(repr, c)) for k, c in (("a", PPF_A), ("b", PPF_B), ("c", PPF_C), ("d", PPF_D))}


def _horner(x: str, name: str) -> str:
    out = _PPF[name][0] + "::DOUBLE"
    for c in _PPF[name][1:]:
        out = f"(({out}) * {x} + ({c}::DOUBLE))"
    return out


@query("normal_scores", f"""WITH r AS (SELECT symbol, session, (rank() OVER (PARTITION BY session ORDER BY score) + (count(*) OVER (PARTITION BY session, score) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY session) AS p FROM panel_w),
  x AS (SELECT *, least(p, 1 - p) AS low, sqrt(-2 * ln(least(p, 1 - p))) AS q, p - 0.5 AS z FROM r)
  SELECT symbol, session, round(CASE WHEN low >= {PPF_TAIL} THEN {_horner('(z * z)', 'a')} * z / {_horner('(z * z)', 'b')} ELSE sign(p - 0.5) * -1 * {_horner('q', 'c')} / {_horner('q', 'd')} END, 5) AS normal_score FROM x""", P)
def normal_scores(spark: S, d: str) -> D:
    """Ranks as quantiles of the standard normal distribution."""
    r = ranked(v.panel_w(spark, d).select("symbol", "session", "score"), {"place": F.col("score")}, "session", keep=("symbol",))
    return r.select("symbol", "session", rnd(normal_ppf((F.col("place") - 0.5) / F.col("n_place")), 5).alias("normal_score"))


def _spans(spark: S, d: str) -> list[tuple[str, str]]:
    """First session and the day after the last one of each fold's test span; one row a fold comes to the driver."""
    c = v.calendar_w(spark, d)
    tests = lab.expanding_folds(c, 5, 4).where("role = 'test'").join(c, "idx").groupBy("fold").agg(F.min("session").alias("start"), F.date_add(F.max("session"), 1).alias("end"))
    return [(str(r["start"]), str(r["end"])) for r in tests.orderBy("fold").collect()]


@query("walk_forward_ic")
def walk_forward_ic(spark: S, d: str) -> D:
    from ..operators.learning import walk_forward

    p, spans = written(v.panel_w(spark, d).where("vol is not null"), "fold-panel"), _spans(spark, d)
    out = walk_forward(p, ["score", "vol"], "ret", spans, embargo_days=28)
    return ev.rank_ic(out, "prediction", "ret", ["fold", "session"]).groupBy("fold").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_dates"))


@query("fold_predictions", """WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w), f AS (SELECT unnest(range(5)) AS fold), x AS (SELECT fold, n, floor(n * 0.4) + fold * floor(n * (1 - 0.4) / 5) AS s, CASE WHEN fold = 4 THEN n ELSE floor(n * 0.4) + (fold + 1) * floor(n * (1 - 0.4) / 5) END AS e FROM f, (SELECT any_value(n) AS n FROM c)),
  t AS (SELECT fold, min(session) AS first, max(session) AS last FROM x JOIN c ON idx >= s AND idx < e GROUP BY 1), m AS (SELECT fold, regr_slope(ret, score) AS b, regr_intercept(ret, score) AS a FROM t JOIN panel_w ON session < first - 28 GROUP BY 1)
  SELECT fold, count(*) AS n_rows, round(avg(a + b * score), 4) AS mean_prediction, round(sqrt(avg((ret - a - b * score) * (ret - a - b * score))), 4) AS rmse FROM t JOIN m USING (fold) JOIN panel_w ON session BETWEEN first AND last GROUP BY 1""", ("panel_w", "calendar_w"))
def fold_predictions(spark: S, d: str) -> D:
    """Predictions of all folds put together: each by least squares on the sessions that end four weeks before its test span, all from one pass."""
    from ..operators.moments import linear_folds, session_moments

    found = linear_folds(session_moments(v.panel_w(spark, d), ["score"], ["ret"]), ["score"], "ret", _spans(spark, d), 28)  # one row a fold
    out = spark.createDataFrame([f[:4] for f in found], "fold long, n_rows long, mean_prediction double, rmse double")
    return out.withColumn("mean_prediction", r4(F.col("mean_prediction"))).withColumn("rmse", r4(F.col("rmse")))


_ABLATION = """WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w), p AS (SELECT panel_w.*, ret - avg(ret) OVER (PARTITION BY panel_w.session) AS demeaned, CASE WHEN idx >= floor(n * 0.8) THEN 'test' WHEN idx < floor(n * 0.8) - 4 THEN 'train' END AS part FROM panel_w JOIN c ON c.session = panel_w.session WHERE vol IS NOT NULL),
  x AS (SELECT part, label, CASE label WHEN 'ret' THEN ret ELSE demeaned END AS y, score, vol FROM p, (SELECT unnest(['ret', 'demeaned']) AS label) WHERE part IS NOT NULL),
  m AS (SELECT label, avg(y) AS my, avg(score) AS m1, avg(vol) AS m2, covar_pop(y, score) AS y1, covar_pop(y, vol) AS y2, covar_pop(score, vol) AS c12, var_pop(score) AS v1, var_pop(vol) AS v2 FROM x WHERE part = 'train' GROUP BY 1),
  w AS (SELECT label, 'momentum' AS feature_set, my, m1, m2, y1 / v1 AS a, 0.0 AS b FROM m UNION ALL SELECT label, 'risk', my, m1, m2, 0.0, y2 / v2 FROM m UNION ALL SELECT label, 'both', my, m1, m2, (y1 * v2 - y2 * c12) / (v1 * v2 - c12 * c12), (y2 * v1 - y1 * c12) / (v1 * v2 - c12 * c12) FROM m)
  SELECT feature_set, w.label, count(*) AS n_rows, round(sqrt(avg((y - my - a * (score - m1) - b * (vol - m2)) * (y - my - a * (score - m1) - b * (vol - m2)))), 5) AS rmse FROM w JOIN x ON x.label = w.label AND part = 'test' GROUP BY 1, 2"""


@query("linear_ablation", _ABLATION, ("panel_w", "calendar_w"))
def linear_ablation(spark: S, d: str) -> D:
    """Linear fits of every feature set and label on the past, checked on the last fifth of the sessions, all from one pass over the panel."""
    from ..operators import moments

    p = v.panel_w(spark, d).where("vol is not null").withColumn("demeaned", F.col("ret") - F.avg("ret").over(by()))
    split = lab.assign_split(v.calendar_w(spark, d), 0.2, 4).groupBy("split").agg(F.min("session").alias("first"))
    first = {r["split"]: str(r["first"]) for r in split.collect()}
    m = moments.session_moments(p, ["score", "vol"], ["ret", "demeaned"])
    found = moments.linear_ablation(m, {"momentum": ["score"], "risk": ["vol"], "both": ["score", "vol"]}, ["ret", "demeaned"], first["embargo"], first["test"])
    return spark.createDataFrame(found, "feature_set string, label string, n_rows long, rmse double").withColumn("rmse", rnd(F.col("rmse"), 5))


@query("linear_attribution", """WITH m AS (SELECT covar_samp(ret, score) AS y1, covar_samp(ret, vol) AS y2, covar_samp(score, vol) AS c, var_samp(score) AS v1, var_samp(vol) AS v2 FROM panel_w WHERE vol IS NOT NULL)
  SELECT 'score' AS feature, round((y1 * v2 - y2 * c) / (v1 * v2 - c * c), 4) AS weight FROM m UNION ALL SELECT 'vol', round((y2 * v1 - y1 * c) / (v1 * v2 - c * c), 4) FROM m""", P)
def linear_attribution(spark: S, d: str) -> D:
    """Weights of a least-squares model; rows with an unknown feature do not train."""
    from ..operators.learning import attribution, fitted

    features = ["score", "vol"]
    weights = attribution(fitted(v.panel_w(spark, d), features, "ret", "linear", regParam=0.0), features)  # one number a feature
    return spark.createDataFrame(list(weights.items()), "feature string, weight double").select("feature", r4(F.col("weight")).alias("weight"))
