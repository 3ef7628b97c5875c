"""Screens, overviews and top lists over the latest snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import change, need, r4, r6, series, rnd
from ..operators.evaluation import top_k
from ..plans import views as v
from .joins import SNAP, SNAPV, snapshot
from .registry import query

D, S = DataFrame, SparkSession


@query("picks", """WITH b AS (SELECT symbol, trade_date, close, CASE WHEN count(*) OVER f = 20 THEN round(avg(close) OVER f, 4) END AS sma_20, round(close / lag(close, 63) OVER w - 1, 6) AS momentum FROM bars_d
    WINDOW w AS (PARTITION BY symbol ORDER BY trade_date), f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM b), r AS (SELECT *, row_number() OVER (ORDER BY momentum DESC, symbol) AS rank FROM l WHERE n = 1 AND momentum IS NOT NULL)
  SELECT r.symbol, industry, trade_date, close, sma_20, momentum, rank FROM r JOIN universe USING (symbol) WHERE rank <= 20""", ("bars_d", "universe"))
def picks(spark: S, d: str) -> D:
    """The flagship: latest state of each symbol, ranked by three-month momentum, the top 20 with their industry."""
    w = series()
    b = v.bars_d(spark, d).select("symbol", "trade_date", "close", r4(need(20, F.col("close"), F.avg, w)).alias("sma_20"), r6(change(F.col("close"), 63, w)).alias("momentum"))
    last = b.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("trade_date")))).where("n = 1 and momentum is not null")
    ranked = last.orderBy(F.desc("momentum"), "symbol").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("momentum"), "symbol")).cast("long"))
    return ranked.join(v.universe(spark, d).select("symbol", "industry"), "symbol").select("symbol", "industry", "trade_date", "close", "sma_20", "momentum", "rank")


@query("topk_per_date", "SELECT session, symbol, score, place FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS place FROM panel_w) WHERE place <= 10", ("panel_w",))
def topk_per_date(spark: S, d: str) -> D:
    return top_k(v.panel_w(spark, d), "score", 10).select("session", "symbol", "score", F.col("place").cast("long").alias("place"))


def screen(rows: D, industries: list[str] | None = None, bounds: dict[str, tuple[float | None, float | None]] | None = None, positive_pe: bool = True) -> D:
    """Rows that pass every test that is given; positive_pe also drops unknown ratios."""
    tests: list[Column] = [F.lit(True)]
    if industries:
        tests.append(F.col("industry").isin(industries))
    for c, (low, high) in (bounds or {}).items():
        tests += [F.col(c) >= low] if low is not None else []
        tests += [F.col(c) <= high] if high is not None else []
    if positive_pe:
        tests.append(F.col("pe") > 0)
    return rows.where(reduce(lambda a, b: a & b, tests))


@query("screen", f"WITH {SNAP} SELECT symbol, industry, close, pe, score FROM snap WHERE industry IN ('ASIA', 'EUROPE', 'AMERICA') AND score >= -0.5 AND score <= 2 AND volume >= 10 AND pe > 0", SNAPV)
def screen_q(spark: S, d: str) -> D:
    return screen(snapshot(spark, d), ["ASIA", "EUROPE", "AMERICA"], {"score": (-0.5, 2), "volume": (10, None)}).select("symbol", "industry", "close", "pe", "score")


@query("screen_page", f"WITH {SNAP} SELECT symbol, score FROM snap ORDER BY score DESC NULLS LAST, symbol LIMIT 20 OFFSET 10", SNAPV)
def screen_page(spark: S, d: str) -> D:
    return snapshot(spark, d).orderBy(F.desc_nulls_last("score"), "symbol").offset(10).limit(20).select("symbol", "score")


@query("rule_score", f"WITH {SNAP} SELECT symbol, coalesce(CAST(score > 0 AS INT), 0) + coalesce(CAST(change > 0 AS INT), 0) + coalesce(CAST(volume > 50 AS INT), 0) + coalesce(CAST(pe < 1 AS INT), 0) AS points FROM snap", SNAPV)
def rule_score(spark: S, d: str) -> D:
    tests = [F.col("score") > 0, F.col("change") > 0, F.col("volume") > 50, F.col("pe") < 1]
    return snapshot(spark, d).select("symbol", reduce(lambda a, b: a + b, [F.coalesce(t.cast("int"), F.lit(0)) for t in tests]).alias("points"))


@query("screen_rules", f"WITH {SNAP} SELECT symbol, industry, pe FROM (SELECT *, avg(pe) OVER (PARTITION BY industry) AS m FROM snap) WHERE pe < m AND score > -0.5", SNAPV)
def screen_rules(spark: S, d: str) -> D:
    s = snapshot(spark, d).withColumn("m", F.avg("pe").over(Window.partitionBy("industry")))
    return s.where("pe < m and score > -0.5").select("symbol", "industry", "pe")


@query("market_breadth", f"WITH {SNAP} SELECT count(*) FILTER (WHERE coalesce(change, 0) > 0) AS advancers, count(*) FILTER (WHERE coalesce(change, 0) < 0) AS decliners, count(*) FILTER (WHERE coalesce(change, 0) = 0) AS unchanged, round(avg(coalesce(change, 0)), 6) AS mean_change FROM snap", SNAPV)
def market_breadth(spark: S, d: str) -> D:
    c = F.coalesce("change", F.lit(0.0))
    return snapshot(spark, d).agg(F.count_if(c > 0).alias("advancers"), F.count_if(c < 0).alias("decliners"), F.count_if(c == 0).alias("unchanged"), r6(F.avg(c)).alias("mean_change"))


@query("sector_performance", f"WITH {SNAP} SELECT industry, count(*) AS n, round(avg(coalesce(change, 0)), 6) AS mean_change, count(*) FILTER (WHERE change > 0) AS advancers, count(*) FILTER (WHERE change < 0) AS decliners, round(avg(CASE WHEN pe > 0 THEN pe END), 5) AS mean_pe FROM snap GROUP BY 1", SNAPV)
def sector_performance(spark: S, d: str) -> D:
    c = F.col("change")
    return snapshot(spark, d).groupBy("industry").agg(F.count("*").alias("n"), r6(F.avg(F.coalesce(c, F.lit(0.0)))).alias("mean_change"), F.count_if(c > 0).alias("advancers"), F.count_if(c < 0).alias("decliners"), rnd(F.avg(F.when(F.col("pe") > 0, F.col("pe"))), 5).alias("mean_pe"))


@query("industry_counts", "SELECT industry, count(*) AS n FROM universe GROUP BY 1", ("universe",))
def industry_counts(spark: S, d: str) -> D:
    return v.universe(spark, d).groupBy("industry").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "industry")


@query("gainers_losers", f"WITH {SNAP} (SELECT 'gain' AS side, symbol, change FROM snap WHERE change IS NOT NULL AND change <> 0 ORDER BY change DESC, symbol LIMIT 10) UNION ALL (SELECT 'loss', symbol, change FROM snap WHERE change IS NOT NULL AND change <> 0 ORDER BY change, symbol LIMIT 10)", SNAPV)
def gainers_losers(spark: S, d: str) -> D:
    s = snapshot(spark, d).where("change is not null and change <> 0").select("symbol", "change")
    up = s.orderBy(F.desc("change"), "symbol").limit(10).withColumn("side", F.lit("gain"))
    return up.unionByName(s.orderBy("change", "symbol").limit(10).withColumn("side", F.lit("loss")))


@query("symbol_history", "SELECT trade_date, close, volume FROM bars_d WHERE symbol = 7 AND trade_date >= DATE '2000-01-01' ORDER BY trade_date LIMIT 2000", ("bars_d",))
def symbol_history(spark: S, d: str) -> D:
    return v.bars_d(spark, d).where("symbol = 7 and trade_date >= '2000-01-01'").orderBy("trade_date").limit(2000).select("trade_date", "close", "volume")


@query("symbol_detail", f"WITH {SNAP} SELECT symbol, session, close, industry, sub_industry, score, rank FROM snap WHERE symbol = 7", SNAPV)
def symbol_detail(spark: S, d: str) -> D:
    return snapshot(spark, d).where("symbol = 7").select("symbol", "session", "close", "industry", "sub_industry", "score", "rank")


@query("capped_topk", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY session, industry ORDER BY score DESC, symbol) AS k FROM panel_w), y AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS place FROM x WHERE k <= 3) SELECT session, symbol, industry, place FROM y WHERE place <= 10", ("panel_w",))
def capped_topk(spark: S, d: str) -> D:
    k = F.row_number().over(Window.partitionBy("session", "industry").orderBy(F.desc("score"), "symbol"))
    return top_k(v.panel_w(spark, d).withColumn("k", k).where("k <= 3"), "score", 10).select("session", "symbol", "industry", F.col("place").cast("long").alias("place"))
