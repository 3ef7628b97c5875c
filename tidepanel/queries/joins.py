"""Joins: dimensions, as-of and bitemporal facts, coverage, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import change, r6, rnd, series
from ..operators.asof import asof_join, newest_known
from ..operators.ingest import latest_rows
from ..plans import views as v
from ..sources.tables import table
from .registry import query

D, S = DataFrame, SparkSession


def ws():
    return series("session")


@query("join_features", "SELECT p.symbol, p.session, p.score, b.close FROM panel_w p JOIN bars_w b ON p.symbol = b.symbol AND p.session = b.session", ("panel_w", "bars_w"))
def join_features(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", "score").join(v.bars_w(spark, d).select("symbol", "session", "close"), ["symbol", "session"])


@query("join_dim_broadcast", "SELECT symbol, trade_date, close, industry FROM bars_d LEFT JOIN universe USING (symbol)", ("bars_d", "universe"))
def join_dim_broadcast(spark: S, d: str) -> D:
    return v.bars_d(spark, d).select("symbol", "trade_date", "close").join(v.universe(spark, d).select("symbol", "industry"), "symbol", "left")


def snapshot(spark: S, d: str) -> D:
    """Latest state per symbol: last bar and its change, newest statement, momentum and calm ranks of the bar's session, dimension."""
    b = v.bars_w(spark, d).withColumn("chg", change(F.col("close"), 1, ws()))
    last = latest_rows(b, ["symbol"], F.desc("session")).select("symbol", "session", "close", "volume", r6(F.col("chg")).alias("change"))
    facts = latest_rows(v.statements(spark, d), ["symbol"], F.desc("period_end")).select("symbol", "revenue", "net_income", "shares", "equity")
    rank = lambda c: F.row_number().over(Window.partitionBy("session").orderBy(F.desc(c), "symbol")).cast("long")
    m = b.withColumn("score", r6(change(F.col("close"), 13, ws()))).where("score is not null").select("symbol", "session", "score", rank("score").alias("rank"))
    out = last.join(facts, "symbol", "left").join(m, ["symbol", "session"], "left")
    pe = F.when(F.col("net_income") > 0, r6(F.col("close") * F.col("shares") / F.col("net_income") / 1000))
    return out.join(v.universe(spark, d).select("symbol", "industry", "sub_industry"), "symbol", "left").withColumn("pe", pe)


SNAP = """snap AS (WITH b AS (SELECT *, close / lag(close) OVER w - 1 AS chg, round(close / lag(close, 13) OVER w - 1, 6) AS score, row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS n FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session)),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS n FROM statements) WHERE n = 1),
  m AS (SELECT symbol, session, score, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS rank FROM b WHERE score IS NOT NULL)
  SELECT b.symbol, b.session, b.close, b.volume, round(b.chg, 6) AS change, f.revenue, f.net_income, f.shares, f.equity, m.score, m.rank, u.industry, u.sub_industry, CASE WHEN net_income > 0 THEN round(b.close * f.shares / f.net_income / 1000, 6) END AS pe
  FROM b LEFT JOIN f ON f.symbol = b.symbol LEFT JOIN m ON m.symbol = b.symbol AND m.session = b.session LEFT JOIN universe u ON u.symbol = b.symbol WHERE b.n = 1)"""
SNAPV = ("bars_w", "statements", "universe")


@query("screener_snapshot", f"WITH {SNAP} SELECT symbol, session, close, volume, change, revenue, net_income, score, rank, industry, pe FROM snap", SNAPV)
def screener_snapshot(spark: S, d: str) -> D:
    return snapshot(spark, d).select("symbol", "session", "close", "volume", "change", "revenue", "net_income", "score", "rank", "industry", "pe")


def _lag_sql(age: str = "") -> str:
    return f"SELECT b.symbol, b.session, CASE WHEN f.known_at IS NOT NULL {age} THEN revenue END AS revenue FROM bars_w b ASOF LEFT JOIN (SELECT *, (period_end + 90)::DATE AS known_at FROM statements) f ON b.symbol = f.symbol AND b.session >= f.known_at"


@query("asof_statements", _lag_sql(), ("bars_w", "statements"))
def asof_statements(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session")
    return asof_join(b, v.statements(spark, d), "symbol", F.col("session"), F.date_add("period_end", 90), ["revenue"])


@query("asof_max_age", _lag_sql("AND date_diff('day', f.known_at, b.session) <= 200"), ("bars_w", "statements"))
def asof_max_age(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session")
    return asof_join(b, v.statements(spark, d), "symbol", F.col("session"), F.date_add("period_end", 90), ["revenue"], max_age_days=200)


@query("asof_join", """WITH q AS (SELECT user_id AS customer, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY 1, 2), o AS (SELECT o_custkey AS customer, (CAST(o_orderdate AS DATE) + INTERVAL 8 YEAR)::DATE AS day, max(o_totalprice) AS price FROM orders GROUP BY 1, 2)
  SELECT q.customer, q.day, q.value, o.price AS last_price FROM q ASOF LEFT JOIN o ON q.customer = o.customer AND (q.day + 1)::DATE >= o.day""")
def asof_join_q(spark: S, d: str) -> D:
    q = table(spark, d, "events").groupBy(F.col("user_id").alias("customer"), F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer"), F.to_date(F.add_months("o_orderdate", 96)).alias("day")).agg(F.max("o_totalprice").alias("price"))
    out = asof_join(q, o, "customer", F.date_add("day", 1), F.col("day"), ["price"])
    return out.withColumnRenamed("price", "last_price")


@query("asof_single", "SELECT symbol, arg_max(revenue, period_end) AS revenue FROM statements WHERE period_end <= DATE '1999-06-30' GROUP BY 1", ("statements",))
def asof_single(spark: S, d: str) -> D:
    return v.statements(spark, d).where("period_end <= '1999-06-30'").groupBy("symbol").agg(F.max_by("revenue", "period_end").alias("revenue"))


FACTS = "facts AS (SELECT symbol, period_end, (period_end + CAST(60 + symbol % 40 AS INT))::DATE AS available, (period_end + 400)::DATE AS observed, revenue FROM statements UNION ALL SELECT symbol, period_end, (period_end + CAST(60 + symbol % 40 AS INT))::DATE, (period_end + CAST(60 + symbol % 40 AS INT))::DATE, round(revenue * 0.9, 2) FROM statements)"


@query("bitemporal_asof", f"""WITH {FACTS}, days AS (SELECT symbol, session AS day FROM bars_w),
  k AS (SELECT days.symbol, day, period_end, revenue, observed, row_number() OVER (PARTITION BY days.symbol, day ORDER BY period_end DESC, observed DESC) AS n FROM days JOIN facts f ON f.symbol = days.symbol AND f.available <= day AND f.observed <= day + 30)
  SELECT k.symbol, day, k.period_end, k.revenue, p.revenue AS prior_revenue FROM k LEFT JOIN (SELECT symbol, period_end, max(revenue) AS revenue FROM facts GROUP BY 1, 2) p ON p.symbol = k.symbol AND p.period_end = last_day((k.period_end - INTERVAL 12 MONTH)::DATE) WHERE n = 1 AND date_diff('day', k.period_end, day) <= 540""", ("statements", "bars_w"))
def bitemporal_asof(spark: S, d: str) -> D:
    """Newest period among facts available by the day and observed by 30 days after it."""
    s = v.statements(spark, d)
    avail = F.expr("date_add(period_end, cast(60 + symbol % 40 as int))")
    late = s.select("symbol", "period_end", avail.alias("available"), F.date_add("period_end", 400).alias("observed"), "revenue")
    early = s.select("symbol", "period_end", avail.alias("available"), avail.alias("observed"), rnd(F.col("revenue") * 0.9, 2).alias("revenue"))
    facts = late.unionByName(early)
    days = v.bars_w(spark, d).select("symbol", F.col("session").alias("day"))
    best = newest_known(days, facts, "symbol", F.col("day"), F.greatest("available", F.date_sub("observed", 30)), ["period_end", "observed", "revenue"]).drop("observed")
    best = best.where(F.datediff("day", "period_end") <= 540)
    prior = facts.groupBy("symbol", "period_end").agg(F.max("revenue").alias("prior_revenue")).withColumnRenamed("period_end", "prior_end")
    return best.withColumn("prior_end", F.last_day(F.add_months("period_end", -12))).join(prior, ["symbol", "prior_end"], "left").select("symbol", "day", "period_end", "revenue", "prior_revenue")


@query("prior_year_statement", "WITH s AS (SELECT *, lag(period_end) OVER w AS pe, lag(revenue) OVER w AS pr FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY period_end)) SELECT symbol, period_end, revenue, CASE WHEN date_diff('month', pe, period_end) BETWEEN 10 AND 14 THEN pr END AS prev_revenue FROM s", ("statements",))
def prior_year_statement(spark: S, d: str) -> D:
    w = Window.partitionBy("symbol").orderBy("period_end")
    s = v.statements(spark, d)
    near = F.months_between("period_end", F.lag("period_end").over(w)).between(10, 14)
    return s.select("symbol", "period_end", "revenue", F.when(near, F.lag("revenue").over(w)).alias("prev_revenue"))


@query("fundamental_ratios", """SELECT b.symbol, b.session, CASE WHEN b.close * shares > 0 THEN round(net_income / (b.close * shares), 6) END AS earnings_yield, CASE WHEN b.close * shares > 0 THEN round(equity / (b.close * shares), 6) END AS book_to_price,
  CASE WHEN equity > 0 THEN round(net_income / equity, 6) END AS roe, CASE WHEN equity > 0 THEN round(debt / equity, 6) END AS debt_to_equity
  FROM bars_w b ASOF LEFT JOIN (SELECT *, (period_end + 90)::DATE AS known_at FROM statements) f ON b.symbol = f.symbol AND b.session >= f.known_at""", ("bars_w", "statements"))
def fundamental_ratios(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session", "close")
    x = asof_join(b, v.statements(spark, d), "symbol", F.col("session"), F.date_add("period_end", 90), ["net_income", "equity", "debt", "shares"])
    cap, eq = F.col("close") * F.col("shares"), F.col("equity")
    over = lambda a, b: F.when(b > 0, r6(a / b))
    return x.select("symbol", "session", over(F.col("net_income"), cap).alias("earnings_yield"), over(eq, cap).alias("book_to_price"), over(F.col("net_income"), eq).alias("roe"), over(F.col("debt"), eq).alias("debt_to_equity"))


@query("universe_semi", "SELECT symbol, session, close FROM bars_w WHERE symbol IN (SELECT symbol FROM universe WHERE acctbal > 5000)", ("bars_w", "universe"))
def universe_semi(spark: S, d: str) -> D:
    return v.bars_w(spark, d).select("symbol", "session", "close").join(v.universe(spark, d).where("acctbal > 5000").select("symbol"), "symbol", "left_semi")


@query("ensemble_rank", "WITH e AS (SELECT symbol, session, round((score - 2 * vol) / 2, 6) AS ensemble FROM panel_w WHERE vol IS NOT NULL) SELECT symbol, session, ensemble, row_number() OVER (PARTITION BY session ORDER BY ensemble DESC, symbol) AS rank FROM e", ("panel_w",))
def ensemble_rank(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).where("vol is not null")
    e = p.select("symbol", "session", r6((F.col("score") - 2 * F.col("vol")) / 2).alias("ensemble"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ensemble"), "symbol")).cast("long"))


@query("alias_resolve", "SELECT o.o_orderkey, coalesce(c.c_custkey, o.o_custkey) AS resolved FROM orders o LEFT JOIN customer c ON c.c_name = 'Customer#' || lpad(CAST(o.o_custkey + 1 AS VARCHAR), 9, '0') AND o.o_custkey % 2 = 0")
def alias_resolve(spark: S, d: str) -> D:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0"))).alias("c_name"))
    return o.join(table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "left").select("o_orderkey", F.coalesce("c_custkey", "o_custkey").alias("resolved"))


@query("common_pool", "WITH a AS (SELECT symbol, session FROM panel_w WHERE vol IS NOT NULL), b AS (SELECT symbol, session FROM panel_w WHERE score > 0) SELECT session, count(*) AS n_common, (SELECT count(*) FROM a x WHERE x.session = a.session) AS n_a FROM a JOIN b USING (symbol, session) GROUP BY a.session, session", ("panel_w",))
def common_pool(spark: S, d: str) -> D:
    p = v.panel_w(spark, d)
    a, b = p.where("vol is not null").select("symbol", "session"), p.where("score > 0").select("symbol", "session")
    both = a.join(b, ["symbol", "session"]).groupBy("session").agg(F.count("*").alias("n_common"))
    return both.join(a.groupBy("session").agg(F.count("*").alias("n_a")), "session")
