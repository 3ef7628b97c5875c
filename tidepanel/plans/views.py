"""The panel views over the given tables, as frames and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import rnd
from ..sources.tables import table


def cents(x):
    """Money as whole cents, which add up the same in any order."""
    return F.floor(x * 100 + 0.5).cast("long")


def _bars(spark: SparkSession, d: str, time, name: str, per_symbol: bool) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    unit = rnd(F.col("l_extendedprice") / F.col("l_quantity"), 4)
    keys = ([F.col("l_suppkey").alias("symbol")] if per_symbol else [F.lit(0).cast("long").alias("symbol")]) + [time.alias(name)]
    return li.groupBy(*keys).agg(
        F.min(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), unit.alias("u")))["u"].alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        rnd(F.sum(cents(F.col("l_extendedprice"))).cast("double") / (F.sum("l_quantity") * 100.0), 4).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


def bars_d(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, F.to_date("l_shipdate"), "trade_date", True)


def index_d(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, F.to_date("l_shipdate"), "trade_date", False)


def bars_w(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, F.to_date(F.date_trunc("week", "l_shipdate")), "session", True)


def index_w(spark: SparkSession, d: str) -> DataFrame:
    return _bars(spark, d, F.to_date(F.date_trunc("week", "l_shipdate")), "session", False)


def calendar_w(spark: SparkSession, d: str) -> DataFrame:
    """session, idx: as many rows as there are sessions, so one task may number them."""
    weeks = table(spark, d, "lineitem").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("session")).distinct()
    return weeks.withColumn("idx", (F.row_number().over(Window.orderBy("session")) - 1).cast("long"))


def bars_x(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars with the index of their session."""
    return bars_w(spark, d).join(F.broadcast(calendar_w(spark, d)), "session")


def universe(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    dim = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return sup.join(F.broadcast(dim), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("industry"), F.col("n_name").alias("sub_industry"), F.col("s_acctbal").alias("acctbal")
    )


def statements(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    s = li.groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("y")).agg(
        rnd(F.sum(price * (1 - F.col("l_discount"))), 2).alias("revenue"),
        rnd(F.sum(price * F.col("l_discount")), 2).alias("net_income"),
        rnd(F.sum(price * F.col("l_tax")), 2).alias("debt"),
        F.sum("l_quantity").cast("long").alias("shares"),
    )
    equity = universe(spark, d).select("symbol", rnd(F.col("acctbal") * 1000, 2).alias("equity"))
    return s.join(equity, "symbol").select("symbol", F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), "revenue", "net_income", "debt", "shares", "equity")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier").where(F.col("s_suppkey") % 10 == 3)
    return sup.select(F.concat(F.lit("E"), F.col("s_suppkey")).alias("event_id"), F.col("s_suppkey").alias("symbol"), F.lit("1996-03-04").cast("date").alias("impact_start"), F.lit("1996-03-18").cast("date").alias("impact_end"))


def ledger_many(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the shipments give: two for each first line of every fortieth order, the second inside or past the first."""
    li = table(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 40 = 0")
    k, ship, size = F.col("k"), F.to_date("l_shipdate"), F.col("l_quantity").cast("int")
    return li.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "k").alias("event_id"), F.col("l_suppkey").alias("symbol"), F.date_add(ship, 5 * k).alias("impact_start"), F.date_add(ship, size + 20 * k).alias("impact_end")
    )


def quotes_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("volume"), "event_type")


def panel_w(spark: SparkSession, d: str) -> DataFrame:
    """Scored cross-sections: score (13-bar momentum), vol (13-bar), ret (next 4 bars); rows where score and ret are known."""
    w = Window.partitionBy("symbol").orderBy("session")
    close = F.col("close")
    b = bars_w(spark, d).withColumn("r1", rnd(close / F.lag("close").over(w) - 1, 6))
    b = b.select(
        "symbol", "session", "close", "volume",
        rnd(close / F.lag("close", 13).over(w) - 1, 6).alias("score"),
        F.when(F.count("r1").over(w.rowsBetween(-12, 0)) == 13, rnd(F.stddev_samp("r1").over(w.rowsBetween(-12, 0)), 6)).alias("vol"),
        rnd(F.lead("close", 4).over(w) / close - 1, 6).alias("ret"),
    )
    return b.where("score is not null and ret is not null").join(universe(spark, d).select("symbol", "industry"), "symbol")


_UNIT = "round(l_extendedprice / l_quantity, 4)"


def _bars_sql(symbol: str, time: str, name: str) -> str:
    return f"""SELECT {symbol} AS symbol, {time} AS {name}, min({{'k': l_orderkey * 10 + l_linenumber, 'u': {_UNIT}}}).u AS open, max({_UNIT}) AS high,
  min({_UNIT}) AS low, round(CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / (sum(l_quantity) * 100.0), 4) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2"""


_DAY, _WEEK = "CAST(l_shipdate AS DATE)", "CAST(date_trunc('week', l_shipdate) AS DATE)"

#: View name to (views it needs, SQL).
SQL = {
    "bars_d": ((), _bars_sql("l_suppkey", _DAY, "trade_date")),
    "index_d": ((), _bars_sql("CAST(0 AS BIGINT)", _DAY, "trade_date")),
    "bars_w": ((), _bars_sql("l_suppkey", _WEEK, "session")),
    "index_w": ((), _bars_sql("CAST(0 AS BIGINT)", _WEEK, "session")),
    "calendar_w": ((), f"SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT {_WEEK} AS session FROM lineitem)"),
    "bars_x": (("bars_w", "calendar_w"), "SELECT bars_w.*, idx FROM bars_w JOIN calendar_w USING (session)"),
    "universe": ((), "SELECT s_suppkey AS symbol, r_name AS industry, n_name AS sub_industry, s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "statements": (
        (),
        """SELECT l_suppkey AS symbol, make_date(CAST(y AS INT), 12, 31) AS period_end, revenue, net_income, debt, shares, round(s_acctbal * 1000, 2) AS equity FROM (
  SELECT l_suppkey, year(l_shipdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * l_discount), 2) AS net_income,
    round(sum(l_extendedprice * l_tax), 2) AS debt, CAST(sum(l_quantity) AS BIGINT) AS shares FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "ledger": ((), "SELECT 'E' || s_suppkey AS event_id, s_suppkey AS symbol, DATE '1996-03-04' AS impact_start, DATE '1996-03-18' AS impact_end FROM supplier WHERE s_suppkey % 10 = 3"),
    "ledger_many": ((), "SELECT 'L' || l_orderkey || '-' || k AS event_id, l_suppkey AS symbol, CAST(l_shipdate AS DATE) + CAST(5 * k AS INT) AS impact_start, CAST(l_shipdate AS DATE) + CAST(l_quantity + 20 * k AS INT) AS impact_end FROM lineitem, (SELECT unnest([0, 1]) AS k) WHERE l_linenumber = 1 AND l_orderkey % 40 = 0"),
    "quotes_log": ((), "SELECT event_id, user_id AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, event_type FROM events"),
    "panel_w": (
        ("bars_w", "universe"),
        """SELECT p.*, industry FROM (
  SELECT symbol, session, close, volume, round(close / lag(close, 13) OVER w - 1, 6) AS score,
    CASE WHEN count(r1) OVER w13 = 13 THEN round(stddev_samp(r1) OVER w13, 6) END AS vol, round(lead(close, 4) OVER w / close - 1, 6) AS ret
  FROM (SELECT *, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1, 6) AS r1 FROM bars_w)
  WINDOW w AS (PARTITION BY symbol ORDER BY session), w13 AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) p
  JOIN universe USING (symbol) WHERE score IS NOT NULL AND ret IS NOT NULL""",
    ),
}


def stable_round(sql: str) -> str:
    """sql with each round(x, k) as the same plain arithmetic that functions.windows.rnd uses."""
    at = sql.find("round(")
    while at >= 0:
        depth, comma, end = 0, -1, at + 6
        while depth >= 0:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                comma = end
            end += 1
        x, k = sql[at + 6 : comma], int(sql[comma + 1 : end - 1])
        sql = f"{sql[:at]}(floor(({x}) * 1e{k} + CAST(0.500001 AS DOUBLE)) / 1e{k}){sql[end:]}"
        at = sql.find("round(", at)
    return sql


def with_views(views: tuple[str, ...], body: str) -> str:
    """body after the common table expressions that it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in SQL[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = ", ".join(f"{v} AS MATERIALIZED ({stable_round(SQL[v][1])})" for v in order)
    body = stable_round(body.strip())
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
