"""Outcomes of signals, cohorts, baskets and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import net_return, r4, r6, rnd
from ..operators import outcomes as op
from ..operators.asof import next_within
from ..operators.evaluation import top_k
from ..operators.events import crossed
from ..plans import views as v
from .registry import query

D, S = DataFrame, SparkSession
H = 4


def signals(spark: S, d: str, k: int = 5) -> D:
    """symbol, idx, session, score, vol, ret, industry of the top k of each session."""
    top = top_k(v.panel_w(spark, d), "score", k)
    return top.join(F.broadcast(v.calendar_w(spark, d)), "session").select("symbol", "idx", "session", "score", "vol", "ret", "industry")


def last_idx(spark: S, d: str) -> D:
    return v.calendar_w(spark, d).agg(F.max("idx").alias("last"))


_SIG = "sig AS (SELECT symbol, idx, session, score, vol, ret, industry FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS place FROM panel_w) JOIN calendar_w USING (session) WHERE place <= 5)"


def _out_sql(name: str, sig: str, h: str = "4", stop: str = "0.3", fee: str = "0.001", slip: str = "0.001", delay: str = "1", extra: str = "") -> str:
    x = f", {extra}" if extra else ""
    return f"""{name}_e AS (SELECT s.symbol, s.idx{x}, s.idx + {delay} AS entry_idx, s.idx + {delay} + {h} AS plan_idx, b.close AS p0, {stop} AS stop, {fee} AS fee, {slip} AS slip FROM {sig} s LEFT JOIN bars_x b ON b.symbol = s.symbol AND b.idx = s.idx + {delay}),
  {name}_p AS (SELECT e.*, i, session, open, low, close, CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.symbol = e.symbol AND b.session BETWEEN impact_start AND impact_end) THEN 'event' WHEN close IS NULL THEN 'gap' WHEN low <= p0 * (1 - stop) THEN 'stop' WHEN i = plan_idx THEN 'plan' END AS kind
    FROM (SELECT *, unnest(range(entry_idx + 1, plan_idx + 1)) AS i FROM {name}_e) e LEFT JOIN bars_x b ON b.symbol = e.symbol AND b.idx = e.i),
  {name}_f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, idx{x} ORDER BY i) AS n FROM {name}_p WHERE kind IS NOT NULL) WHERE n = 1),
  {name}_s AS (SELECT e.*, f.kind, f.i AS hit, CASE WHEN f.kind = 'stop' THEN least(f.open, e.p0 * (1 - e.stop)) ELSE f.close END AS p1,
    CASE WHEN e.p0 IS NULL AND e.entry_idx <= (SELECT max(idx) FROM calendar_w) THEN 'missing_price' WHEN e.plan_idx > (SELECT max(idx) FROM calendar_w) AND f.kind IS DISTINCT FROM 'stop' THEN 'immature' WHEN f.kind = 'event' THEN 'corporate_action' WHEN f.kind = 'gap' THEN 'missing_price' ELSE 'complete' END AS status
    FROM {name}_e e LEFT JOIN {name}_f f ON f.symbol = e.symbol AND f.idx = e.idx{f" AND f.{extra} = e.{extra}" if extra else ""}),
  {name} AS (SELECT symbol, idx{x}, status, entry_idx, CASE WHEN status = 'complete' THEN hit END AS exit_idx, CASE WHEN status = 'complete' THEN p1 * (1 - fee) * (1 - slip) / (p0 * (1 + fee) * (1 + slip)) - 1 END AS net FROM {name}_s)"""


OUT = f"{_SIG}, {_out_sql('o', 'sig')}"
OV = ("panel_w", "calendar_w", "bars_x", "ledger")


def outcomes(spark: S, d: str) -> D:
    return op.trade_outcomes(signals(spark, d).select("symbol", "idx"), v.bars_x(spark, d), v.ledger(spark, d), H, 0.3, 0.001, 0.001, last_idx(spark, d))


@query("trade_outcome", f"WITH {OUT} SELECT symbol, idx, status, entry_idx, exit_idx, round(net, 6) AS net FROM o", OV)
def trade_outcome(spark: S, d: str) -> D:
    return outcomes(spark, d).withColumn("net", r6(F.col("net")))


@query("status_pivot", f"WITH {OUT} SELECT c.y, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'immature') AS immature, count(*) FILTER (WHERE status = 'missing_price') AS missing_price, count(*) FILTER (WHERE status = 'corporate_action') AS corporate_action FROM o JOIN (SELECT idx, year(session) AS y FROM calendar_w) c USING (idx) GROUP BY 1", OV)
def status_pivot(spark: S, d: str) -> D:
    c = v.calendar_w(spark, d).select("idx", F.year("session").cast("long").alias("y"))
    return outcomes(spark, d).join(F.broadcast(c), "idx").groupBy("y").pivot("status", ["complete", "immature", "missing_price", "corporate_action"]).count().na.fill(0)


_SC = "sc AS (SELECT s.*, name, fee AS f, delay AS dl FROM sig s, (VALUES ('base', 0.001, 1), ('costly', 0.003, 1), ('late', 0.001, 2)) t(name, fee, delay))"


@query("scenarios", f"WITH {_SIG}, {_SC}, {_out_sql('o', 'sc', fee='s.f', delay='s.dl', extra='name')} SELECT name, count(*) AS n, count(net) AS complete, round(avg(net), 6) AS mean_net FROM o GROUP BY 1", OV)
def scenarios(spark: S, d: str) -> D:
    """Costs and delays over the same signals, all in one pass."""
    cases = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("fee"), F.lit(w).alias("delay")) for n, f, w in (("base", 0.001, 1), ("costly", 0.003, 1), ("late", 0.001, 2))])
    s = signals(spark, d).select("symbol", "idx", F.explode(cases).alias("c")).select("symbol", "idx", "c.*")
    o = op.trade_outcomes(s, v.bars_x(spark, d), v.ledger(spark, d), H, 0.3, F.col("fee"), 0.001, last_idx(spark, d), F.col("delay"))
    return o.groupBy("name").agg(F.count("*").alias("n"), F.count("net").alias("complete"), r6(F.avg("net")).alias("mean_net"))


@query("long_outcome", f"WITH {_SIG}, {_out_sql('o', 'sig', h='60', stop='0.5')} SELECT symbol, idx, status, entry_idx, exit_idx, round(net, 6) AS net FROM o".replace("ledger l", "ledger_many l"), ("panel_w", "calendar_w", "bars_x", "ledger_many"))
def long_outcome(spark: S, d: str) -> D:
    """Held for sixty sessions with a wide stop, among several event windows a symbol."""
    o = op.trade_outcomes(signals(spark, d).select("symbol", "idx"), v.bars_x(spark, d), v.ledger_many(spark, d), 60, 0.5, 0.001, 0.001, last_idx(spark, d))
    return o.withColumn("net", r6(F.col("net")))


_BASKET = "bk AS (SELECT idx, count(*) AS members, count(net) AS known, CASE WHEN count(net) = count(*) THEN sum(net) / 5 END AS basket FROM o GROUP BY 1)"


def baskets(spark: S, d: str) -> D:
    """Equal slots of five; an empty slot earns nothing, an unknown member leaves the basket unknown."""
    return outcomes(spark, d).groupBy("idx").agg(F.count("*").alias("members"), F.count("net").alias("known"), F.when(F.count("net") == F.count("*"), F.sum("net") / 5).alias("basket"))


@query("basket_return", f"WITH {OUT}, {_BASKET} SELECT idx, members, known, round(basket, 6) AS basket FROM bk", OV)
def basket_return(spark: S, d: str) -> D:
    return baskets(spark, d).withColumn("basket", r6(F.col("basket")))


@query("cycle_summary", f"WITH {OUT}, {_BASKET}, cy AS (SELECT idx // 12 AS span, basket FROM bk WHERE idx % 6 = 0) SELECT span, count(*) AS cycles, count(basket) AS known, CASE WHEN count(*) = count(basket) THEN round(exp(sum(ln(1 + basket))) - 1, 6) END AS total, round(avg(basket), 6) AS mean_known FROM cy GROUP BY 1", OV)
def cycle_summary(spark: S, d: str) -> D:
    """Cycles of six sessions, two to a span; a span's total is withheld where one of its cycles is unknown."""
    c = baskets(spark, d).where("idx % 6 = 0")
    whole = F.count("basket") == F.count("*")
    return c.groupBy(F.expr("idx div 12").alias("span")).agg(F.count("*").alias("cycles"), F.count("basket").alias("known"), F.when(whole, r6(F.exp(F.sum(F.log1p("basket"))) - 1)).alias("total"), r6(F.avg("basket")).alias("mean_known"))


_COH = f"""{_SIG}, ix AS (SELECT idx, close FROM index_w JOIN calendar_w USING (session)),
  mb AS (SELECT s.idx, a.close AS p0, b.close AS p1, b.close / a.close - 1 AS g FROM sig s LEFT JOIN bars_x a ON a.symbol = s.symbol AND a.idx = s.idx + 1 LEFT JOIN bars_x b ON b.symbol = s.symbol AND b.idx = s.idx + 5),
  gr AS (SELECT idx, count(*) AS members, count(g) AS known, avg(g) AS g, avg(CASE WHEN g > 0 THEN 1.0 WHEN g IS NOT NULL THEN 0.0 END) AS h, min(g) AS w FROM mb GROUP BY 1),
  coh AS (SELECT gr.idx, members, known, CASE WHEN members = known THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN members = known THEN g END AS gross, CASE WHEN members = known THEN (1 + g) * 0.999 / 1.001 - 1 END AS net, o.close / i.close - 1 AS index_ret, CASE WHEN members = known THEN h END AS hit_rate, CASE WHEN members = known THEN w END AS worst
    FROM gr LEFT JOIN ix i ON i.idx = gr.idx + 1 LEFT JOIN ix o ON o.idx = gr.idx + 5)"""
CV = ("panel_w", "calendar_w", "bars_x", "index_w")


def cohort_frame(spark: S, d: str) -> D:
    ix = v.index_w(spark, d).join(F.broadcast(v.calendar_w(spark, d)), "session").select("idx", "close")
    return op.cohorts(signals(spark, d), v.bars_x(spark, d), ix, H, 0.001)


def _rounded(df: D, *cols: str) -> D:
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("replay_cohorts", f"WITH {_COH} SELECT idx, members, known, status, round(gross, 6) AS gross, round(net, 6) AS net, round(index_ret, 6) AS index_ret, round(hit_rate, 6) AS hit_rate, round(worst, 6) AS worst FROM coh", CV)
def replay_cohorts(spark: S, d: str) -> D:
    return _rounded(cohort_frame(spark, d), "gross", "net", "index_ret", "hit_rate", "worst")


@query("cohort_evaluate", f"WITH {_COH} SELECT idx, status, round(net, 6) AS net, round(net - index_ret, 6) AS over_index FROM coh WHERE idx = (SELECT max(idx) FROM coh WHERE status = 'complete')", CV)
def cohort_evaluate(spark: S, d: str) -> D:
    c = cohort_frame(spark, d)
    last = c.where("status = 'complete'").agg(F.max("idx").alias("idx"))
    return c.join(F.broadcast(last), "idx").select("idx", "status", r6(F.col("net")).alias("net"), r6(F.col("net") - F.col("index_ret")).alias("over_index"))


@query("cohort_summary", f"WITH {_COH} SELECT status, count(*) AS n, round(avg(net), 6) AS mean_net, round(avg(hit_rate), 6) AS hit_rate, round(min(worst), 6) AS worst, round(avg(CASE WHEN net > index_ret THEN 1.0 WHEN net IS NOT NULL AND index_ret IS NOT NULL THEN 0.0 END), 6) AS win_rate FROM coh GROUP BY 1", CV)
def cohort_summary(spark: S, d: str) -> D:
    return cohort_frame(spark, d).groupBy("status").agg(F.count("*").alias("n"), r6(F.avg("net")).alias("mean_net"), r6(F.avg("hit_rate")).alias("hit_rate"), r6(F.min("worst")).alias("worst"), r6(F.avg((F.col("net") > F.col("index_ret")).cast("double"))).alias("win_rate"))


@query("monthly_consistency", f"WITH {_COH} SELECT strftime(session, '%Y-%m') AS month, count(*) AS n, round(avg(net), 6) AS mean_net FROM coh JOIN calendar_w c ON c.idx = coh.idx + 1 WHERE status = 'complete' GROUP BY 1", CV)
def monthly_consistency(spark: S, d: str) -> D:
    c = v.calendar_w(spark, d).select((F.col("idx") - 1).alias("idx"), "session")
    x = cohort_frame(spark, d).where("status = 'complete'").join(F.broadcast(c), "idx")
    return x.groupBy(F.date_format("session", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), r6(F.avg("net")).alias("mean_net"))


@query("execution_labels", "WITH x AS (SELECT symbol, session, (1 + ret) * 0.999 / 1.001 - 1 AS net, avg((1 + ret) * 0.999 / 1.001 - 1) OVER (PARTITION BY session) AS m FROM panel_w) SELECT symbol, session, CAST(net > 0 AS INT) AS profit, CAST(net > m AS INT) AS outperform, round(net - m, 6) AS excess FROM x", ("panel_w",))
def execution_labels(spark: S, d: str) -> D:
    x = v.panel_w(spark, d).withColumn("net", net_return(F.col("ret"), 0.001)).withColumn("m", F.avg("net").over(Window.partitionBy("session")))
    return x.select("symbol", "session", (F.col("net") > 0).cast("int").alias("profit"), (F.col("net") > F.col("m")).cast("int").alias("outperform"), r6(F.col("net") - F.col("m")).alias("excess"))


_ELIG = "concat_ws(',', CASE WHEN p.close < 1500 THEN 'price' END, CASE WHEN vol IS NULL OR vol > 0.5 THEN 'volatility' END, CASE WHEN volume < 100 THEN 'liquidity' END, CASE WHEN EXISTS (SELECT 1 FROM ledger l WHERE l.symbol = p.symbol AND l.impact_start <= p.session AND p.session <= l.impact_end + 90) THEN 'event' END)"


def eligibility(spark: S, d: str) -> D:
    """Every reason that holds, not the first; events count from their start as known then."""
    p = v.panel_w(spark, d).withColumn("until", F.col("session"))
    e = v.ledger(spark, d).select("symbol", "impact_start", F.date_add("impact_end", 90).alias("impact_end"))
    x = crossed(p, e, "symbol", "session", "until")
    why = F.array(F.when(F.col("close") < 1500, "price"), F.when(F.col("vol").isNull() | (F.col("vol") > 0.5), "volatility"), F.when(F.col("volume") < 100, "liquidity"), F.when(F.col("crossed"), "event"))
    return x.withColumn("reasons", F.array_compact(why)).withColumn("eligible", F.size("reasons") == 0)


@query("eligibility", f"SELECT symbol, session, {_ELIG} AS reasons, {_ELIG} = '' AS eligible FROM panel_w p", ("panel_w", "ledger"))
def eligibility_q(spark: S, d: str) -> D:
    return eligibility(spark, d).select("symbol", "session", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query("candidate_pool", f"WITH c AS (SELECT * FROM panel_w p WHERE {_ELIG} = '') SELECT session, count(*) AS pool, arg_max(symbol, (score, -symbol)) AS momentum_pick, arg_min(symbol, (vol, symbol)) AS calm_pick FROM c GROUP BY 1", ("panel_w", "ledger"))
def candidate_pool(spark: S, d: str) -> D:
    g = eligibility(spark, d).where("eligible").groupBy("session")
    return g.agg(F.count("*").alias("pool"), F.max_by("symbol", F.struct("score", -F.col("symbol"))).alias("momentum_pick"), F.min_by("symbol", F.struct("vol", "symbol")).alias("calm_pick"))


@query("selective_pick", "SELECT session, symbol, score FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS n FROM (SELECT *, avg(score) OVER (PARTITION BY session) AS m FROM panel_w) WHERE score > 0.5 AND score > m) WHERE n = 1", ("panel_w",))
def selective_pick(spark: S, d: str) -> D:
    """The best of a session, or none where nothing passes both cutoffs."""
    p = v.panel_w(spark, d).withColumn("m", F.avg("score").over(Window.partitionBy("session")))
    return top_k(p.where("score > 0.5 and score > m"), "score", 1).select("session", "symbol", "score")


@query("matched_control", "WITH n AS (SELECT session, count(*) AS k FROM panel_w WHERE score > 0.5 GROUP BY 1), c AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY vol, symbol) AS place FROM panel_w WHERE vol IS NOT NULL) SELECT session, count(*) AS n, round(avg(ret), 6) AS control_ret FROM c JOIN n USING (session) WHERE place <= k GROUP BY 1", ("panel_w",))
def matched_control(spark: S, d: str) -> D:
    p = v.panel_w(spark, d)
    n = p.where("score > 0.5").groupBy("session").agg(F.count("*").alias("k"))
    c = p.where("vol is not null").withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("vol", "symbol")))
    return c.join(F.broadcast(n), "session").where("place <= k").groupBy("session").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("control_ret"))


@query("adjusted_return", "WITH x AS (SELECT symbol, session, lead(session, 4) OVER w AS exit, lead(close, 4) OVER w / close - 1 AS r FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session)) SELECT symbol, session, CASE WHEN e THEN 'corporate_action' WHEN r IS NULL THEN 'missing_price' END AS reason, CASE WHEN NOT e THEN round(r, 6) END AS adjusted FROM (SELECT *, EXISTS (SELECT 1 FROM ledger l WHERE l.symbol = x.symbol AND x.session <= impact_end AND coalesce(x.exit, x.session) >= impact_start) AS e FROM x)", ("bars_w", "ledger"))
def adjusted_return(spark: S, d: str) -> D:
    w = Window.partitionBy("symbol").orderBy("session")
    x = v.bars_w(spark, d).select("symbol", "session", F.coalesce(F.lead("session", 4).over(w), "session").alias("until"), (F.lead("close", 4).over(w) / F.col("close") - 1).alias("r"))
    x = crossed(x, v.ledger(spark, d), "symbol", "session", "until")
    return x.select("symbol", "session", F.when(F.col("crossed"), "corporate_action").when(F.col("r").isNull(), "missing_price").alias("reason"), F.when(~F.col("crossed"), r6(F.col("r"))).alias("adjusted"))


@query("total_return", """WITH x AS (SELECT symbol, session, close, CASE WHEN symbol % 10 = 3 AND session = DATE '1996-03-04' THEN 2.0 ELSE 1.0 END AS split, CASE WHEN month(session) = 6 AND day(session) <= 7 THEN 10.0 ELSE 0.0 END AS dividend FROM bars_w),
  y AS (SELECT *, exp(sum(ln(split)) OVER w) AS factor FROM x WINDOW w AS (PARTITION BY symbol ORDER BY session)) SELECT symbol, session, round(factor, 4) AS shares, round(factor * close + sum(factor * dividend) OVER w, 4) AS wealth FROM y WINDOW w AS (PARTITION BY symbol ORDER BY session)""", ("bars_w",))
def total_return(spark: S, d: str) -> D:
    """Wealth of one share bought at the start: split shares at the close, and dividends paid on the shares of their day."""
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    day = F.lit("1996-03-04").cast("date")
    x = v.bars_w(spark, d).withColumn("split", F.when((F.col("symbol") % 10 == 3) & (F.col("session") == day), 2.0).otherwise(1.0)).withColumn("dividend", F.when((F.month("session") == 6) & (F.dayofmonth("session") <= 7), 10.0).otherwise(0.0))
    y = x.withColumn("factor", F.exp(F.sum(F.log("split")).over(w)))
    return y.select("symbol", "session", r4(F.col("factor")).alias("shares"), r4(F.col("factor") * F.col("close") + F.sum(F.col("factor") * F.col("dividend")).over(w)).alias("wealth"))


@query("entitlement_value", """WITH en AS (SELECT event_id, symbol + k AS part, 1.0 / (k + 1) AS ratio FROM ledger, (SELECT unnest(range(3)) AS k)), q AS (SELECT symbol, close FROM bars_w WHERE session = DATE '1996-03-25')
  SELECT event_id, count(*) AS parts, count(close) AS quoted, CASE WHEN count(close) = count(*) THEN round(sum(ratio * close), 4) END AS value FROM en LEFT JOIN q ON q.symbol = en.part GROUP BY 1""", ("ledger", "bars_w"))
def entitlement_value(spark: S, d: str) -> D:
    e = v.ledger(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("event_id", (F.col("symbol") + F.col("k")).alias("part"), (1.0 / (F.col("k") + 1)).alias("ratio"))
    q = v.bars_w(spark, d).where("session = '1996-03-25'").select(F.col("symbol").alias("part"), "close")
    g = e.join(q, "part", "left").groupBy("event_id")
    return g.agg(F.count("*").alias("parts"), F.count("close").alias("quoted"), F.when(F.count("close") == F.count("*"), r4(F.sum(F.col("ratio") * F.col("close")))).alias("value"))


@query("held_revisions", "WITH h AS (SELECT symbol, session AS a, (session + 35)::DATE AS b FROM panel_w WHERE score > 1), r AS (SELECT symbol, (period_end + 400)::DATE AS session FROM statements) SELECT DISTINCT h.symbol, h.a AS entry FROM h WHERE EXISTS (SELECT 1 FROM r WHERE r.symbol = h.symbol AND r.session BETWEEN h.a AND h.b)", ("panel_w", "statements"))
def held_revisions(spark: S, d: str) -> D:
    h = v.panel_w(spark, d).where("score > 1").select("symbol", F.col("session").alias("entry"), F.date_add("session", 35).alias("until"))
    r = v.statements(spark, d).select("symbol", F.date_add("period_end", 400).alias("at"))  # when a statement's later version is seen
    return next_within(h, r, "symbol", F.col("entry"), F.col("until"), F.col("at")).select("symbol", "entry")


@query("size_basket", f"""WITH {_SIG}, x AS (SELECT s.symbol, s.session, b.close, b.volume, count(*) OVER (PARTITION BY s.session) AS n, 100000.0 AS cash FROM sig s JOIN bars_w b ON b.symbol = s.symbol AND b.session = s.session),
  w AS (SELECT *, least(cash / n, cash * 0.25, min(volume * close * 0.1) OVER (PARTITION BY session)) AS amount FROM x) SELECT symbol, session, CAST(floor(amount / close) AS BIGINT) AS shares, round(floor(amount / close) * close, 2) AS spent FROM w""", ("panel_w", "calendar_w", "bars_w"))
def size_basket(spark: S, d: str) -> D:
    """One common amount a session: the least of equal cash, a quarter of it, and a tenth of the thinnest member's traded value; whole shares."""
    by = Window.partitionBy("session")
    x = signals(spark, d).select("symbol", "session").join(v.bars_w(spark, d).select("symbol", "session", "close", "volume"), ["symbol", "session"])
    cash = F.lit(100000.0)
    amount = F.least(cash / F.count("*").over(by), cash * 0.25, F.min(F.col("volume") * F.col("close") * 0.1).over(by))
    x = x.withColumn("shares", F.floor(amount / F.col("close")).cast("long"))
    return x.select("symbol", "session", "shares", rnd(F.col("shares") * F.col("close"), 2).alias("spent"))
