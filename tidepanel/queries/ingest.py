"""Sources, sinks, validation, streams, scalar functions and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.windows import net_return, r6, rnd, series, sigmoid
from ..operators import ingest as op
from ..plans import views as v
from ..sources.tables import check_policy, ensure_table, file_stats, latest_version, new_path, policy_digest, publish, table, table_or_empty, unless_empty, write_policy, written
from ..sources.upkeep import Refused, canonical, compact, expire, publish_checked, record_experiment, served
from ..streaming.drain import drain, drain_json, follow_latest, log_topics
from .registry import query

D, S = DataFrame, SparkSession


@query("scan_project", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem WHERE l_quantity >= 45")
def scan_project(spark: S, d: str) -> D:
    li = table(spark, d, "lineitem").where("l_quantity >= 45")
    return li.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("price"), F.col("l_quantity").cast("long").alias("volume"))


@query("csv_roundtrip", "SELECT symbol, industry, sub_industry, acctbal FROM universe", ("universe",))
def csv_roundtrip(spark: S, d: str) -> D:
    u, path = v.universe(spark, d), new_path(spark, "csv")
    u.write.csv(path, header=True, quoteAll=True)
    return spark.read.schema(u.schema).csv(path, header=True)


@query("dim_json", "SELECT s_suppkey AS symbol, coalesce(n_name, 'Unknown') AS sub_industry FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dim_json(spark: S, d: str) -> D:
    path = new_path(spark, "json")
    table(spark, d, "nation").select(F.struct("n_nationkey", "n_name").alias("m")).agg(F.collect_list("m").alias("members")).write.json(path)
    dim = spark.read.schema("members array<struct<n_nationkey:int,n_name:string>>").json(path).select(F.explode("members").alias("m")).select("m.*")
    sup = table(spark, d, "supplier")
    return sup.join(F.broadcast(dim), sup.s_nationkey == dim.n_nationkey, "left").select(F.col("s_suppkey").alias("symbol"), F.coalesce("n_name", F.lit("Unknown")).alias("sub_industry"))


LEDGER_BAD = "SELECT event_id, symbol, impact_start, CASE WHEN symbol % 20 = 3 THEN impact_start - INTERVAL 1 DAY ELSE impact_end END::DATE AS impact_end FROM ledger"


@query("ledger_validate", f"WITH e AS ({LEDGER_BAD} UNION ALL SELECT event_id, symbol, impact_start, impact_end FROM ledger WHERE symbol % 30 = 3) SELECT event_id, count(*) > 1 AS duplicated, coalesce(bool_or(impact_end < impact_start), false) AS disordered FROM e GROUP BY 1 HAVING count(*) > 1 OR bool_or(impact_end < impact_start)", ("ledger",))
def ledger_validate(spark: S, d: str) -> D:
    e = v.ledger(spark, d)
    bad = e.withColumn("impact_end", F.when(F.col("symbol") % 20 == 3, F.date_sub("impact_start", 1)).otherwise(F.col("impact_end"))).unionByName(e.where("symbol % 30 = 3"))
    out = bad.groupBy("event_id").agg((F.count("*") > 1).alias("duplicated"), F.bool_or(F.col("impact_end") < F.col("impact_start")).alias("disordered"))
    return out.where("duplicated or disordered")


QUOTE_RULES = "CASE WHEN symbol IS NULL THEN 'missing symbol' WHEN price IS NULL OR price <= 1 THEN 'bad price' WHEN volume IS NULL OR volume < 5 THEN 'bad volume' WHEN event_type = 'error' THEN 'error event' END"


def _judge(q: D) -> D:
    c = F.col
    return q.withColumn(
        "reason",
        op.first_reason([("missing symbol", c("symbol").isNull()), ("bad price", c("price").isNull() | (c("price") <= 1)), ("bad volume", c("volume").isNull() | (c("volume") < 5)), ("error event", c("event_type") == "error")]),
    )


def _stream(spark: S, d: str) -> tuple[D, D]:
    base = new_path(spark, "stream")
    q = v.quotes_log(spark, d)
    q.write.json(f"{base}/in")
    for _ in range(2):  # a second run finds nothing new
        drain_json(spark, f"{base}/in", q.schema, _judge, f"{base}/valid", f"{base}/invalid", f"{base}/checkpoint")
    bad = q.schema.add("reason", "string")
    return spark.read.schema(q.schema).parquet(f"{base}/valid"), spark.read.schema(bad).parquet(f"{base}/invalid")


@query("stream_ingest_valid", f"SELECT event_id, symbol, price, volume, event_type FROM quotes_log WHERE ({QUOTE_RULES}) IS NULL", ("quotes_log",))
def stream_ingest_valid(spark: S, d: str) -> D:
    return _stream(spark, d)[0].select("event_id", "symbol", "price", "volume", "event_type")


@query("stream_dead_letter", f"SELECT event_id, {QUOTE_RULES} AS reason FROM quotes_log WHERE ({QUOTE_RULES}) IS NOT NULL", ("quotes_log",))
def stream_dead_letter(spark: S, d: str) -> D:
    return _stream(spark, d)[1].select("event_id", "reason")


@query("stream_replayed", f"SELECT coalesce(({QUOTE_RULES}), 'valid') AS reason, count(*) AS n_rows FROM quotes_log GROUP BY 1", ("quotes_log",))
def stream_replayed(spark: S, d: str) -> D:
    """Rows of either sink by reason: a run over some files in batches of one, more files, the checkpoint lost so that all comes again in one
    batch, and the last files."""
    base, q = new_path(spark, "replay"), v.quotes_log(spark, d)
    part = F.pmod(F.col("event_id"), F.lit(5))
    for k, checkpoint, files in ((0, "first", "1"), (1, "first", "1"), (2, "second", "100"), (3, "second", "2"), (4, "third", "3")):
        q.where(part == k).repartition(2).write.json(f"{base}/in/arrived={k}")
        drain_json(spark, f"{base}/in/*", q.schema, _judge, f"{base}/valid", f"{base}/invalid", f"{base}/{checkpoint}", maxFilesPerTrigger=files)
    judged = spark.read.parquet(f"{base}/valid").select(F.lit("valid").alias("reason")).unionByName(spark.read.parquet(f"{base}/invalid").select("reason"))
    return judged.groupBy("reason").agg(F.count("*").alias("n_rows"))


@query("topics_drained", f"""WITH t AS (SELECT 'quotes' AS topic, event_id AS id, price, ({QUOTE_RULES}) AS reason FROM quotes_log WHERE event_type <> 'error' UNION ALL SELECT 'errors', event_id, price, ({QUOTE_RULES}) FROM quotes_log WHERE event_type = 'error'
    UNION ALL SELECT 'bars', symbol, close, CASE WHEN close <= 1 THEN 'bad price' END FROM bars_w WHERE session >= DATE '2001-09-03' UNION ALL SELECT 'names', symbol, acctbal, CASE WHEN acctbal <= 1 THEN 'bad price' END FROM universe)
  SELECT topic, reason IS NULL AS valid, count(*) AS n_rows, round(sum(price), 2) AS total FROM t GROUP BY 1, 2""", ("quotes_log", "bars_w", "universe"))
def topics_drained(spark: S, d: str) -> D:
    """Four topics of a log, read twice with more arriving in between, into one pair of sinks: offsets by topic and partition, rows taken once."""
    from ..sources import topics

    topics.register(spark)
    base, q = new_path(spark, "topics"), v.quotes_log(spark, d)
    row = lambda df, i, p, **more: df.select(F.col(i).alias("id"), F.col(p).alias("price"), more.get("volume", F.lit(None).cast("long")).alias("volume"), more.get("event_type", F.lit(None).cast("string")).alias("event_type"))
    parts = {
        "quotes": row(q.where("event_type <> 'error'"), "event_id", "price", volume=F.col("volume"), event_type=F.col("event_type")),
        "errors": row(q.where("event_type = 'error'"), "event_id", "price", volume=F.col("volume"), event_type=F.col("event_type")),
        "bars": row(v.bars_w(spark, d).where("session >= '2001-09-03'"), "symbol", "close"),
        "names": row(v.universe(spark, d), "symbol", "acctbal"),
    }
    schema = parts["quotes"].schema

    def judge(x: D) -> D:
        quotes = F.col("topic").isin("quotes", "errors")
        c = F.col
        rules = [("bad price", c("price").isNull() | (c("price") <= 1)), ("bad volume", quotes & (c("volume").isNull() | (c("volume") < 5))), ("error event", c("event_type") == "error")]
        return x.withColumn("reason", op.first_reason(rules))

    for half in (0, 1):
        for topic, rows in parts.items():
            topics.append(rows.where(F.pmod(F.col("id"), F.lit(2)) == half), f"{base}/log", topic, "id", partitions=2)
        drain(log_topics(spark, topics.FORMAT, schema, path=f"{base}/log"), judge, f"{base}/valid", f"{base}/invalid", f"{base}/checkpoint")
    got = spark.read.parquet(f"{base}/valid").select("topic", "price", F.lit(True).alias("valid")).unionByName(spark.read.parquet(f"{base}/invalid").select("topic", "price", F.lit(False).alias("valid")))
    return got.groupBy("topic", "valid").agg(F.count("*").alias("n_rows"), rnd(F.sum("price"), 2).alias("total"))


@query("policy_checked", "SELECT symbol, count(*) AS n_rows, true AS other_policy_refused FROM bars_w GROUP BY 1", ("bars_w",))
def policy_checked(spark: S, d: str) -> D:
    """A table written with the fingerprint of its rules: readers of the same rules get it, readers of others do not."""
    path = new_path(spark, "policy")
    v.bars_w(spark, d).write.parquet(path)
    digest = write_policy(spark, path, {"bars": "weekly", "gaps": "absent"})
    check_policy(spark, path, digest)
    try:
        check_policy(spark, path, policy_digest({"bars": "weekly", "gaps": "null"}))
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("n_rows")).withColumn("other_policy_refused", F.lit(refused))


@query("latest_quote", "SELECT symbol, event_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS n FROM quotes_log) WHERE n = 1", ("quotes_log",))
def latest_quote(spark: S, d: str) -> D:
    """From keyed state: half of the log, then, after a lost checkpoint, all of it, the older half last."""
    base, q = new_path(spark, "state"), v.quotes_log(spark, d).select("ts", "event_id", "symbol", "price", "volume", "event_type")
    late = F.pmod(F.col("event_id"), F.lit(2)) == 0
    q.where(~late).write.json(f"{base}/in/part=1")
    follow_latest(spark, f"{base}/in/*", q.schema, "symbol", "ts", f"{base}/store", f"{base}/first")
    q.where(late).write.json(f"{base}/in/part=2")
    out = follow_latest(spark, f"{base}/in/*", q.schema, "symbol", "ts", f"{base}/store", f"{base}/second")
    return out.select("symbol", "event_id", "price")


@query("late_corrections", """WITH log AS (SELECT *, 0 AS batch FROM bars_w UNION ALL SELECT symbol, session, open, high, low, round(close * 1.01, 4), volume, 1 FROM bars_w WHERE session >= DATE '2001-09-03' AND symbol % 2 = 0)
  SELECT symbol, session, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY batch DESC, close DESC) AS n FROM log) WHERE n = 1""", ("bars_w",))
def late_corrections(spark: S, d: str) -> D:
    b = v.bars_w(spark, d)
    log = b.withColumn("batch", F.lit(0)).unionByName(b.where("session >= '2001-09-03' and symbol % 2 = 0").withColumn("close", rnd(F.col("close") * 1.01, 4)).withColumn("batch", F.lit(1)))
    return op.latest_rows(log, ["symbol", "session"], F.desc("batch"), F.desc("close")).select("symbol", "session", "close")


@query("dedupe_latest", "SELECT symbol, trade_date, price FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def dedupe_latest(spark: S, d: str) -> D:
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").alias("price"), "l_orderkey")
    return op.latest_rows(li, ["symbol", "trade_date"], F.desc("l_orderkey"), F.desc("price")).select("symbol", "trade_date", "price")


@query("as_of_snapshot", "SELECT symbol, close, session AS snapshot_at FROM bars_w WHERE session = (SELECT max(session) FROM bars_w WHERE session <= DATE '2000-06-15')", ("bars_w",))
def as_of_snapshot(spark: S, d: str) -> D:
    path = new_path(spark, "snapshots")
    b = v.bars_w(spark, d).select("symbol", "close", F.col("session").alias("snapshot_at"))
    b.write.partitionBy("snapshot_at").parquet(path)
    return latest_version(spark, path, "snapshot_at", "2000-06-15").select("symbol", "close", F.col("snapshot_at").cast("date").alias("snapshot_at"))


@query("file_stats")
def files(spark: S, d: str) -> D:
    return file_stats(table(spark, d, "lineitem"))


@query("snapshot_files", "SELECT session AS snapshot_at, CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows, true AS has_bytes FROM bars_w GROUP BY 1", ("bars_w",))
def snapshot_files(spark: S, d: str) -> D:
    """Files, rows and bytes of each snapshot of a table that writes one file a snapshot."""
    path = new_path(spark, "snapshot-files")
    v.bars_w(spark, d).withColumnRenamed("session", "snapshot_at").repartition("snapshot_at").write.partitionBy("snapshot_at").parquet(path)
    files = spark.read.parquet(path).select("snapshot_at", "_metadata.file_name", "_metadata.file_size")
    one = files.groupBy("snapshot_at", "file_name").agg(F.count("*").alias("n"), F.max("file_size").alias("bytes"))
    return one.groupBy("snapshot_at").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_rows"), (F.sum("bytes") > 0).alias("has_bytes"))


@query("empty_source_skipped", "SELECT symbol, session, close FROM bars_w WHERE session < DATE '2001-10-01'", ("bars_w",))
def empty_source_skipped(spark: S, d: str) -> D:
    """A stage replaces what is stored by what arrived; where nothing arrived it is passed over and the stored rows stay."""
    b = v.bars_w(spark, d).select("symbol", "session", "close")
    stored, arrived = b.where("session < '2001-10-01'"), b.where("session > '2030-01-01'")
    done = unless_empty(arrived, lambda rows: op.replace_keys(stored, rows, ["session"]))
    return stored if done is None else done


@query("missing_table_neutral", "SELECT symbol, session, CAST(0 AS DOUBLE) AS sentiment, CAST(0 AS BIGINT) AS n_news FROM bars_w", ("bars_w",))
def missing_table_neutral(spark: S, d: str) -> D:
    """Features of a table that does not exist here are neutral, not an error."""
    news = table_or_empty(spark, "panel_news_that_is_not_here", StructType().add("symbol", "long").add("session", "date").add("sentiment", "double").add("n_news", "long"))
    return v.bars_w(spark, d).select("symbol", "session").join(news, ["symbol", "session"], "left").na.fill({"sentiment": 0.0, "n_news": 0})


@query("table_recreated", "SELECT symbol, industry, acctbal FROM universe", ("universe",))
def table_recreated(spark: S, d: str) -> D:
    """A catalog table is made, filled, and made anew when its columns have changed."""
    name, u = f"panel_universe_{uuid.uuid4().hex}", v.universe(spark, d).select("symbol", "industry", "acctbal")
    ensure_table(spark, name, u.select("symbol").schema)
    u.select("symbol").write.insertInto(name)
    ensure_table(spark, name, u.schema)
    u.write.insertInto(name)
    ensure_table(spark, name, u.schema)  # the same columns: rows stay
    out = written(spark.table(name), "table-recreated")
    spark.sql(f"DROP TABLE {name}")
    return out


@query("publish_decoded", "SELECT symbol, session, close, volume FROM bars_w", ("bars_w",))
def publish_decoded(spark: S, d: str) -> D:
    """What a reader of the keyed sink decodes."""
    path, b = new_path(spark, "decoded"), v.bars_w(spark, d).select("symbol", "session", "close", "volume")
    publish(b, "symbol", "json", path=path)
    got = spark.read.schema("key string, value string").json(path)
    return got.select(F.col("key").cast("long").alias("symbol"), F.from_json("value", b.drop("symbol").schema).alias("v")).select("symbol", "v.*")


@query("quote_validate", """WITH q AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS trade_date, o_totalprice AS price, o_orderpriority AS basis FROM orders)
  SELECT symbol, trade_date, price, CASE WHEN price IS NULL OR price < 0 THEN 'bad price' WHEN basis = '5-LOW' THEN 'wrong basis' WHEN count(*) OVER (PARTITION BY symbol, trade_date) > 1 THEN 'duplicate' END AS reason FROM q""")
def quote_validate(spark: S, d: str) -> D:
    from pyspark.sql import Window

    path = new_path(spark, "quotes-csv")
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("basis"))
    q.write.csv(path, header=True)
    read = spark.read.schema(q.schema).csv(path, header=True)
    same = F.count("*").over(Window.partitionBy("symbol", "trade_date"))
    rules = [("bad price", F.col("price").isNull() | (F.col("price") < 0)), ("wrong basis", F.col("basis") == "5-LOW"), ("duplicate", same > 1)]
    return read.select("symbol", "trade_date", "price", op.first_reason(rules).alias("reason"))


@query("snapshot_conflicts", "SELECT o_custkey AS symbol, count(*) AS n_rows, count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS n_versions FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus || '|' || o_orderpriority) > 1")
def snapshot_conflicts(spark: S, d: str) -> D:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("symbol")).agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderstatus", "o_orderpriority").alias("n_versions")).where("n_versions > 1")


@query("overwrite_roundtrip", "SELECT symbol, trade_date, close FROM bars_d", ("bars_d",))
def overwrite_roundtrip(spark: S, d: str) -> D:
    path = new_path(spark, "overwrite")
    b = v.bars_d(spark, d).select("symbol", "trade_date", "close")
    b.where("trade_date >= '2001-06-01'").write.parquet(f"{path}/v1")
    b.write.mode("overwrite").parquet(f"{path}/v2")  # a new folder, then readers move on
    return spark.read.schema(b.schema).parquet(f"{path}/v2")


@query("replace_date", "SELECT symbol, session, CASE WHEN session = DATE '2001-10-29' THEN round(close * 2, 4) ELSE close END AS close FROM bars_w", ("bars_w",))
def replace_date(spark: S, d: str) -> D:
    path = new_path(spark, "dates")
    b = v.bars_w(spark, d).select("symbol", "close", "session")
    b.write.partitionBy("session").parquet(path)
    fixed = b.where("session = '2001-10-29'").withColumn("close", rnd(F.col("close") * 2, 4))
    fixed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
    return spark.read.schema(b.schema).parquet(path)


@query("publish_json")
def publish_json(spark: S, d: str) -> D:
    b = v.bars_w(spark, d)
    keyed = b.select(F.col("symbol").cast("string").alias("key"), F.to_json(F.struct("symbol", "session", "close", "volume")).alias("value"))
    path = new_path(spark, "publish")
    keyed.write.json(path)
    return spark.read.schema(keyed.schema).json(path)


@query("publish_since", "SELECT symbol, session, close FROM bars_w WHERE session > (SELECT max(session) FROM bars_w WHERE session < DATE '2001-09-01')", ("bars_w",))
def publish_since(spark: S, d: str) -> D:
    b = v.bars_w(spark, d)
    served = b.where("session < '2001-09-01'").agg(F.max("session").alias("mark"))
    return b.join(F.broadcast(served), F.col("session") > F.col("mark")).select("symbol", "session", "close")


@query("watermarks", "SELECT symbol, max(trade_date) AS watermark FROM bars_d WHERE close > 0 GROUP BY 1", ("bars_d",))
def watermarks(spark: S, d: str) -> D:
    path = new_path(spark, "watermarks")
    w = v.bars_d(spark, d).where("close > 0").groupBy("symbol").agg(F.max("trade_date").alias("watermark"))
    w.write.json(path)
    return spark.read.schema(w.schema).json(path)


CAPTURE = """sha256('["' || symbol || '","' || session || '"]')"""


@query("capture_once", f"SELECT symbol, session, {CAPTURE} AS capture_id FROM bars_w WHERE session >= DATE '2001-09-03' AND NOT (session < DATE '2001-10-01')", ("bars_w",))
def capture_once(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session")
    stored, new = b.where("session < '2001-10-01'"), b.where("session >= '2001-09-03'")
    return op.capture_once(stored, new, ["symbol", "session"])


@query("merge_first_seen", """WITH n AS (SELECT symbol, session, CASE WHEN symbol % 7 = 0 THEN close * 1.02 ELSE close END AS close FROM bars_w WHERE session >= DATE '2001-08-06')
  SELECT n.symbol, n.session, round(n.close, 4) AS close, b.close AS first_value FROM n JOIN bars_w b ON n.symbol = b.symbol AND n.session = b.session AND b.session < DATE '2001-10-01' WHERE abs(n.close - b.close) > 1e-8 * abs(b.close)""", ("bars_w",))
def merge_first_seen(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session", "close")
    new = b.where("session >= '2001-08-06'").withColumn("close", F.when(F.col("symbol") % 7 == 0, F.col("close") * 1.02).otherwise(F.col("close")))
    _, revised = op.merge_first_seen(b.where("session < '2001-10-01'"), new, ["symbol", "session"], "close")
    return revised.withColumn("close", rnd(F.col("close"), 4)).select("symbol", "session", "close", "first_value")


@query("not_null_coerce", "SELECT s_suppkey AS symbol, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0.0) AS acctbal, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_name END, '') AS name FROM supplier")
def not_null_coerce(spark: S, d: str) -> D:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.expr("CASE WHEN s_acctbal > 0 THEN s_acctbal END").alias("acctbal"), F.expr("CASE WHEN s_nationkey % 2 = 0 THEN s_name END").alias("name"))
    return op.not_null(s, {"acctbal": 0.0, "name": ""})


@query("schema_evolution", "SELECT symbol, session, CASE WHEN session >= DATE '2001-06-04' THEN volume END AS volume FROM bars_w", ("bars_w",))
def schema_evolution(spark: S, d: str) -> D:
    path = new_path(spark, "evolution")
    b = v.bars_w(spark, d)
    b.where("session < '2001-06-04'").select("symbol", "session").write.parquet(f"{path}/v=1")
    b.where("session >= '2001-06-04'").select("symbol", "session", "volume").write.parquet(f"{path}/v=2")
    return spark.read.option("mergeSchema", "true").parquet(path).select("symbol", "session", "volume")


@query("repartition_layout", "SELECT trade_date AS day, count(*) AS n_rows FROM bars_d GROUP BY 1", ("bars_d",))
def repartition_layout(spark: S, d: str) -> D:
    path = new_path(spark, "layout")
    b = v.bars_d(spark, d).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    b.repartition("month").write.partitionBy("month").parquet(f"{path}/month")
    spark.read.parquet(f"{path}/month").withColumn("day", F.col("trade_date")).repartition("day").write.partitionBy("day").parquet(f"{path}/day")
    return spark.read.parquet(f"{path}/day").groupBy("day").agg(F.count("*").alias("n_rows"))


@query("compact_files")
def compact_files(spark: S, d: str) -> D:
    """Small files of each year's folder put together by bytes; files and rows before and after."""
    path = new_path(spark, "compact")
    b = v.bars_w(spark, d).withColumn("year", F.year("session"))
    b.repartition(24).write.partitionBy("year").parquet(f"{path}/small")
    compact(spark, f"{path}/small", f"{path}/large", 1 << 18, ("year",))
    stats = lambda p, name: file_stats(spark.read.parquet(p)).agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows")).withColumn("state", F.lit(name))
    return stats(f"{path}/small", "before").unionByName(stats(f"{path}/large", "after"))


@query("compact_rows", "SELECT symbol, session, close, CAST(year(session) AS INT) AS year FROM bars_w", ("bars_w",))
def compact_rows(spark: S, d: str) -> D:
    """What a compacted table holds."""
    path = new_path(spark, "compact")
    b = v.bars_w(spark, d).select("symbol", "session", "close", F.year("session").alias("year"))
    b.repartition(12).write.partitionBy("year").parquet(f"{path}/small")
    compact(spark, f"{path}/small", f"{path}/large", 1 << 18, ("year",))
    return spark.read.parquet(f"{path}/large")


@query("retention_applied", """WITH s AS (SELECT session, count(*) AS n FROM bars_w GROUP BY 1), m AS (SELECT max(session) AS last FROM s)
  SELECT 'prices' AS name, session AS snapshot_at, n AS n_rows FROM s, m WHERE session >= DATE '2001-06-04' OR session = last UNION ALL SELECT 'training', session, n FROM s, m WHERE session >= DATE '1998-06-01' OR session = last""", ("bars_w",))
def retention_applied(spark: S, d: str) -> D:
    """What two tables still hold after each dropped its snapshots before its own cutoff."""
    path = new_path(spark, "retention")
    b = v.bars_w(spark, d).select("symbol", "close", F.col("session").alias("snapshot_at"))
    for name in ("prices", "training"):
        b.repartition("snapshot_at").write.partitionBy("snapshot_at").parquet(f"{path}/{name}")
    expire(spark, {f"{path}/prices": "2001-06-04", f"{path}/training": "1998-06-01"}, "snapshot_at")
    left = [spark.read.parquet(f"{path}/{name}").groupBy(F.col("snapshot_at").cast("date").alias("snapshot_at")).agg(F.count("*").alias("n_rows")).withColumn("name", F.lit(name)) for name in ("prices", "training")]
    return left[0].unionByName(left[1])


@query("gated_publish", "SELECT symbol, session, score FROM panel_w", ("panel_w",))
def gated_publish(spark: S, d: str) -> D:
    """What is served after a whole cross-section was published, and then ones with too few scores and of a wrong size were tried."""
    root, p = new_path(spark, "gate"), written(v.panel_w(spark, d).select("symbol", "session", "score"), "gate-rows")
    metrics = {"n": F.count("*"), "scored": F.count("score")}
    size = p.count()
    rules = {"fewer than half are scored": lambda m: m["scored"] >= 0.5 * m["n"], "not the expected rows": lambda m: m["n"] == size}
    publish_checked(p, root, metrics, rules)
    thin = p.withColumn("score", F.when(F.pmod(F.xxhash64("symbol", "session"), F.lit(100)) < 45, F.col("score")))
    for bad in (thin, p.where("symbol % 2 = 0")):
        try:
            publish_checked(bad, root, metrics, rules)
        except Refused:
            continue
        raise AssertionError("a bad version was published")
    return served(spark, root)


@query("retention_plan", "SELECT session AS snapshot_at, session < DATE '2001-10-01' AND session <> (SELECT max(session) FROM bars_w) AS expired FROM (SELECT DISTINCT session FROM bars_w)", ("bars_w",))
def retention_plan(spark: S, d: str) -> D:
    s = v.bars_w(spark, d).select(F.col("session").alias("snapshot_at")).distinct()
    last = s.agg(F.max("snapshot_at").alias("last"))
    return s.join(F.broadcast(last)).select("snapshot_at", ((F.col("snapshot_at") < F.lit("2001-10-01").cast("date")) & (F.col("snapshot_at") != F.col("last"))).alias("expired"))


_CONFIGS = ({"horizon": 4, "top": 5}, {"horizon": 13, "top": 5}, {"horizon": 4, "top": 10})


def _experiment_sql(config: dict) -> str:
    h, k, text = config["horizon"], config["top"], canonical(config)
    return f"""SELECT 'momentum' AS name, '{text}' AS config, sha256('{text}') AS config_id, count(*) AS n_dates, round(avg(r), 5) AS mean_return FROM (SELECT session, avg(r) AS r FROM (SELECT session, r, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS place
      FROM (SELECT symbol, session, close / lag(close, 13) OVER w - 1 AS score, lead(close, {h}) OVER w / close - 1 AS r FROM bars_w WINDOW w AS (PARTITION BY symbol ORDER BY session)) WHERE score IS NOT NULL AND r IS NOT NULL) WHERE place <= {k} GROUP BY 1)"""


@query("experiment_log", " UNION ALL ".join(_experiment_sql(c) for c in _CONFIGS), ("bars_w",))
def experiment_log(spark: S, d: str) -> D:
    """One record for each configuration that ran: the mean return of the top names held for its own horizon."""
    from ..operators.evaluation import top_k
    from ..operators.labels import forward_return

    path, w = new_path(spark, "experiments"), series("session")
    b = written(v.bars_w(spark, d).select("symbol", "session", "close"), "experiment-bars")
    for config in _CONFIGS:
        p = b.select("symbol", "session", (F.col("close") / F.lag("close", 13).over(w) - 1).alias("score"), forward_return(F.col("close"), config["horizon"], w).alias("r")).where("score is not null and r is not null")
        r = top_k(p, "score", config["top"]).groupBy("session").agg(F.avg("r").alias("r"))
        record_experiment(r.agg(F.count("*").alias("n_dates"), F.avg("r").alias("mean_return")), path, "momentum", config, "none", "bars_w")
    return spark.read.parquet(path).select("name", "config", "config_id", "metrics.n_dates", rnd(F.col("metrics.mean_return"), 5).alias("mean_return"))


@query("normalize_quotes", "SELECT event_id, CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(ts AS DATE) AS trade_date, replace(upper(event_type), 'VIEW', 'QUOTE') AS kind FROM quotes_log", ("quotes_log",))
def normalize_quotes(spark: S, d: str) -> D:
    q = v.quotes_log(spark, d)
    return q.select("event_id", F.col("price").cast("decimal(18,2)").cast("double").alias("price"), F.to_date("ts").alias("trade_date"), F.replace(F.upper("event_type"), F.lit("VIEW"), F.lit("QUOTE")).alias("kind"))


@query("validate_reason", f"SELECT event_id, {QUOTE_RULES} AS reason FROM quotes_log", ("quotes_log",))
def validate_reason(spark: S, d: str) -> D:
    return _judge(v.quotes_log(spark, d)).select("event_id", "reason")


@query("exclude_benchmark", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') AND NOT starts_with(o_orderpriority, '5')")
def exclude_benchmark(spark: S, d: str) -> D:
    return table(spark, d, "orders").where(~F.col("o_orderpriority").isin("1-URGENT") & ~F.col("o_orderpriority").startswith("5")).select("o_orderkey", "o_orderpriority")


@query("latest_cross_section", "SELECT symbol, trade_date, close FROM bars_d WHERE trade_date = (SELECT max(trade_date) FROM bars_d)", ("bars_d",))
def latest_cross_section(spark: S, d: str) -> D:
    b = v.bars_d(spark, d)
    return b.join(F.broadcast(b.agg(F.max("trade_date").alias("trade_date"))), "trade_date").select("symbol", "trade_date", "close")


@query("date_range", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_shipdate < TIMESTAMP '2001-03-01'")
def date_range(spark: S, d: str) -> D:
    li = table(spark, d, "lineitem").where((F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("2001-03-01").cast("timestamp_ntz")))
    return li.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").alias("price"))


@query("dropna_subset", "SELECT symbol, session, vol FROM panel_w WHERE vol IS NOT NULL", ("panel_w",))
def dropna_subset(spark: S, d: str) -> D:
    return v.panel_w(spark, d).na.drop(subset=["vol"]).select("symbol", "session", "vol")


@query("neutral_fill", "SELECT symbol, session, coalesce(vol, 0.0) AS vol, coalesce(CASE WHEN industry <> 'ASIA' THEN industry END, 'Unknown') AS industry FROM panel_w", ("panel_w",))
def neutral_fill(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).withColumn("industry", F.when(F.col("industry") != "ASIA", F.col("industry")))
    return p.na.fill({"vol": 0.0, "industry": "Unknown"}).select("symbol", "session", "vol", "industry")


@query("freshness", "SELECT symbol, date_diff('day', max(trade_date), DATE '2001-11-04') AS age, date_diff('day', max(trade_date), DATE '2001-11-04') BETWEEN 0 AND 5 AS fresh FROM bars_d GROUP BY 1", ("bars_d",))
def freshness(spark: S, d: str) -> D:
    age = F.datediff(F.lit("2001-11-04").cast("date"), F.max("trade_date")).cast("long")
    return v.bars_d(spark, d).groupBy("symbol").agg(age.alias("age"), age.between(0, 5).alias("fresh"))


@query("coverage_gate", "SELECT session, count(vol) AS scored, count(*) AS members, count(vol) >= 0.5 * count(*) AS publish FROM panel_w GROUP BY 1", ("panel_w",))
def coverage_gate(spark: S, d: str) -> D:
    p = v.panel_w(spark, d).groupBy("session").agg(F.count("vol").alias("scored"), F.count("*").alias("members"))
    return p.withColumn("publish", F.col("scored") >= 0.5 * F.col("members"))


@query("stale_keys", "WITH l AS (SELECT symbol, max(trade_date) AS last FROM bars_d GROUP BY 1) SELECT symbol, last FROM l WHERE date_diff('day', last, (SELECT max(last) FROM l)) > 5", ("bars_d",))
def stale_keys(spark: S, d: str) -> D:
    last = v.bars_d(spark, d).groupBy("symbol").agg(F.max("trade_date").alias("last"))
    return last.join(F.broadcast(last.agg(F.max("last").alias("newest")))).where("datediff(newest, last) > 5").select("symbol", "last")


@query("robust_outliers", """WITH x AS (SELECT o_orderkey, 'price' AS column_name, o_totalprice * CASE WHEN o_orderkey % 997 = 0 THEN 100 ELSE 1 END AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS DOUBLE) FROM orders),
  m AS (SELECT column_name, median(value) AS med, count(*) AS n FROM x GROUP BY 1), dv AS (SELECT x.*, n, abs(value - med) AS dev FROM x JOIN m USING (column_name)), a AS (SELECT column_name, median(dev) AS mad FROM dv GROUP BY 1)
  SELECT o_orderkey, column_name, value FROM dv JOIN a USING (column_name) WHERE n >= 4 AND mad <> 0 AND 0.6745 * dev / mad > 8""")
def robust_outliers(spark: S, d: str) -> D:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 997 == 0, 100).otherwise(1)).alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return op.robust_outliers(o, ["o_orderkey"], ["price", "cust"])


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark: S, d: str) -> D:
    return op.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("adjustment_revision", """WITH n AS (SELECT symbol, session, CASE WHEN symbol % 5 = 0 THEN close * 1.1 WHEN symbol % 11 = 0 AND session = DATE '2001-10-29' THEN close * 1.4 ELSE close END AS close FROM bars_w WHERE session >= DATE '2001-09-03')
  SELECT symbol, count(*) AS n_overlap, count(*) FILTER (WHERE abs(n.close / b.close - 1) > 0.005) AS n_moved, round(max(abs(n.close / b.close - 1)), 6) AS largest,
    (count(*) FILTER (WHERE abs(n.close / b.close - 1) > 0.005) >= 2 AND count(*) FILTER (WHERE abs(n.close / b.close - 1) > 0.005) >= 0.6 * count(*)) OR max(abs(n.close / b.close - 1)) > 0.25 AS restated
  FROM n JOIN bars_w b USING (symbol, session) WHERE b.close > 0 GROUP BY 1""", ("bars_w",))
def adjustment_revision(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session", "close")
    c = F.col("close")
    new = b.where("session >= '2001-09-03'").withColumn("close", F.when(F.col("symbol") % 5 == 0, c * 1.1).when((F.col("symbol") % 11 == 0) & (F.col("session") == F.lit("2001-10-29").cast("date")), c * 1.4).otherwise(c))
    return op.adjustment_revision(new, b, ["symbol", "session"], "symbol", "close").withColumn("largest", r6(F.col("largest")))


@query("bounds", "SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars_d GROUP BY 1", ("bars_d",))
def bounds(spark: S, d: str) -> D:
    return v.bars_d(spark, d).groupBy("symbol").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query("history_start", "SELECT universe.symbol, coalesce(w.last - 5, DATE '1995-01-01')::DATE AS start_date FROM universe LEFT JOIN (SELECT symbol, max(trade_date) AS last FROM bars_d GROUP BY 1) w ON universe.symbol = w.symbol", ("universe", "bars_d"))
def history_start(spark: S, d: str) -> D:
    marks = v.bars_d(spark, d).groupBy("symbol").agg(F.max("trade_date").alias("last"))
    return v.universe(spark, d).join(marks, "symbol", "left").select("symbol", F.coalesce(F.date_sub("last", 5), F.lit("1995-01-01").cast("date")).alias("start_date"))


@query("overlap_reference", "SELECT symbol, trade_date, close FROM (SELECT *, max(trade_date) OVER (PARTITION BY symbol) AS last FROM bars_d) WHERE trade_date >= last - 20", ("bars_d",))
def overlap_reference(spark: S, d: str) -> D:
    from pyspark.sql import Window

    b = v.bars_d(spark, d).withColumn("last", F.max("trade_date").over(Window.partitionBy("symbol")))
    return b.where("trade_date >= date_sub(last, 20)").select("symbol", "trade_date", "close")


@query("snapshot_ready", "SELECT session AS snapshot_at, count(DISTINCT symbol) AS published, (SELECT count(*) FROM universe) AS expected, count(DISTINCT symbol) = (SELECT count(*) FROM universe) AS ready FROM bars_w GROUP BY 1", ("bars_w", "universe"))
def snapshot_ready(spark: S, d: str) -> D:
    n = v.universe(spark, d).agg(F.count("*").alias("expected"))
    got = v.bars_w(spark, d).groupBy(F.col("session").alias("snapshot_at")).agg(F.countDistinct("symbol").alias("published"))
    return got.join(F.broadcast(n)).withColumn("ready", F.col("published") == F.col("expected"))


# set operations


@query("union_labels", "SELECT symbol, session, 'momentum' AS label, score FROM panel_w UNION ALL SELECT symbol, session, 'calm', -vol FROM panel_w WHERE vol IS NOT NULL", ("panel_w",))
def union_labels(spark: S, d: str) -> D:
    p = v.panel_w(spark, d)
    calm = p.where("vol is not null").select("symbol", "session", F.lit("calm").alias("label"), (-F.col("vol")).alias("score"))
    return p.select(F.lit("momentum").alias("label"), "symbol", "score", "session").unionByName(calm)


UNI = ("(SELECT DISTINCT symbol FROM bars_d WHERE trade_date BETWEEN DATE '2001-09-01' AND DATE '2001-09-10')", "(SELECT DISTINCT symbol FROM bars_d WHERE trade_date BETWEEN DATE '2001-10-01' AND DATE '2001-10-10')")


def _members(spark: S, d: str) -> tuple[D, D]:
    b = v.bars_d(spark, d)
    return tuple(b.where(f"trade_date between '2001-{m}-01' and '2001-{m}-10'").select("symbol").distinct() for m in ("09", "10"))


@query("universe_diff", f"SELECT symbol, 'added' AS kind FROM (SELECT symbol FROM {UNI[1]} EXCEPT SELECT symbol FROM {UNI[0]}) UNION ALL SELECT symbol, 'removed' FROM (SELECT symbol FROM {UNI[0]} EXCEPT SELECT symbol FROM {UNI[1]})", ("bars_d",))
def universe_diff(spark: S, d: str) -> D:
    old, new = _members(spark, d)
    return new.exceptAll(old).withColumn("kind", F.lit("added")).unionByName(old.exceptAll(new).withColumn("kind", F.lit("removed")))


@query("keyset_equal", f"SELECT (SELECT count(*) FROM (SELECT symbol FROM {UNI[0]} INTERSECT SELECT symbol FROM {UNI[1]})) AS n_both, (SELECT count(*) FROM {UNI[0]}) = (SELECT count(*) FROM (SELECT symbol FROM {UNI[0]} UNION SELECT symbol FROM {UNI[1]})) AND (SELECT count(*) FROM {UNI[1]}) = (SELECT count(*) FROM (SELECT symbol FROM {UNI[0]} UNION SELECT symbol FROM {UNI[1]})) AS equal", ("bars_d",))
def keyset_equal(spark: S, d: str) -> D:
    old, new = _members(spark, d)
    m = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), "symbol", "full")
    return m.agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("n_both"), (F.count_if(F.col("o").isNull() | F.col("n").isNull()) == 0).alias("equal"))


@query("distinct_dates", "SELECT DISTINCT trade_date FROM bars_d", ("bars_d",))
def distinct_dates(spark: S, d: str) -> D:
    return v.bars_d(spark, d).select("trade_date").distinct()


@query("upsert_keep_last", "SELECT symbol, session, close FROM bars_w WHERE symbol NOT IN (SELECT symbol FROM ledger) UNION ALL SELECT symbol, session, round(close / 2, 4) FROM bars_w WHERE symbol IN (SELECT symbol FROM ledger)", ("bars_w", "ledger"))
def upsert_keep_last(spark: S, d: str) -> D:
    b = v.bars_w(spark, d).select("symbol", "session", "close")
    new = b.join(v.ledger(spark, d).select("symbol"), "symbol", "left_semi").withColumn("close", rnd(F.col("close") / 2, 4))
    return op.replace_keys(b, new, ["symbol"])


# scalar functions


@query("string_functions", "SELECT s_suppkey, replace(s_name, '#', '-') AS a, starts_with(s_name, 'Supplier#00000000') AS b, upper(trim(s_name)) AS c, s_name || '.NS' AS e, regexp_matches(s_name, '(7|9)$') AS f FROM supplier")
def string_functions(spark: S, d: str) -> D:
    n = F.col("s_name")
    return table(spark, d, "supplier").select("s_suppkey", F.replace(n, F.lit("#"), F.lit("-")).alias("a"), n.startswith("Supplier#00000000").alias("b"), F.upper(F.trim(n)).alias("c"), F.concat(n, F.lit(".NS")).alias("e"), n.rlike("(7|9)$").alias("f"))


@query("date_functions", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (CAST(o_orderdate AS DATE) + 7)::DATE AS later, CAST(quarter(o_orderdate) AS BIGINT) AS q, strftime(o_orderdate, '%Y-%m') AS month,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders""")
def date_functions(spark: S, d: str) -> D:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), F.date_add(day, 7).alias("later"), F.quarter(day).cast("long").alias("q"), F.date_format(day, "yyyy-MM").alias("month"), F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("age"), F.last_day(day).alias("month_end"))


@query("local_date", "SELECT event_id, CAST(ts + INTERVAL '5 hours 30 minutes' AS DATE) AS local_day FROM events")
def local_date(spark: S, d: str) -> D:
    return table(spark, d, "events").select("event_id", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts").cast("timestamp_ntz"))).alias("local_day"))


@query("math_functions", "SELECT s_suppkey, round(ln(abs(s_acctbal) + 1), 6) AS lg, round(sqrt(abs(s_acctbal)), 6) AS rt, least(greatest(s_acctbal, 0), 5000) AS clipped, CAST(floor(s_acctbal / 100) AS BIGINT) AS bucket, round(exp(s_acctbal / 10000), 6) AS ex FROM supplier")
def math_functions(spark: S, d: str) -> D:
    x = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", r6(F.log(F.abs(x) + 1)).alias("lg"), r6(F.sqrt(F.abs(x))).alias("rt"), F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("clipped"), F.floor(x / 100).cast("long").alias("bucket"), r6(F.exp(x / 10000)).alias("ex"))


@query("sigmoid", "SELECT s_suppkey, round(1 / (1 + exp(-greatest(least(s_acctbal / 100, 35), -35))), 6) AS p FROM supplier")
def sigmoid_q(spark: S, d: str) -> D:
    return table(spark, d, "supplier").select("s_suppkey", r6(sigmoid(F.col("s_acctbal") / 100)).alias("p"))


@query("net_return", "SELECT symbol, session, round((1 + ret) * (1 - 0.001) / (1 + 0.001) - 1, 6) AS net FROM panel_w", ("panel_w",))
def net_return_q(spark: S, d: str) -> D:
    return v.panel_w(spark, d).select("symbol", "session", r6(net_return(F.col("ret"), 0.001)).alias("net"))


@query("json_functions", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def json_functions(spark: S, d: str) -> D:
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    again = e.select("event_id", "p", F.to_json(F.struct((F.col("p.k") * 2).alias("k"))).alias("j"))
    return again.select("event_id", "p.k", F.get_json_object("j", "$.k").cast("long").alias("twice"))


@query("fingerprint", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS id FROM events""")
def fingerprint(spark: S, d: str) -> D:
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type")), 256).alias("id"))


@query("array_functions", "SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS INT) AS first_line, round(sum(l_quantity * 2), 2) AS doubled FROM lineitem GROUP BY 1")
def array_functions(spark: S, d: str) -> D:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("xs"))
    return g.select("l_orderkey", F.size("xs").cast("long").alias("n"), F.element_at("xs", 1)["l_linenumber"].alias("first_line"), rnd(F.aggregate(F.transform("xs", lambda x: x["l_quantity"] * 2), F.lit(0.0), lambda a, x: a + x), 2).alias("doubled"))


@query("assign_split", "WITH c AS (SELECT *, count(*) OVER () AS n FROM calendar_w) SELECT session, CASE WHEN idx >= floor(n * 0.8) THEN 'test' WHEN idx >= floor(n * 0.8) - 21 THEN 'embargo' ELSE 'train' END AS split FROM c", ("calendar_w",))
def assign_split(spark: S, d: str) -> D:
    from ..operators.labels import assign_split as split

    return split(v.calendar_w(spark, d), test=0.2, embargo=21).select("session", "split")
