"""Gates, compaction, retention, records; bootstrap of a family; moments."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluation as ev
from tidepanel.operators import moments
from tidepanel.operators.ingest import version_availability
from tidepanel.sources import upkeep

DAY = datetime.date(2020, 1, 6)


def test_a_thin_snapshot_stays_unpublished(spark, tmp_path):
    root = f"file://{tmp_path}/scores"
    rows = lambda known: spark.range(100).withColumn("score", F.when(F.col("id") < known, F.col("id") * 1.0))
    metrics = {"n": F.count("*"), "scored": F.count("score")}
    rules = {"coverage": lambda m: m["scored"] >= 0.5 * m["n"]}
    assert upkeep.served(spark, root) is None
    with pytest.raises(upkeep.Refused, match="coverage"):
        upkeep.publish_checked(rows(49), root, metrics, rules)
    assert upkeep.served(spark, root) is None
    assert upkeep.publish_checked(rows(50), root, metrics, rules) == {"n": 100, "scored": 50}
    with pytest.raises(upkeep.Refused):
        upkeep.publish_checked(rows(49), root, metrics, rules)
    assert upkeep.served(spark, root).where("score is not null").count() == 50
    upkeep.publish_checked(rows(80), root, metrics, rules)
    assert upkeep.served(spark, root).where("score is not null").count() == 80
    # a version that was written but not found good, as after a stop between the two, is not served
    rows(10).write.parquet(f"{root}/version=9")
    assert upkeep.served(spark, root).where("score is not null").count() == 80


def files(path):
    return sorted((os.path.relpath(d, path), os.path.getsize(f"{d}/{n}")) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_compaction_follows_bytes(spark, tmp_path):
    rows = spark.range(40_000).select("id", (F.col("id") % 4).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.where("part < 3").repartition(20).write.partitionBy("part").parquet(f"{tmp_path}/small")
    rows.where("part = 3").coalesce(1).write.partitionBy("part").mode("append").parquet(f"{tmp_path}/small")
    before = files(f"{tmp_path}/small")
    target = 200_000
    n = upkeep.compact(spark, f"file://{tmp_path}/small", f"file://{tmp_path}/large", target, ("part",))
    after = files(f"{tmp_path}/large")
    assert n == (len(before), len(after)) and len(after) < len(before) / 3
    for part in range(4):
        total = sum(s for p, s in before if p == f"part={part}")
        sizes = [s for p, s in after if p == f"part={part}"]
        assert len(sizes) == 1 if part == 3 else abs(len(sizes) - total / target) <= 1
        assert max(sizes) < max(1.5 * target, 1.2 * total * (part == 3))
    back = spark.read.parquet(f"file://{tmp_path}/large")
    assert back.select("id", "part", "text").exceptAll(rows.select("id", F.col("part").cast("int"), "text")).count() == 0 and back.count() == 40_000
    spark.createDataFrame([], "id long, part long").write.parquet(f"{tmp_path}/none")
    assert upkeep.compact(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/none2", target)[1] == 0


def test_retention_drops_folders(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2020-0{m}-01") for m in range(1, 6) for k in range(2)], "k int, at string")
    for name in ("short", "long", "old"):
        rows.write.partitionBy("at").parquet(f"{tmp_path}/{name}")
    at = lambda name: f"file://{tmp_path}/{name}"
    gone = upkeep.expire(spark, {at("short"): "2020-04-01", at("long"): "2020-02-01", at("old"): "2021-01-01"}, "at")
    assert gone.groupBy("path").count().collect() and gone.count() == 3 + 1 + 4
    left = {name: sorted(n for n in os.listdir(f"{tmp_path}/{name}") if n.startswith("at=")) for name in ("short", "long", "old")}
    assert left == {"short": ["at=2020-04-01", "at=2020-05-01"], "long": [f"at=2020-0{m}-01" for m in range(2, 6)], "old": ["at=2020-05-01"]}


def test_records_keep_their_configuration(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    for k in (1, 2):
        upkeep.record_experiment(spark.range(k).agg(F.count("*").alias("n")), at, "x", {"b": k, "a": 1}, "abc", "s1")
    rows = {r["config"]: r for r in spark.read.parquet(at).collect()}
    assert set(rows) == {'{"a":1,"b":1}', '{"a":1,"b":2}'} and len({r["config_id"] for r in rows.values()}) == 2
    assert rows['{"a":1,"b":2}']["metrics"]["n"] == 2 and rows['{"a":1,"b":2}']["commit"] == "abc"


def test_contents_that_come_back_are_not_new(spark):
    day = lambda n: DAY + datetime.timedelta(n)
    rows = [("s", 0, "a", day(0), day(0)), ("s", 1, "b", day(3), day(1)), ("s", 2, "a", day(5), day(1)), ("s", 3, "c", day(7), day(20)), ("s", 4, "b", day(9), day(2)), ("t", 5, "b", day(4), day(1)), ("s", 6, None, day(10), day(0))]
    out = version_availability(spark.createDataFrame(rows, "source string, id long, content string, seen date, available date"), ["source"], "content", ["seen", "id"], "available")
    got = {r["id"]: (r["changed"], r["available"]) for r in out.collect()}
    assert got == {0: (False, day(0)), 1: (True, day(4)), 2: (False, day(1)), 3: (True, day(20)), 4: (False, day(2)), 5: (False, day(1)), 6: (True, day(11))}


def test_family_bootstrap_by_the_same_hashes(spark):
    rng = np.random.default_rng(4)
    dates = [DAY + datetime.timedelta(7 * k) for k in range(60)]
    x = {p: rng.normal(m, 1, 60) for p, m in (("a", 0.3), ("b", 0.0), ("c", -0.2))}
    rows = [(p, d, float(v)) for p, vs in x.items() for d, v in zip(dates, vs, strict=True) if not (p == "c" and d == dates[3])] + [("a", DAY, None)]
    frame = spark.createDataFrame(rows, "pair string, d date, v double").repartition(7)
    got = {r["pair"]: r for r in ev.bootstrap_family(frame, "pair", "d", "v", draws=300).collect()}
    i = np.array([(d - datetime.date(1970, 1, 1)).days for d in dates])
    w = ev._draw_weights(i, 300, 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    means, centre = {}, {}
    for p, vs in x.items():
        keep = np.ones(60, bool) if p != "c" else np.arange(60) != 3
        means[p] = (vs[keep] @ w[keep]) / w[keep].sum(axis=0)
        centre[p] = vs[keep].mean()
    worst = np.max([np.abs(m - centre[p]) / m.std(ddof=1) for p, m in means.items()], axis=0)
    reach = np.quantile(worst, 0.95)
    for p, m in means.items():
        low, high = np.quantile(m, [0.05 / 6, 1 - 0.05 / 6])
        want = (59 if p == "c" else 60, centre[p], low, high, centre[p] - reach * m.std(ddof=1), centre[p] + reach * m.std(ddof=1))
        assert tuple(got[p][c] for c in ("n", "mean", "low", "high", "simultaneous_low", "simultaneous_high")) == pytest.approx(want)
    assert ev.bootstrap_family(frame.limit(0), "pair", "d", "v", draws=10).count() == 0


def test_moments_fit_and_check_as_least_squares(spark):
    rng = np.random.default_rng(5)
    day = lambda k: DAY + datetime.timedelta(7 * k)
    rows = [(day(k), *[float(z) for z in rng.normal(k / 10, 1, 3)]) for k in range(40) for _ in range(5)]
    frame = spark.createDataFrame(rows + [(day(1), None, 1.0, 1.0)], "session date, a double, b double, y double")
    m = moments.session_moments(frame, ["a", "b"], ["y"])
    found = moments.linear_folds(m, ["a", "b"], "y", [(str(day(20)), str(day(30))), (str(day(30)), str(day(40)))], 14)
    assert [f[0] for f in found] == [0, 1]
    for k, n, mean, error, weights in found:
        start = 20 + 10 * k
        past = np.array([r[1:] for r in rows if r[0] < day(start - 2)])
        test = np.array([r[1:] for r in rows if day(start) <= r[0] < day(start + 10)])
        w = np.linalg.lstsq(np.c_[np.ones(len(past)), past[:, :2]], past[:, 2], rcond=None)[0]
        p = np.c_[np.ones(len(test)), test[:, :2]] @ w
        assert (n, mean, error) == (len(test), pytest.approx(p.mean()), pytest.approx(np.sqrt(np.mean((test[:, 2] - p) ** 2)))) and weights == pytest.approx(w.tolist())
    assert moments.linear_folds(m, ["a"], "y", [(str(day(0)), str(day(5)))], 14) == []
    assert [x[:3] for x in moments.linear_ablation(m, {"a": ["a"]}, ["y"], str(day(10)), str(day(35)))] == [("a", "y", 25)]
