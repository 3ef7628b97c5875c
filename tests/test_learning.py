"""Fitted models against plain least squares and Newton steps."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidepanel.operators import evaluation as ev
from tidepanel.operators import learning


def newton(x, y, weight, penalty):
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - y)) / weight.sum() + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + np.diag(penalty)
        w = w - np.linalg.solve(hess + 1e-12 * np.eye(len(w)), grad)
    return w


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, [1.0, 3.0], (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.3 * x[:, 1])))).astype(float)
    w = rng.choice([0.5, 1.0, 2.0], 400)
    return x, y, w, spark.createDataFrame([(*map(float, r), float(b), float(c)) for r, b, c in zip(x, y, w, strict=True)], "a double, b double, y double, w double")


def test_penalized_logistic_by_newton(sample):
    x, y, w, frame = sample
    model = learning.probability(frame, ["a", "b"], "y", "w", penalty=0.05).stages[-1]
    centre = (w @ x) / w.sum()
    spread = np.sqrt((w @ (x - centre) ** 2) / (w.sum() - (w @ w) / w.sum()))
    want = newton(x, y, w, np.r_[0.0, 0.05 * spread**2])
    assert [model.intercept, *model.coefficients] == pytest.approx(want.tolist(), abs=2e-3)


def test_platt_curve_by_newton(sample):
    x, y, _, frame = sample
    model = learning.platt(frame, "a", "y")
    want = newton(x[:, :1], y, np.ones(len(y)), np.zeros(2))
    got = model.transform(frame).select(vector_to_array("platt")[1].alias("p"), "a").collect()
    assert [r["p"] for r in got] == pytest.approx([1 / (1 + np.exp(-want[0] - want[1] * r["a"])) for r in got], abs=2e-3)
    assert learning.platt(frame.limit(50), "a", "y") is None
    # a session that has observed metrics cannot be sent to tasks; a model must not hold it
    seen = Observation("seen")
    frame.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 400} and model.transform(frame).select(vector_to_array("platt")[1].alias("p")).where("p > 0").count() == 400


def test_ridge_ranker_by_closed_form(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal()) if k % 7 else None, "xyz"[k % 3], float(rng.normal())) for k in range(210)]
    frame = spark.createDataFrame([(a, c, y + (a or 0) + "xyz".index(c)) for a, c, y in rows], "a double, c string, y double")
    model = learning.ridge_ranker(frame, ["a"], "c", "y", penalty=0.3)
    flagged = frame.withColumn("a_missing", F.col("a").isNull().cast("double"))
    out = model.transform(flagged).select(vector_to_array("features").alias("f"), "y", "prediction").collect()
    x, y = np.array([r["f"] for r in out]), np.array([r["y"] for r in out])
    known = sorted(a for a, _, _ in rows if a is not None)
    assert {r["f"][0] for r, (a, _, _) in zip(out, rows, strict=True) if a is None} <= set(known)
    sx, sy = x.std(axis=0, ddof=1), y.std(ddof=1)
    use = sx > 0
    d = x[:, use] - x[:, use].mean(axis=0)
    w = np.linalg.solve(d.T @ d / len(y) + np.diag(0.3 / sy * sx[use] ** 2), d.T @ (y - y.mean()) / len(y))
    assert [r["prediction"] for r in out] == pytest.approx((y.mean() + d @ w).tolist(), abs=5e-3)  # the learner iterates


def test_bootstrap_interval_by_the_same_draws(spark):
    """Draws as hashes say; means and quantiles as numpy has them."""
    values = [float(x) for x in np.random.default_rng(1).normal(0.1, 1, 40)]
    diffs = spark.createDataFrame(list(enumerate(values)), "i long, d double")
    got = ev.bootstrap_interval(diffs, "d", 200).first()
    picks = spark.range(200).withColumnRenamed("id", "draw").withColumn("k", F.explode(F.expr("sequence(0L, 39L)"))).select("draw", F.pmod(F.xxhash64(F.lit(7), "draw", "k"), F.lit(40)).alias("i")).collect()
    by = {}
    for r in picks:
        by.setdefault(r["draw"], []).append(values[r["i"]])
    means = [np.mean(x) for x in by.values()]
    assert (got["mean"], got["low"], got["high"]) == pytest.approx((np.mean(values), np.quantile(means, 0.025), np.quantile(means, 0.975)))


def test_ablation_checks_a_feature_set_in_one_pass(spark):
    """Figures are those of each learner by itself, and rows to check are read once a feature set, not once a combination."""
    rng = np.random.default_rng(4)
    data = [(float(a), float(b), float(a + 0.1 * e), None if k % 5 == 0 else float(b - e)) for k, (a, b, e) in enumerate(rng.normal(size=(200, 3)))]
    frame = spark.createDataFrame(data, "a double, b double, y double, z double")
    train, check, seen = frame.limit(150).localCheckpoint(), frame.localCheckpoint(), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    got = learning.ablation(train, check.withColumn("a", counted.asNondeterministic()("a")), {"one": ["a"], "two": ["a", "b"]}, ["y", "z"], ["linear", "forest"])
    assert seen.value == 2 * 200
    assert [g[:4] for g in got] == [(s, label, kind, n) for s in ("one", "two") for label, n in (("y", 200), ("z", 160)) for kind in ("linear", "forest")]
    for name, label, kind, _, error in got:
        model = learning.fitted(train, {"one": ["a"], "two": ["a", "b"]}[name], label, kind)
        alone = model.transform(check).agg(F.sqrt(F.avg((F.col(label) - F.col("prediction")) ** 2))).first()[0]
        assert error == pytest.approx(alone, rel=1e-9)
