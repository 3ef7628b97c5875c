"""Average ranks over parts against plain counting."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.ranks import ranked


def plain(values, descending=False):
    known = [x for x in values if x is not None and abs(x) < float("inf")]
    out = []
    for x in values:
        if x is None or not abs(x) < float("inf"):
            out.append((None, len(known)))
            continue
        ahead = sum(y > x if descending else y < x for y in known)
        out.append((ahead + (sum(y == x for y in known) + 1) / 2, len(known)))
    return out


@pytest.fixture(scope="module")
def panel(spark):
    """Groups larger than a part, of one value, without a known value, of one row, and one whose key is null."""
    rng, odd, rows = random.Random(5), [None, float("nan"), float("inf"), float("-inf")], []
    for g, (n, make) in {1: (300, lambda: rng.choice([*odd, round(rng.uniform(-3, 3), 1), -0.0, 0.0])), 2: (120, lambda: 7.0), 3: (40, lambda: None), 4: (1, lambda: -1e300), None: (90, lambda: rng.gauss(0, 1e-8))}.items():
        rows += [(g, k, make(), rng.choice([None, 1.0, 2.0])) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g int, k int, x double, y double").repartition(3), rows


@pytest.mark.parametrize("part", [7, 50, 1000])
def test_ranks_by_counting(panel, part):
    frame, rows = panel
    got = {(r["g"], r["k"]): ((r["a"], r["n_a"]), (r["b"], r["n_b"])) for r in ranked(frame, {"a": F.col("x"), "b": F.col("y")}, "g", descending=("b",), part_rows=part).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for r, a, b in zip(mine, plain([r[2] for r in mine]), plain([r[3] for r in mine], True), strict=True):
            assert got[g, r[1]] == (a, b), r


def test_no_task_holds_a_group(spark):
    """A group of many parts is ranked by as many tasks, and no row of it passes a shuffle by the group alone."""
    frame = spark.range(4000).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(4001)).cast("double").alias("x"))
    out = ranked(frame, {"r": F.col("x")}, "g", part_rows=200)
    assert out.agg(F.sum("r"), F.min("n_r"), F.countDistinct("r")).first()[:] == (4000 * 4001 / 2, 4000, 4000)
    sizes = [r["n"] for r in spark.read.parquet(*out.inputFiles()).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and len(sizes) > 10 and max(sizes) < 800


def test_rank_ic_of_one_large_date(spark):
    """Ranks of a date that spans parts are those of the whole date, and the correlation with itself is 1."""
    from tidepanel.operators import evaluation as ev

    panel = spark.range(3000).select(F.lit(1).alias("session"), F.pmod(F.col("id") * 31, F.lit(97)).cast("double").alias("score")).withColumn("ret", F.col("score") * 2)
    assert [tuple(r) for r in ev.rank_ic(panel, "score", "ret", ["session"]).collect()] == [(1, 3000, pytest.approx(1.0))]
