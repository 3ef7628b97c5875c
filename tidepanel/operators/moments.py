"""Linear models of many folds and feature sets from one pass: sums of products by session, added up over sessions.

A least-squares fit needs only the sums of products of its columns. One grouped sum gives those of all features and labels for each
session; sums up to any session, or of any span of sessions, are differences of running sums, so every expanding fold, every subset of
features and every label is a small solve, and the error on a test span follows from that span's own sums. What comes to the driver is one
row a session, (1 + features + labels)^2 / 2 numbers wide."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """dates in order; sums[k] holds the products of columns over all sessions before dates[k] (one more row than dates)."""

    columns: list[str]
    dates: list
    sums: np.ndarray

    def before(self, date) -> np.ndarray:
        """Sums of products over the sessions before a date."""
        return self.sums[int(np.searchsorted(np.array(self.dates, "datetime64[D]"), np.datetime64(str(date))))]

    def between(self, start, end) -> np.ndarray:
        """Over sessions from start on and before end."""
        return self.before(end) - self.before(start)


def session_moments(panel: DataFrame, features: list[str], labels: list[str], date: str = "session") -> Moments:
    """Rows with an unknown feature or label do not count."""
    columns = [*features, *labels]
    known = panel.select(F.col(date).cast("date").alias("_d"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    one = F.lit(1.0)
    cell = lambda k: one if k == 0 else F.col(columns[k - 1])
    n = len(columns) + 1
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    rows = known.groupBy("_d").agg(*[F.sum(cell(i) * cell(j)).alias(f"s{i}_{j}") for i, j in pairs]).orderBy("_d").collect()  # one row a session
    by = np.zeros((len(rows) + 1, n, n))
    for k, r in enumerate(rows):
        for i, j in pairs:
            by[k + 1, i, j] = by[k + 1, j, i] = r[f"s{i}_{j}"]
    return Moments(["1", *columns], [r["_d"] for r in rows], by.cumsum(axis=0))


def solve(m: np.ndarray, columns: list[str], features: list[str], label: str) -> np.ndarray | None:
    """Intercept and weights of the least-squares fit; None without rows, the shortest of all solutions where features depend on each other."""
    if not m[0, 0]:
        return None
    at, y = [0, *[columns.index(f) for f in features]], columns.index(label)
    return np.linalg.lstsq(m[np.ix_(at, at)], m[at, y], rcond=1e-12)[0]


def checked(m: np.ndarray, columns: list[str], features: list[str], label: str, weights: np.ndarray) -> tuple[int, float, float]:
    """(rows, mean prediction, root mean squared error) of a fit on the rows that m sums up."""
    at, y, n = [0, *[columns.index(f) for f in features]], columns.index(label), m[0, 0]
    if not n:
        return 0, float("nan"), float("nan")
    squares = m[y, y] - 2 * weights @ m[at, y] + weights @ m[np.ix_(at, at)] @ weights
    return int(round(n)), float(weights @ m[at, 0] / n), float(np.sqrt(max(squares, 0.0) / n))


def linear_folds(m: Moments, features: list[str], label: str, folds: list[tuple[str, str]], embargo_days: int) -> list[tuple[int, int, float, float, list[float]]]:
    """(fold, rows, mean prediction, root mean squared error, intercept and weights) of each test span [start, end), fitted on what lies an embargo before it."""
    out = []
    for k, (start, end) in enumerate(folds):
        cut = np.datetime64(start) - np.timedelta64(embargo_days, "D")
        weights = solve(m.before(cut), m.columns, features, label)
        if weights is not None:
            out.append((k, *checked(m.between(start, end), m.columns, features, label, weights), [float(w) for w in weights]))
    return out


def linear_ablation(m: Moments, sets: dict[str, list[str]], labels: list[str], fit_before: str, check_from: str) -> list[tuple[str, str, int, float]]:
    """(feature set, label, rows checked, root mean squared error) of all sets and labels, fitted on the sessions before one date and checked from another on."""
    out = []
    for name, features in sets.items():
        for label in labels:
            weights = solve(m.before(fit_before), m.columns, features, label)
            if weights is not None:
                rest = m.sums[-1] - m.before(check_from)
                n, _, error = checked(rest, m.columns, features, label, weights)
                out.append((name, label, n, error))
    return out
