"""What a table of four features and a label is like, and whether it is like the generator says.

Everything is one aggregation by label, whose sums and sketches merge, so each task sends a few
numbers per label, whatever the size of the table.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import erf, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.sources.datasets import FEATURE_COLS

# Quantiles that are compared, and the accuracy of their sketch.
QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
ACCURACY = 10_000

# A figure may be so many standard errors from what is expected.
ERRORS = 5.0

PAIRS = list(combinations_with_replacement(range(len(FEATURE_COLS)), 2))


def distribution(df: DataFrame) -> DataFrame:
    """Means, covariances and quantiles of the features by label, one row each.

    Returns ``label, n, mean_f0.., cov_f0_f0, cov_f0_f1.., quantiles_f0..``; covariances are those of the
    population, quantiles those of ``QUANTILES``.
    """
    means = [F.avg(c).alias(f"mean_{c}") for c in FEATURE_COLS]
    covs = [
        F.covar_pop(FEATURE_COLS[i], FEATURE_COLS[j]).alias(f"cov_{FEATURE_COLS[i]}_{FEATURE_COLS[j]}")
        for i, j in PAIRS
    ]
    sketches = [
        F.percentile_approx(c, list(QUANTILES), ACCURACY).alias(f"quantiles_{c}") for c in FEATURE_COLS
    ]
    return df.groupBy("label").agg(F.count("*").alias("n"), *means, *covs, *sketches)


# The signs of f0, f1, f2 at the centres of the clusters of each class.
CENTRES = {0: [(1, 1, 1), (-1, -1, -1)], 1: [(1, -1, 1), (-1, 1, 1)]}


def _moments(label: int, sep: float, flip: float) -> tuple[list[float], list[list[float]]]:
    """Means and covariances of a label: its two clusters, and a few rows of the other class."""
    weights = [
        (share / 2, [sep * s for s in signs] + [0.0])
        for c, share in ((label, 1 - flip / 2), (1 - label, flip / 2))
        for signs in CENTRES[c]
    ]
    mean = [sum(w * m[i] for w, m in weights) for i in range(4)]
    cov = [
        [sum(w * m[i] * m[j] for w, m in weights) + (i == j) - mean[i] * mean[j] for j in range(4)]
        for i in range(4)
    ]
    return mean, cov


def _below(x: float, feature: int, label: int, sep: float, flip: float) -> float:
    """The share of a label's rows whose feature is below ``x``."""
    total = 0.0
    for c, share in ((label, 1 - flip / 2), (1 - label, flip / 2)):
        for signs in CENTRES[c]:
            centre = sep * signs[feature] if feature < 3 else 0.0
            total += share / 2 * (0.5 + 0.5 * erf((x - centre) / sqrt(2)))
    return total


def differences(rows: list, sep: float = 1.5, flip: float = 0.01) -> list[str]:
    """What in the rows of :func:`distribution` is not as :func:`add_classification` promises; none if all is."""
    wrong = []

    def check(name: str, found: float, expected: float, error: float) -> None:
        if not abs(found - expected) <= ERRORS * error:
            wrong.append(f"{name} is {found:.4g}, not {expected:.4g}")

    total = sum(r["n"] for r in rows)
    if {r["label"] for r in rows} != {0, 1}:
        return [f"labels are {sorted(str(r['label']) for r in rows)}"]
    for row in rows:
        label, n = row["label"], row["n"]
        check(f"share of {label}", n / total, 0.5, 0.5 / sqrt(total))
        mean, cov = _moments(label, sep, flip)
        for i, c in enumerate(FEATURE_COLS):
            check(f"mean of {c} in {label}", row[f"mean_{c}"], mean[i], sqrt(1 + sep**2) / sqrt(n))
            for q, x in zip(QUANTILES, row[f"quantiles_{c}"], strict=True):
                error = sqrt(q * (1 - q) / n) + 1 / ACCURACY
                check(f"{q} quantile of {c} in {label}", _below(x, i, label, sep, flip), q, error)
        for i, j in PAIRS:
            name = f"cov_{FEATURE_COLS[i]}_{FEATURE_COLS[j]}"
            check(f"{name} in {label}", row[name], cov[i][j], sqrt(2 + 4 * sep**2) / sqrt(n))
    return wrong


def is_classification(df: DataFrame, sep: float = 1.5, flip: float = 0.01) -> bool:
    """Whether a table is distributed as the generator's with these parameters."""
    return not differences(distribution(df).collect(), sep, flip)
