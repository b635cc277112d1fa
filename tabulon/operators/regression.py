"""LINEST, LOGEST, TREND and GROWTH with several x columns, per group.

Means and central moments are aggregates with a partial form; what is solved afterwards is one system per group, as
large as the number of x columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A system counts as singular if its scaled matrix has a larger condition number.
WORST = 1e12


def _solve(frame: pd.DataFrame) -> pd.Series:
    """Coefficients of each row's normal equations: ``xx`` a k x k matrix by rows, ``xy`` k numbers; null if singular."""

    def one(xx, xy):
        if any(v is None or v != v for v in [*xx, *xy]):
            return None
        a, b = np.asarray(xx, float).reshape(len(xy), len(xy)), np.asarray(xy, float)
        scale = np.sqrt(np.diag(a))
        if not (scale > 0).all():
            return None
        scaled = a / np.outer(scale, scale)
        return None if np.linalg.cond(scaled) > WORST else (np.linalg.solve(scaled, b / scale) / scale).tolist()

    return pd.Series([one(xx, xy) for xx, xy in zip(frame.xx, frame.xy)], dtype=object)


def linest(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], const: bool = True, logarithmic: bool = False) -> DataFrame:
    """One row per group: ``slopes`` (an array in the order of ``xs``), intercept, r2, se_y, df, error.

    With ``logarithmic`` it is LOGEST: slopes and intercept are the factors of an exponential curve; r2 and se_y are those
    of ln(y). Without ``const`` the intercept is 0 (1 for LOGEST) and r2 counts from zero. Rows in which any of the
    columns is blank or no number are left out. A group of too few rows or of linearly dependent columns has #NUM!, as has
    a LOGEST of a y that isn't positive; its other columns are blank.
    """
    keys, names = [f"_b{i}" for i in range(len(by))], [f"_x{i}" for i in range(len(xs))]
    taken = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(y).try_cast("double").alias("_y"), *[F.col(x).try_cast("double").alias(n) for x, n in zip(xs, names)]).dropna(subset=["_y", *names])
    low = taken.withColumn("_low", F.col("_y") <= 0) if logarithmic else taken.withColumn("_low", F.lit(False))
    if logarithmic:
        low = low.withColumn("_y", F.when(F.col("_y") > 0, F.ln("_y")))
    moment = F.covar_pop if const else lambda a, b: F.avg(F.col(a) * F.col(b))
    sums = low.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("_low").alias("low"),
        F.array(*[moment(a, b) for a in names for b in names]).alias("xx"),
        F.array(*[moment(a, "_y") for a in names]).alias("xy"),
        moment("_y", "_y").alias("yy"),
        F.avg("_y").alias("my"),
        F.array(*[F.avg(a) for a in names]).alias("mx"),
    )
    solved = sums.withColumn("b", F.pandas_udf(_solve, "array<double>")(F.struct("xx", "xy")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    degrees = F.col("n") - len(xs) - (1 if const else 0)
    left = F.greatest(F.col("yy") - dot("b", "xy"), F.lit(0.0))
    intercept = F.col("my") - dot("b", "mx") if const else F.lit(0.0)
    bad = F.col("b").isNull() | (degrees < 0) | F.col("low")
    shown = {
        "slopes": F.transform("b", F.exp) if logarithmic else F.col("b"),
        "intercept": F.exp(intercept) if logarithmic else intercept,
        "r2": 1 - F.try_divide(left, F.col("yy")),
        "se_y": F.sqrt(F.try_divide(left * F.col("n"), degrees)),
        "df": degrees.cast("double"),
    }
    return solved.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[F.when(~bad, v).alias(n) for n, v in shown.items()], F.when(bad, "#NUM!").alias("error"))


def trend(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], at: Sequence[float], const: bool = True, logarithmic: bool = False) -> DataFrame:
    """(by, value, error): TREND at the point ``at`` (a number per column of ``xs``); GROWTH with ``logarithmic``."""
    fit = linest(df, by, y, xs, const, logarithmic)
    value = F.col("intercept")
    for i, x in enumerate(at):
        value = value * F.pow(F.col("slopes")[i], F.lit(float(x))) if logarithmic else value + F.col("slopes")[i] * float(x)
    return fit.select(*by, value.alias("value"), "error")
