import numpy as np
import pytest

from tabulon.operators.grouping import order_statistics, present_values
from tabulon.operators.regression import linest, trend


def test_several_columns_against_least_squares(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(60, 3)) + 1e4
    y = a @ [2.0, -1.0, 0.5] + 7 + rng.normal(size=60)
    rows = [("g", *map(float, x), float(v)) for x, v in zip(a, y)] + [("flat", 1.0, 2.0, float(i), float(i)) for i in range(9)] + [("few", 1.0, 2.0, 3.0, 4.0), ("few", None, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    got = {r.g: r for r in linest(df, ["g"], "y", ["a", "b", "c"]).collect()}
    want, left, *_ = np.linalg.lstsq(np.column_stack([a - 1e4, np.ones(60)]), y, rcond=None)
    assert got["g"].slopes == pytest.approx(want[:3].tolist(), rel=1e-6) and got["g"].df == 56
    assert got["g"].se_y == pytest.approx(float(np.sqrt(left[0] / 56)), rel=1e-6)
    assert got["flat"].error == got["few"].error == "#NUM!" and got["flat"].slopes is None
    at = {r.g: r for r in trend(df, ["g"], "y", ["a", "b", "c"], [1e4, 1e4, 1e4]).collect()}
    assert at["g"].value == pytest.approx(float(want[3]), rel=1e-9) and at["few"].value is None
    through, *_ = np.linalg.lstsq(a, y, rcond=None)
    none = linest(df.filter("g = 'g'"), ["g"], "y", ["a", "b", "c"], const=False).first()
    assert none.slopes == pytest.approx(through.tolist(), rel=1e-5) and none.intercept == 0


def test_exponential_curve_and_its_errors(spark):
    rows = [("g", float(i), float(i * i), 3.0 * 2.0**i * 0.9 ** (i * i)) for i in range(6)] + [("neg", float(i), float(i * i), float(i) - 2) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    got = {r.g: r for r in linest(df, ["g"], "y", ["a", "b"], logarithmic=True).collect()}
    assert got["g"].slopes == pytest.approx([2.0, 0.9]) and got["g"].intercept == pytest.approx(3.0) and got["neg"].error == "#NUM!"
    at = {r.g: r.value for r in trend(df, ["g"], "y", ["a", "b"], [2, 4], logarithmic=True).collect()}
    assert at["g"] == pytest.approx(3 * 4 * 0.9**4) and at["neg"] is None


def test_order_statistics_with_blanks_ties_and_null_groups(spark):
    rows = [("a", v) for v in (5.0, 1.0, 1.0, None, 3.0, 5.0, 5.0)] + [(None, 2.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"large": ("LARGE", 3), "fourth": ("LARGE", 4), "small": ("SMALL", 7), "mid": ("MEDIAN",), "q": ("PERCENTILE.EXC", 0.9), "mode": ("MODE",), "dev": ("AVEDEV",), "trim": ("TRIMMEAN", 0.4)}
    got = {r.g: r for r in order_statistics(df, ["g"], "v", wanted).collect()}
    assert (got["a"].large, got["a"].fourth, got["a"].small, got["a"].mid, got["a"].q, got["a"].mode) == (5.0, 3.0, None, 4.0, None, 5.0)
    assert got["a"].dev == pytest.approx(10 / 6) and got["a"].trim == pytest.approx(3.5)
    assert got[None].mid == 3.0 and got[None].mode is None and got[None].q is None
    assert set(got) == {"a", None, "none"} and not any(got["none"][k] is not None for k in wanted)
    whole = order_statistics(df, [], "v", {"small": ("SMALL", 2), "large": ("LARGE", 1)}).first()
    assert (whole.small, whole.large) == (1.0, 5.0)
    assert order_statistics(df.limit(0), ["g"], "v", wanted).count() == 0


def test_present_values_skip_blanks(spark):
    df = spark.createDataFrame([("a", 1, 110.0), ("a", 2, None), ("a", 3, 121.0), (None, 1, 11.0), ("none", 1, None)], "g string, o int, v double")
    got = {r.g: r.npv for r in present_values(df, ["g"], ["o"], "v", 0.1).collect()}
    assert got["a"] == pytest.approx(200.0) and got[None] == pytest.approx(10.0) and got["none"] == 0
