import datetime

import pytest

from tabulon.operators.forecast import forecast_ets


def test_gaps_errors_and_dates(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("line", day(d), 2.0 * d) for d in (1, 2, 3, 5, 6)]
    rows += [("twice", day(1), 1.0), ("twice", day(1), 3.0), ("twice", day(2), 3.0), ("twice", day(3), 4.0)]
    rows += [("one", day(1), 1.0), ("sparse", day(1), 1.0), ("sparse", day(2), 1.0), ("sparse", day(9), 1.0), ("late", day(1), 1.0), ("late", day(31), 1.0)]
    rows += [(None, day(1), 5.0), (None, day(2), 5.0), (None, None, 5.0), (None, day(3), None)]
    got = {r.g: r for r in forecast_ets(spark.createDataFrame(rows, "g string, d date, v double"), ["g"], "d", "v", day(10), seasonality=0).collect()}
    assert got["line"].forecast == pytest.approx(20.0) and got["line"].step == 1 and got["line"].rmse == pytest.approx(0.0, abs=1e-9)
    assert got["twice"].forecast == pytest.approx(3.0 + 8.0) and got["twice"].beta == 0.1 and got["twice"].gamma == 0
    assert got[None].forecast == 5.0 and got[None].beta == 0 and got[None].mase == 0
    assert {g for g, r in got.items() if r.error == "#NUM!" and r.forecast is None} == {"one", "sparse", "late"}


def test_several_missing_values_go_halfway_each_and_empty_tables(spark):
    rows = [(float(t), 8.0 * (t >= 5)) for t in (0, 1, 2, 5, 6, 7)]
    df = spark.createDataFrame(rows, "t double, v double")
    ys = [0.0, 0.0, 0.0, 4.0, 6.0, 8.0, 8.0, 8.0]
    slope = sum((i - 3.5) * y for i, y in enumerate(ys)) / 42.0
    assert forecast_ets(df, [], "t", "v", 9.0, seasonality=0).first().forecast == pytest.approx(sum(ys) / 8 + slope * 5.5)
    zeros = [0.0, 0.0, 0.0, 0.0, 0.0, 8.0, 8.0, 8.0]
    slope = sum((i - 3.5) * y for i, y in enumerate(zeros)) / 42.0
    assert forecast_ets(df, [], "t", "v", 9.0, seasonality=0, completion=0).first().forecast == pytest.approx(3 + slope * 5.5)
    assert forecast_ets(df.withColumn("g", df.t).limit(0), ["g"], "t", "v", 9.0).count() == 0
    with pytest.raises(ValueError):
        forecast_ets(df, [], "t", "v", 9.0, completion=2)
