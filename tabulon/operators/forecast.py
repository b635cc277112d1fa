"""FORECAST.ETS, .SEASONALITY, .CONFINT and .STAT over many series at once.

A series is aggregated, completed and fitted by joins and grouped regressions: one line per place in the season.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rows import settled

#: The numbers of the ways in which values of equal times are combined, the longest season that is looked for,
#: the longest that may be given, the share of gaps allowed, the smoothing weights reported, and the tolerances.
COMBINED = {0: F.avg, 1: F.avg, 2: F.count, 3: F.count, 4: F.max, 5: F.median, 6: F.min, 7: F.sum}
LONGEST, LARGEST, GAPS = 24, 8760, 0.30
ALPHA, BETA, GAMMA = 0.5, 0.1, 0.1
UNEVEN, BETTER, FLAT = 1e-7, 1e-9, 2.220446049250313e-16


def days(x: Column, kind: str) -> Column:
    """A time as a number: dates and timestamps in days."""
    if kind == "date":
        return F.unix_date(x).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(x.cast("timestamp")) / 86_400e6
    return x.try_cast("double")


def _completed(points: DataFrame, keys: Sequence[str], zeros: bool) -> DataFrame:
    """``points`` (keys, t, y, first, step) as (keys, i, y) without gaps: each missing value is midway between the one before it and the next known, or 0."""
    ahead = Window.partitionBy(*keys).orderBy("t")
    at = F.round((F.col("t") - F.col("first")) / F.col("step")).cast("long")
    known = points.select(*keys, "t", "y", at.alias("i")).withColumns({"to": F.lead("i").over(ahead), "right": F.lead("y").over(ahead)})
    gaps = known.select(*keys, "i", "y", "right", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("to") - F.col("i"), F.lit(1)) - 1)).alias("j"))
    filled = F.lit(0.0) if zeros else F.col("right") + (F.col("y") - F.col("right")) / F.pow(F.lit(2.0), F.col("j"))
    return gaps.select(*keys, (F.col("i") + F.col("j")).alias("i"), F.when(F.col("j") == 0, F.col("y")).otherwise(filled).alias("y"))


def forecast_ets(
    df: DataFrame, by: Sequence[str], time: str, value: str, at: float | datetime.date, seasonality: int = 1, completion: int = 1, aggregation: int = 0, confidence: float = 0.95
) -> DataFrame:
    """One row per group: forecast, confint, seasonality, alpha, beta, gamma, mase, smape, mae, rmse, step, error.

    ``at`` is the time that is forecast, at or after the last one, in steps from the first; a date if ``time`` holds dates.
    ``seasonality`` 1 looks for the season of least error up to 24, 0 has none. ``completion`` 0 fills gaps with zeros.
    Rows with a blank time or value are left out. ``error`` is #NUM! where a series has fewer than two times, uneven steps,
    too many gaps, too few values for the season, or ends after ``at``; the other columns are then blank.
    """
    if not 0 <= seasonality <= LARGEST or completion not in (0, 1) or aggregation not in COMBINED or not 0 < confidence < 1:
        raise ValueError("#NUM!")
    kinds, keys = dict(df.dtypes), [f"_b{i}" for i in range(len(by))]
    taken = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], days(F.col(time), kinds[time]).alias("t"), F.col(value).try_cast("double").alias("y"))
    points = settled(taken.filter("t is not null and y is not null").groupBy(*keys, "t").agg(COMBINED[aggregation]("y").cast("double").alias("y")))
    gap = points.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")))
    shape = gap.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min("gap").alias("step"), F.count("*").alias("known"))
    target = (at - datetime.date(1970, 1, 1)).days if isinstance(at, datetime.date) else at
    ahead = (F.lit(float(target)) - F.col("first")) / F.col("step")
    shape = shape.withColumns({"n": F.round((F.col("last") - F.col("first")) / F.col("step")).cast("long") + 1, "ahead": F.round(ahead).cast("long")})
    longest = F.floor(F.col("n") / 2)
    uneven = lambda x: F.abs(x - F.round(x)) > UNEVEN
    wrong = (F.col("n") - F.col("known") > GAPS * F.col("n")) | (F.lit(float(target)) < F.col("last")) | uneven(ahead) | uneven((F.col("last") - F.col("first")) / F.col("step"))
    wrong = F.coalesce(wrong | (F.lit(seasonality) > F.when(F.lit(seasonality > 1), longest).otherwise(seasonality)), F.lit(True))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]
    met = points.alias("p").join(shape.alias("s"), same("p", "s"))
    off = met.groupBy(*[F.col(f"s.{k}") for k in keys]).agg(F.max(uneven((F.col("t") - F.col("first")) / F.col("step"))).alias("off"))
    judged = shape.alias("s").join(off.alias("o"), same("s", "o")).select("s.*", (wrong | F.coalesce("off", F.lit(True))).alias("wrong"))
    judged = settled(judged)

    good = judged.filter(~F.col("wrong"))
    seasons = F.array(F.lit(max(seasonality, 1)).cast("long"))
    if seasonality == 1:
        seasons = F.sequence(F.lit(1).cast("long"), F.when(F.col("n") < 4, 1).otherwise(F.least(longest, F.lit(LONGEST))).cast("long"))
    series = _completed(points.alias("p").join(good.alias("s"), same("p", "s")).select("p.*", "first", "step"), keys, completion == 0)
    series = settled(series.alias("p").join(good.alias("s"), same("p", "s")).select("p.*", "n"))
    tried = series.withColumn("p", F.explode(seasons)).withColumn("k", F.col("i") % F.col("p"))
    x = F.col("i") + 1
    lines = tried.groupBy(*keys, "p", "k").agg(F.coalesce(F.regr_slope("y", x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("y", x), F.avg("y")).alias("intercept"))
    lines = settled(lines)
    fit = F.col("intercept") + F.col("slope") * x
    place = [*same("t", "l"), F.col("t.p") == F.col("l.p"), F.col("t.k") == F.col("l.k")]
    fitted = tried.alias("t").join(lines.alias("l"), place).select("t.*", "slope", fit.alias("fit"))
    miss, size = F.abs(F.col("y") - F.col("fit")), F.abs("y") + F.abs("fit")
    errors = fitted.groupBy(*keys, "p").agg(
        F.avg(miss).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.coalesce(F.avg(F.when(size != 0, 200 * miss / size)), F.lit(0.0)).alias("smape"), F.max(F.abs("slope") > FLAT).alias("trend")
    )
    # A longer season is taken only if it is better than the best shorter one; a series has 24 candidates at most.
    found = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "rmse", "mae", "smape", "trend"))).alias("all"))
    best = found.select(*keys, F.aggregate("all", F.col("all")[0], lambda a, b: F.when(b["rmse"] + BETTER < a["rmse"], b).otherwise(a)).alias("b")).select(*keys, "b.*")
    best = settled(best)

    mine = series.alias("t").join(best.alias("b"), same("t", "b")).select("t.*", "b.p")
    later = [*same("u", "v"), F.col("u.i") == F.col("v.i") + F.col("v.p")]
    scale = mine.alias("u").join(mine.alias("v"), later).groupBy(*[F.col(f"u.{k}") for k in keys]).agg(F.avg(F.abs(F.col("u.y") - F.col("v.y"))).alias("scale"))
    out = judged.alias("j").join(best.alias("b"), same("j", "b"), "left").select("j.*", "p", "rmse", "mae", "smape", "trend")
    out = out.alias("o").join(scale.alias("c"), same("o", "c"), "left").select("o.*", "scale")
    out = out.alias("o").join(lines.alias("l"), [*same("o", "l"), F.col("o.p") == F.col("l.p"), F.col("o.ahead") % F.col("o.p") == F.col("l.k")], "left").select("o.*", "slope", "intercept")
    horizon = F.greatest(F.col("ahead") - (F.col("n") - 1), F.lit(0))
    made = {
        "forecast": F.col("intercept") + F.col("slope") * (F.col("ahead") + 1),
        "confint": F.lit(NormalDist().inv_cdf(0.5 + confidence / 2)) * F.col("rmse") * F.sqrt(1 + horizon / F.col("n")),
        "seasonality": F.col("p").cast("double"),
        "alpha": F.lit(ALPHA),
        "beta": F.when(F.col("trend"), BETA).otherwise(0.0),
        "gamma": F.when(F.col("p") > 1, GAMMA).otherwise(0.0),
        "mase": F.when((F.col("scale") == 0) & (F.col("mae") == 0), 0.0).otherwise(F.try_divide("mae", "scale")),
        "smape": F.col("smape"),
        "mae": F.col("mae"),
        "rmse": F.col("rmse"),
        "step": F.col("step"),
    }
    shown = [F.when(~F.col("wrong"), v).alias(n) for n, v in made.items()]
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *shown, F.when(F.col("wrong"), "#NUM!").alias("error"))
