"""Grouped tables: GROUPBY, PIVOTBY, database functions, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.aggregates import AGGREGATES, criterion
from tabulon.functions.core import bad, guarded

from .rows import prefixed, settled


def group_by(df: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, str]], totals: bool = False) -> DataFrame:
    """GROUPBY: ``values`` maps a new name to (function, column). With ``totals`` a row of all, keys blank."""
    made = [AGGREGATES[f.upper()](F.col(c)).value.alias(n) for n, (f, c) in values.items()]
    out = df.groupBy(*keys).agg(*made)
    if totals:
        out = out.unionByName(df.agg(*made).select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], *values))
    return out


def _with_groups(rows: DataFrame, by: Sequence[str], totals: list[Column], few: int = 100_000) -> DataFrame:
    """``rows`` with their group's totals, which are broadcast if there are at most ``few`` groups."""
    groups = settled(rows.groupBy(*by).agg(*totals))
    named = groups.select(*[F.col(b).alias(f"_g{b}") for b in by], *[c for c in groups.columns if c not in by])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g{b}"))
    small = groups.limit(few + 1).count() <= few
    return rows.join(F.broadcast(named) if small else named, same, "left").drop(*[f"_g{b}" for b in by])


def _at(index: Column) -> Column:
    """The group's value at a place counted from 0 in ascending order; null outside the group."""
    return F.max(F.when((F.col("_lo") <= index) & (index < F.col("_hi")), F.col("_v")))


def _between(rank: Column) -> Column:
    """The value at a fractional place, counted from 0."""
    low = F.floor(rank)
    here, total = _at(low), F.max("_total")
    share = F.max(rank - low)
    return F.when(F.max(rank).between(0, total - 1), here + share * (F.coalesce(_at(low + 1), here) - here))


def _mean_within(cut: Column) -> Column:
    kept = F.greatest(F.least(F.col("_hi"), F.col("_total") - cut) - F.greatest(F.col("_lo"), cut), F.lit(0))
    return F.try_divide(F.sum(kept * F.col("_v")), F.sum(kept))


def _statistic(name: str, *args) -> Column:
    total, k = F.col("_total"), (float(args[0]) if args else 0.0)
    if name in ("QUARTILE", "QUARTILE.INC", "QUARTILE.EXC"):
        return _statistic("PERCENTILE.EXC" if name.endswith("EXC") else "PERCENTILE.INC", int(k) / 4)
    return {
        "LARGE": lambda: _at(total - int(k)),
        "SMALL": lambda: _at(F.lit(int(k) - 1)),
        "MEDIAN": lambda: _between((total - 1) * 0.5),
        "PERCENTILE": lambda: _between((total - 1) * k),
        "PERCENTILE.INC": lambda: _between((total - 1) * k),
        "PERCENTILE.EXC": lambda: _between((total + 1) * k - 1),
        "TRIMMEAN": lambda: _mean_within(F.floor(total * k / 2)),
        "MODE": lambda: F.when(F.max("_n") > 1, F.max_by("_v", F.struct("_n", -F.col("_v")))),
        "AVEDEV": lambda: F.try_divide(F.sum(F.col("_n") * F.abs(F.col("_v") - F.col("_sum") / total)), F.max(total)),
    }[name]()


def order_statistics(df: DataFrame, by: Sequence[str], value: str, statistics: dict[str, tuple]) -> DataFrame:
    """One row per group with LARGE, SMALL, MEDIAN, PERCENTILE (.INC, .EXC), QUARTILE (.INC, .EXC), TRIMMEAN, MODE and AVEDEV.

    ``statistics`` maps a new name to (function, argument); a result is blank where the worksheet has an error. Blanks
    and texts that are no numbers are skipped; a group without numbers has blanks only.

    Equal values are counted together before the shuffle, the counts are range-partitioned by group and value,
    and a value's place follows from the running count. No group is gathered, so one may hold most of the rows.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    taken = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).try_cast("double").alias("_v"))
    counts = taken.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_n", F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n")))
    placed = prefixed(counts, [*keys, "_v"], {"_upto": F.col("_n")})
    totals = [F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_total"), F.sum(F.col("_n") * F.col("_v")).alias("_sum")]
    placed = _with_groups(placed, keys, totals).withColumn("_hi", F.col("_upto") - F.col("_start")).withColumn("_lo", F.col("_hi") - F.col("_n"))
    out = placed.groupBy(*keys).agg(*[_statistic(f.upper(), *args).alias(f"_s{i}") for i, (f, *args) in enumerate(statistics.values())])
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[F.col(f"_s{i}").alias(n) for i, n in enumerate(statistics)])


def present_values(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, rate: float) -> DataFrame:
    """(by, npv): NPV of each group's numbers in their order. A flow's period is its place in the group, found by running counts, so no group is gathered."""
    keys = [f"_b{i}" for i in range(len(by))]
    flows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).try_cast("double").alias("_v"))
    placed = prefixed(flows, [*keys, *[f"_o{i}" for i in range(len(order))]], {"_upto": F.col("_v").isNotNull().cast("long")})
    one = F.col("_v").isNotNull().cast("long")
    placed = _with_groups(placed, keys, [F.min(F.col("_upto") - one).alias("_start")])
    npv = F.coalesce(F.sum(F.col("_v") / F.pow(F.lit(1.0 + rate), F.col("_upto") - F.col("_start"))), F.lit(0.0))
    return placed.groupBy(*keys).agg(npv.alias("npv")).select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "npv")


def pivot_by(df: DataFrame, rows: Sequence[str], column: str, function: str, value: str, headers: Sequence) -> DataFrame:
    """PIVOTBY: one column per header. Headers are given, so the plan has one aggregate and no scan to find them."""
    made = {h: AGGREGATES[function.upper()](F.when(F.col(column) == F.lit(h), F.col(value))).value for h in headers}
    return df.groupBy(*rows).agg(*[c.alias(str(h)) for h, c in made.items()])


def any_of(df: DataFrame, criteria: Sequence[dict]) -> DataFrame:
    """Rows that meet a criteria table: any of its rows, each a dict of column: criterion that must all hold."""
    names = {c.lower(): c for c in df.columns}
    met = F.lit(False)
    for row in criteria:
        one = F.lit(True)
        for c, rule in row.items():
            one = one & criterion(F.col(names[c.lower()]), rule)
        met = met | one
    return df.filter(met)


DATABASE = {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DVAR": "VAR.S", "DVARP": "VAR.P", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA"}


def database(name: str, df: DataFrame, field: str, criteria: Sequence[dict]) -> DataFrame:
    """A database function: one row with value and error."""
    kept = any_of(df, criteria)
    field = {c.lower(): c for c in df.columns}[field.lower()]
    if name.upper() == "DGET":
        n = F.count("*")
        c = guarded(F.first(field), bad((n == 0, "#VALUE!"), (n > 1, "#NUM!")))
    else:
        c = AGGREGATES[DATABASE[name.upper()]](F.col(field))
    return kept.agg(c.struct().alias("_c")).select("_c.*")


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """MMULT of tables (i, k, v) and (k, j, v): a join on k and a sum, so neither matrix has to fit anywhere."""
    left, right = a.select("i", "k", F.col("v").alias("va")), b.select("k", "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def munit(spark, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


LARGEST = 512


def determinants(df: DataFrame, key: str) -> DataFrame:
    """MDETERM of each matrix in (key, i, j, v), at most LARGEST wide: (key, determinant)."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame.i.max())
        if n > LARGEST:
            raise ValueError(f"matrices are at most {LARGEST} wide")
        m = np.zeros((n, n))
        m[frame.i.to_numpy() - 1, frame.j.to_numpy() - 1] = frame.v
        return pd.DataFrame({key: [frame[key].iloc[0]], "determinant": [float(np.linalg.det(m))]})

    return df.select(key, "i", "j", "v").groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, determinant double")


def inverses(df: DataFrame, key: str) -> DataFrame:
    """MINVERSE of each matrix in (key, i, j, v); a singular one has no rows."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame.i.max())
        if n > LARGEST:
            raise ValueError(f"matrices are at most {LARGEST} wide")
        m = np.zeros((n, n))
        m[frame.i.to_numpy() - 1, frame.j.to_numpy() - 1] = frame.v
        try:
            inv = np.linalg.inv(m)
        except np.linalg.LinAlgError:
            inv = np.empty((0, 0))
        i, j = np.indices(inv.shape)
        return pd.DataFrame({key: frame[key].iloc[0], "i": i.ravel() + 1, "j": j.ravel() + 1, "v": inv.ravel()})

    return df.select(key, "i", "j", "v").groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, i long, j long, v double")



def by_column(df: DataFrame, function: str) -> DataFrame:
    """BYCOL: one row with the aggregate of every column."""
    return df.agg(*[AGGREGATES[function.upper()](F.col(c)).value.alias(c) for c in df.columns])


def modes(df: DataFrame, value: str) -> DataFrame:
    """MODE.MULT: (value, n) of the commonest numbers, if any occurs twice."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), (F.col("n") == F.col("_most")) & (F.col("n") > 1)).select(value, "n")
