"""Registered queries over the driver's tables and, for each that SQL can express, the SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.core import Cell
from tabulon.operators.rows import settled

from .lazy import resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: HotSpot interprets a method of more bytecode, ten times slower or worse.
METHOD_BYTES, METHOD_LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if its files make fewer: for computing that outweighs a shuffle of a
    small table. A table of many splits is left as it is. Many columns make one method of a stage; sets the session's limit
    for it, if it has none of its own, to what HotSpot compiles, beyond which Spark computes them in several methods."""
    if df.sparkSession.conf.get(METHOD_LIMIT, None) is None:
        df.sparkSession.conf.set(METHOD_LIMIT, METHOD_BYTES)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: At most so many different inputs are computed apart from the rows, and broadcast.
DIFFERENT_INPUTS = 100_000


def computed(df: DataFrame, key: list[str], inputs: dict[str, Column], made: list[Column]) -> DataFrame:
    """``key`` and ``made`` of every row, where ``made`` mentions ``inputs`` only, by their names.

    Inputs that repeat eight times or more, on average, are computed once each and joined back, nulls too; others row by
    row. Of 0.0 and -0.0, which a join can't tell apart, the first stands for both.
    """
    given = df.select(*[F.col(k).alias(f"_key_{k}") for k in key], *[x.alias(n) for n, x in inputs.items()])
    keys = [F.col(f"_key_{k}").alias(k) for k in key]
    seen = given.agg(F.approx_count_distinct(F.xxhash64(*inputs)).alias("different"), F.count(F.lit(1)).alias("rows")).first()
    if seen["different"] > DIFFERENT_INPUTS or seen["different"] * 8 > seen["rows"]:
        return spread(given).select(*keys, *made)
    # Written first: a plan without shuffles isn't optimized again, with all these expressions, after each of its stages.
    different = settled(given.select(*inputs).distinct().repartition(df.sparkSession.sparkContext.defaultParallelism, *inputs))
    results = settled(different.select(*[F.col(n).alias(f"_of_{n}") for n in inputs], *made))
    names = results.columns[len(inputs):]
    results = results.toDF(*results.columns[:len(inputs)], *[f"_made_{i}" for i in range(len(names))])
    met = given.join(F.broadcast(results), reduce(and_, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in inputs]), "left")
    return met.select(*keys, *[F.col(f"_made_{i}").alias(n) for i, n in enumerate(names)])


def query(sql: str | None = None, name: str | None = None):
    """Registers f(t), where t(name) reads a table, under its own name."""

    def decorate(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[key] = sql
        return f

    return decorate


def r(x: Column | Cell, digits: int = 6) -> Column:
    """Rounded the same way as ``rsql`` does in SQL, so that last-bit differences between engines vanish.
    Columns beyond 2^53 units keep their value, as in SQL: Spark's floor is a long, which ends at 9.2e18. Functions' cells, which are smaller, are mentioned once."""
    v = (x.value if isinstance(x, Cell) else x).cast("double")
    if not isinstance(x, Cell):
        w = v * 10.0**digits + 0.5
        return F.when(F.abs(w) < 2.0**53, F.floor(w).cast("double")).otherwise(w) / 10.0**digits
    return F.floor(v * 10.0**digits + 0.5).cast("double") / 10.0**digits


def rsql(x: str, digits: int = 6) -> str:
    return f"(floor(({x})::double * {10.0**digits} + 0.5)::double / {10.0**digits})"


def scalars(name: str, source: str, key: list[str], items: dict, over: dict | None = None, apart: list[tuple[dict, str]] | None = None) -> None:
    """A query of one column per function. ``items``: name: (deferred cell, SQL), "v:name" for what isn't a number. Numbers are rounded; texts are shown as they are.
    ``over``: the columns that the cells mention, each with its value in a row, where these repeat: see ``computed``.
    ``apart``: (such columns, the names of the items over them) where items repeat by different inputs; the others are computed row by row."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = {n: (kind, resolve(x)) for n, (kind, x, _) in parsed.items()}
        made = [(r(x) if kind == "n" else x.shown() if isinstance(x, Cell) else x).alias(n) for n, (kind, x) in cells.items()]
        if apart:
            df, done = spread(table(spark, sf_dir, source)), []
            for inputs, names in apart:
                some = [m for n, m in zip(cells, made) if n in names.split()]
                df = computed(df, df.columns, {n: resolve(x) for n, x in inputs.items()}, some)
                done += names.split()
            return df.select(*key, *[F.col(n) if n in done else m for n, m in zip(cells, made)])
        if over:
            return computed(table(spark, sf_dir, source), key, {n: resolve(x) for n, x in over.items()}, made)
        return spread(table(spark, sf_dir, source)).select(*key, *made)

    parsed = {}
    for n, (c, sql) in items.items():
        kind, _, n = n.rpartition(":")
        parsed[n] = (kind or "n", c, sql)
    QUERIES[name] = build
    made = ", ".join(f"{rsql(sql) if kind == 'n' else f'({sql})'} AS {n}" for n, (kind, _, sql) in parsed.items())
    ORACLES[name] = f"SELECT {', '.join([*key, made])} FROM {source}"


def grouped(name: str, source: str, by: list[str], items: dict, digits: int = 4) -> None:
    """A query of one aggregate per column, per group."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, source).groupBy(*by).agg(*[resolve(x).alias(n) for n, (x, _) in items.items()])
        return made.select(*by, *[r(F.col(n), digits).alias(n) for n in items])

    QUERIES[name] = build
    ORACLES[name] = f"SELECT {', '.join(by)}, {', '.join(f'{rsql(s, digits)} AS {n}' for n, (_, s) in items.items())} FROM {source} GROUP BY {', '.join(by)}"


flagship = "groupby_flag_status"

from . import catalog, closed_forms, tables  # noqa: E402, F401
