"""Array operators over ordered tables.

A table's order is a list of columns that the caller names. Row numbers, running totals and
ranks come from a range partitioning: each partition is numbered alone and offset by the
totals of those before it, so no step gathers a table in one task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.core import as_text

NA = "#N/A"
#: The texts of error cells.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", NA, "#SPILL!", "#CALC!")


class Calc(ValueError):
    """An array operator that has no result, with the error's code."""


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's checkpoint folder, so that later reads agree and survive lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabulon-"))
    return df.checkpoint(eager=True)


def name_for(df: DataFrame, stem: str) -> str:
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def as_keys(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def prefixed(df: DataFrame, order: Sequence, sums: dict[str, Column], strict: bool = False) -> DataFrame:
    """Adds running sums in the order of ``order``: up to each row, or with ``strict`` before it.

    Rows that tie in ``order`` are put in an arbitrary but fixed order; a random last key spreads them
    over partitions, however many tie.
    """
    part = name_for(df, "_part")
    sort = [*as_keys(order), F.rand(11)]
    values = {n: name_for(df, f"_v_{n}") for n in sums}
    dealt = df.select("*", *[c.alias(values[n]) for n, c in sums.items()])
    dealt = dealt.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(part, F.spark_partition_id()).withColumn(f"{part}n", F.monotonically_increasing_id())
    dealt = settled(dealt)
    totals = dealt.groupBy(part).agg(*[F.sum(values[n]).alias(f"{values[n]}t") for n in sums])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(F.col(part).alias(f"{part}o"), *[F.coalesce(F.sum(f"{values[n]}t").over(before), F.lit(0)).alias(f"{values[n]}o") for n in sums])
    local = Window.partitionBy(part).orderBy(f"{part}n").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    out = dealt.join(F.broadcast(offsets), F.col(part) == F.col(f"{part}o"))
    return out.select(*df.columns, *[(F.coalesce(F.sum(values[n]).over(local), F.lit(0)) + F.col(f"{values[n]}o")).alias(n) for n in sums])


def numbered(df: DataFrame, *order, name: str = "_row") -> DataFrame:
    """Adds dense row numbers from 1 in the order of ``order``."""
    return prefixed(df, order, {name: F.lit(1).cast("long")})


def running_total(df: DataFrame, order: Sequence, value: str, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """SCAN with a sum: the running total of a column, within groups if ``partition`` names any."""
    if partition:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*partition).orderBy(*as_keys(order)).rowsBetween(Window.unboundedPreceding, 0)))
    return prefixed(df, order, {name: F.col(value)})


def filtered(df: DataFrame, include: Column, if_empty: DataFrame | None = None) -> DataFrame:
    """FILTER: rows whose mask is true; blank is false, a text that is no logical #VALUE!. Nothing left gives ``if_empty``, whose schema is the same, or #CALC!."""
    if dict(df.select(include.alias("mask")).dtypes)["mask"] == "string":
        wrong = include.isNotNull() & include.try_cast("boolean").isNull()
        if not df.filter(wrong).isEmpty():
            raise Calc("#VALUE!")
    out = df.filter(F.coalesce(include.try_cast("boolean"), F.lit(False)))
    if if_empty is None:
        if out.isEmpty():
            raise Calc("#CALC!")
        return out
    return out.unionByName(if_empty.join(out.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def type_rank(x: Column) -> Column:
    """Blank, number, text, logical: the order of SORT."""
    return F.when(x.isNull(), 0).when(F.typeof(x) == "boolean", 3).when(F.typeof(x) == "string", 2).otherwise(1)


def sort_keys(x: Column, descending: bool = False) -> list[Column]:
    folded = F.when(F.typeof(x) == "string", F.lower(x.cast("string")))
    keys = [type_rank(x), folded, x]
    return [k.desc() if descending else k.asc() for k in keys]


def sorted_by(df: DataFrame, *by: tuple[str, int]) -> DataFrame:
    """SORT and SORTBY: (column, 1 or -1) pairs; texts without case; descending order reverses blanks too."""
    return df.orderBy(*[k for c, way in by for k in sort_keys(F.col(c), way < 0)])


def unique(df: DataFrame, columns: Sequence[str], order: Sequence[str] = (), exactly_once: bool = False) -> DataFrame:
    """UNIQUE: rows that differ without regard to case; of equal ones the first by ``order``.

    An aggregate with map-side combine; with ``exactly_once`` only rows that occur once.
    """
    fold = {c: F.lower(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in columns}
    keys = [v.alias(f"_u{i}") for i, v in enumerate(fold.values())]
    first = F.min_by(F.struct(*columns), F.struct(*(order or columns)))
    out = df.groupBy(*keys).agg(first.alias("_r"), F.count("*").alias("_n"))
    return (out.filter("_n = 1") if exactly_once else out).select("_r.*")


def taken(df: DataFrame, n: int, *order) -> DataFrame:
    """TAKE: the first ``n`` rows, or the last -n. A top-k: each partition keeps n rows. Fewer rows than that are #CALC!."""
    keys = as_keys(order)
    out = df.orderBy(*keys).limit(n) if n > 0 else df.orderBy(*[k.desc() for k in keys]).limit(-n)
    if n == 0 or out.count() < abs(n):
        raise Calc("#CALC!")
    return out


def dropped(df: DataFrame, n: int, *order) -> DataFrame:
    """DROP: without the first ``n`` rows, or the last -n. Nothing left is #CALC!."""
    rows = numbered(df, *(order if n >= 0 else [k.desc() for k in as_keys(order)]), name="_row")
    out = rows.filter(F.col("_row") > abs(n)).drop("_row")
    if out.isEmpty():
        raise Calc("#CALC!")
    return out


def chosen_columns(df: DataFrame, *indexes: int) -> DataFrame:
    """CHOOSECOLS: from 1, negative ones from the end; a repeated column gets a numbered name."""
    names, seen = [], {}
    for i in indexes:
        if i == 0 or abs(i) > len(df.columns):
            raise Calc("#VALUE!")
        c = df.columns[i - 1 if i > 0 else i]
        seen[c] = seen.get(c, 0) + 1
        names.append(F.col(c).alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*names)


def chosen_rows(df: DataFrame, indexes: Sequence[int], *order) -> DataFrame:
    """CHOOSEROWS: rows by number, from the end if negative, in the order asked for (column _at); repeats allowed."""
    rows = numbered(df, *order)
    total = rows.count() if any(i < 0 for i in indexes) else 0
    wanted = df.sparkSession.createDataFrame([(k, i if i > 0 else total + 1 + i) for k, i in enumerate(indexes, 1)], "_at long, _row long")
    return rows.join(F.broadcast(wanted), "_row").drop("_row")


def sequence(spark: SparkSession, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE: numbers row by row, as columns c1, c2 ... beside _row."""
    base = spark.range(1, rows + 1).withColumnRenamed("id", "_row")
    return base.select("_row", *[(F.lit(float(start)) + ((F.col("_row") - 1) * columns + c) * float(step)).alias(f"c{c + 1}") for c in range(columns)])


def random_array(spark: SparkSession, rows: int, columns: int = 1, low: float = 0, high: float = 1, whole: bool = False, seed: int | None = None) -> DataFrame:
    """RANDARRAY."""
    def draw(c):
        r = F.rand(None if seed is None else seed + c)
        return F.floor(r * (high - low + 1)).cast("double") + low if whole else r * (high - low) + low

    return spark.range(1, rows + 1).select(F.col("id").alias("_row"), *[draw(c).alias(f"c{c + 1}") for c in range(columns)])


def make_array(spark: SparkSession, rows: int, columns: int, f) -> DataFrame:
    """MAKEARRAY: f(row, column) as a table with _row."""
    return spark.range(1, rows + 1).select(F.col("id").alias("_row"), *[f(F.col("id"), F.lit(c)).alias(f"c{c}") for c in range(1, columns + 1)])


def expanded(df: DataFrame, rows: int, columns: int | None = None, pad=NA, *order) -> DataFrame:
    """EXPAND: padded to ``rows`` and ``columns``, as texts where the pad is one; keeps _row."""
    n = numbered(df, *order)
    base = df.sparkSession.range(1, rows + 1).withColumnRenamed("id", "_row")
    met = base.join(n.withColumn("_here", F.lit(True)), "_row", "left")
    show = [F.when(F.col("_here"), as_text(F.col(c))).otherwise(F.lit(str(pad))).alias(c) for c in df.columns]
    more = [F.lit(str(pad)).alias(f"pad{i}") for i in range(1, (columns or len(df.columns)) - len(df.columns) + 1)]
    return met.select("_row", *show, *more)


def hstacked(*tables: tuple[DataFrame, Sequence]) -> DataFrame:
    """HSTACK of (table, order) pairs, side by side on row numbers; shorter ones are padded with #N/A as texts."""
    parts = []
    for i, (df, order) in enumerate(tables):
        n = numbered(df, *order)
        parts.append(n.select("_row", *[as_text(F.col(c)).alias(c) for c in df.columns], F.lit(True).alias(f"_h{i}")))
    out = reduce(lambda a, b: a.join(b, "_row", "full_outer"), parts)
    names = [F.when(F.col(f"_h{i}"), F.col(c)).otherwise(F.lit(NA)).alias(c) for i, (df, _) in enumerate(tables) for c in df.columns]
    return out.select("_row", *names)


def vstacked(*tables: DataFrame) -> DataFrame:
    """VSTACK: by position, narrower ones padded with #N/A."""
    width = max(len(t.columns) for t in tables)
    names = next(t.columns for t in tables if len(t.columns) == width)
    parts = []
    for i, t in enumerate(tables):
        cells = [F.col(c).alias(n) for c, n in zip(t.columns, names)]
        parts.append(t.select(F.lit(i + 1).alias("_part"), *cells, *[F.lit(NA).alias(n) for n in names[len(t.columns) :]]))
    return reduce(lambda a, b: a.union(b), parts)


def to_column(df: DataFrame, order: Sequence, ignore: int = 0, by_column: bool = False) -> DataFrame:
    """TOCOL: all cells as (_row, _col, value) texts, with _at, their place; ignore 1 or 3 leaves blanks out, 2 or 3 errors."""
    n = numbered(df, *order)
    cells = F.array(*[F.struct(F.lit(i).alias("_col"), as_text(F.col(c)).alias("value")) for i, c in enumerate(df.columns, 1)])
    out = n.select("_row", F.explode(cells).alias("x")).select("_row", "x.*")
    if ignore in (1, 3):
        out = out.filter("value is not null")
    if ignore in (2, 3):
        out = out.filter(~F.coalesce(F.col("value").isin(*ERRORS), F.lit(False)))
    return numbered(out, *(("_col", "_row") if by_column else ("_row", "_col")), name="_at")


def wrapped_rows(df: DataFrame, value: str, order: Sequence, width: int, pad: str = NA) -> DataFrame:
    """WRAPROWS: a column cut into rows of ``width``; c1 ... and _row. An aggregate on the new row's number."""
    n = numbered(df.select(value, *[c for c in order if isinstance(c, str) and c != value]), *order)
    at = F.col("_row") - 1
    out = n.groupBy((F.floor(at / width) + 1).alias("_r")).agg(*[F.max(F.when(at % width == i, F.struct(as_text(F.col(value)).alias("v")))).alias(f"_s{i}") for i in range(width)])
    return out.select(F.col("_r").alias("_row"), *[F.when(F.col(f"_s{i}").isNull(), pad).otherwise(F.col(f"_s{i}.v")).alias(f"c{i + 1}") for i in range(width)])


def wrapped_columns(df: DataFrame, value: str, order: Sequence, height: int, pad: str = NA, widest: int = 16_384) -> DataFrame:
    """WRAPCOLS: a column cut into columns c1 ... of ``height`` rows, with _row. More than ``widest`` columns, a sheet's width, are #NUM!."""
    n = numbered(df.select(value, *[c for c in order if isinstance(c, str) and c != value]), *order)
    width = -(-n.count() // height)
    if width > widest:
        raise Calc("#NUM!")
    at = F.col("_row") - 1
    column = F.floor(at / height)
    out = n.groupBy((at % height + 1).alias("_r")).agg(*[F.max(F.when(column == i, F.struct(as_text(F.col(value)).alias("v")))).alias(f"_s{i}") for i in range(width)])
    return out.select(F.col("_r").alias("_row"), *[F.when(F.col(f"_s{i}").isNull(), pad).otherwise(F.col(f"_s{i}.v")).alias(f"c{i + 1}") for i in range(width)])


def to_row(df: DataFrame, order: Sequence, ignore: int = 0, by_column: bool = False, widest: int = 16_384) -> DataFrame:
    """TOROW: all cells as texts in one row c1 ...; more than ``widest``, a sheet's width, are #NUM!."""
    cells = to_column(df, order, ignore, by_column)
    n = cells.count()
    if n > widest:
        raise Calc("#NUM!")
    return cells.groupBy().agg(*[F.max(F.when(F.col("_at") == i, F.col("value"))).alias(f"c{i}") for i in range(1, n + 1)])


def shape(df: DataFrame) -> tuple[int, int]:
    """ROWS and COLUMNS of a table."""
    return df.count(), len(df.columns)


def transposed(df: DataFrame, key: str) -> DataFrame:
    """TRANSPOSE of a table whose key becomes the header: as many columns as it had rows."""
    return df.transpose(F.col(key))


def offset(df: DataFrame, column: str, rows: int, name: str, order: Sequence, partition: Sequence[str] = ()) -> DataFrame:
    """OFFSET of a cell: the value ``rows`` further on (back, if negative)."""
    if partition:
        return df.withColumn(name, F.lead(column, rows).over(Window.partitionBy(*partition).orderBy(*as_keys(order))) if rows >= 0 else F.lag(column, -rows).over(Window.partitionBy(*partition).orderBy(*as_keys(order))))
    n = settled(numbered(df, *order))
    other = n.select((F.col("_row") - rows).alias("_row"), F.col(column).alias(name))
    return n.join(other, "_row", "left").drop("_row")


def index(df: DataFrame, row: int, column: int, *order) -> DataFrame:
    """INDEX: one cell; row or column 0 takes all of them."""
    out = df if column == 0 else chosen_columns(df, column)
    if row == 0:
        return out
    n = numbered(df, *order).filter(F.col("_row") == row).drop("_row")
    return n if column == 0 else chosen_columns(n, column)


def filled_down(df: DataFrame, column: str, order: Sequence, partition: Sequence[str]) -> DataFrame:
    """Fill down: each blank takes the last value above it in its group."""
    w = Window.partitionBy(*partition).orderBy(*as_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def trimmed(df: DataFrame) -> DataFrame:
    """TRIMRANGE over columns: without leading and trailing columns that are blank throughout."""
    here = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    full = [i for i, c in enumerate(df.columns) if here[c]]
    return df.select(*df.columns[full[0] : full[-1] + 1]) if full else df.select()


# ---- ranks -----------------------------------------------------------------------------------
def ranked(df: DataFrame, value: str, ascending: bool = False, names: tuple[str, str] = ("rank_eq", "rank_avg")) -> DataFrame:
    """RANK.EQ and RANK.AVG of each row among all: counts of the different values, summed up in order."""
    values = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    sums = prefixed(values, [F.col(value).asc() if ascending else F.col(value).desc()], {"_before": F.col("_n")}, strict=True)
    ranks = sums.select(F.col(value).alias("_value"), (F.col("_before") + 1).cast("double").alias(names[0]), (F.col("_before") + 1 + (F.col("_n") - 1) / 2).alias(names[1]))
    return df.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")


def percent_ranked(df: DataFrame, value: str, digits: int = 3, inclusive: bool = True, name: str = "percentrank") -> DataFrame:
    """PERCENTRANK of each row's value, cut to ``digits`` digits."""
    values = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    total = values.agg(F.sum("_n").alias("_total"))
    sums = prefixed(values, [value], {"_before": F.col("_n")}, strict=True).crossJoin(F.broadcast(total))
    share = F.try_divide(F.col("_before"), F.col("_total") - 1) if inclusive else F.try_divide(F.col("_before") + 1, F.col("_total") + 1)
    ranks = sums.select(F.col(value).alias("_value"), (F.floor(share * 10.0**digits) / 10.0**digits).alias(name))
    return df.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")


def frequency(df: DataFrame, value: str, bins: Sequence[float]) -> DataFrame:
    """FREQUENCY: how many values lie above the bin before and not above each bin, and above the last: (bin, n)."""
    edges = sorted(float(b) for b in bins)
    place = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        place = F.when(F.col(value) <= edges[i], i).otherwise(place)
    counted = df.filter(F.col(value).isNotNull()).groupBy(place.alias("_bin")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(i, e) for i, e in enumerate([*edges, None])], "_bin int, bin double")
    return all_.join(counted, "_bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def dimensions(*areas: DataFrame) -> DataFrame:
    """ROWS, COLUMNS and AREAS of tables: (area, rows, columns), one row for each in the order given; AREAS is the number of rows of the result."""
    each = [a.agg(F.count("*").alias("rows")).select(F.lit(i).alias("area"), "rows", F.lit(len(a.columns)).cast("long").alias("columns")) for i, a in enumerate(areas, 1)]
    return reduce(DataFrame.union, each)


def addressed(df: DataFrame, order: Sequence, columns: Sequence[str], first: tuple[int, int] = (1, 1)) -> DataFrame:
    """ROW and COLUMN of each cell: (row, column, value as text) of ``columns`` in the order of ``order``, from the cell ``first`` on."""
    at = numbered(df, *order, name=name_for(df, "_row"))
    row = at.columns[-1]
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("column"), as_text(F.col(c)).alias("value")) for i, c in enumerate(columns, first[1])])
    return at.select((F.col(row) + (first[0] - 1)).alias("row"), F.explode(cells).alias("c")).select("row", "c.column", "c.value")
