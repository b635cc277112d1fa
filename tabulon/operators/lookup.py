"""Lookups as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.core import as_text
from tabulon.functions.text import wildcard

from .rows import NA, numbered, settled

#: A lookup table of at most so many rows is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 100_000


def folded(x: Column, kind: str) -> Column:
    return F.lower(x) if kind == "string" else x


def _first_hits(table: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """(_key, the columns) of the first (last) row of each key, by an aggregate."""
    pick = F.max_by if last else F.min_by
    kind = dict(table.dtypes)[key]
    return table.filter(F.col(key).isNotNull()).groupBy(folded(F.col(key), kind).alias("_key")).agg(pick(F.struct(*columns), F.struct(*order)).alias("_hit"))


def joined(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """A join whose right side is broadcast only if it is counted to be small."""
    right = settled(right)
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def exact(df: DataFrame, x: str, table: DataFrame, key: str, columns: dict[str, str], order: Sequence[str], if_not_found=None, last: bool = False) -> DataFrame:
    """VLOOKUP(..., FALSE), XLOOKUP and MATCH(..., 0): adds ``columns`` (new name: table column) of the first hit.

    Texts match without case. Misses are null, or ``if_not_found``; ``missing`` in the result
    columns is never an error code, which ``found`` tells: add it by naming a column "found".
    """
    hits = _first_hits(table, key, list(dict.fromkeys(columns.values())), order, last)
    met = joined(df, hits, folded(F.col(x), dict(df.dtypes)[x]) == F.col("_key"))
    values = [(F.col(f"_hit.{c}") if if_not_found is None else F.when(F.col("_key").isNull(), F.lit(if_not_found)).otherwise(F.col(f"_hit.{c}"))).alias(n) for n, c in columns.items()]
    return met.select(*df.columns, *values)


def shown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Result columns as texts, misses as #N/A."""
    return df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(as_text(F.col(c)), F.lit(NA)).alias(c) for c in columns])


def nearest(df: DataFrame, x: str, table: DataFrame, key: str, columns: dict[str, str], order: Sequence[str], mode: str = "last_smaller") -> DataFrame:
    """Approximate lookups, as-of joins included: adds ``columns`` of the row that each ``x`` finds.

    ``last_smaller``: MATCH(..., 1), VLOOKUP and LOOKUP: the last row in table order whose key
    isn't above x, sorted or not. ``last_larger``: MATCH(..., -1): the last whose key isn't
    below. ``next_smaller`` and ``next_larger``: XLOOKUP modes -1 and 1: the nearest key not
    above (below), its first row.

    Both sides are range-partitioned by key, each partition keeps the best row so far, and what
    the partitions before it found comes in as one row per partition. A random second sort key
    spreads a key that very many rows look up.
    """
    kinds = [dict(d.dtypes)[k] for d, k in ((df, x), (table, key))]
    numeric = [k.startswith("decimal") or k in ("tinyint", "smallint", "int", "bigint", "float", "double") for k in kinds]
    up = mode.endswith("larger")
    wanted = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    if kinds[0] != kinds[1] and not all(numeric):
        empty = table.limit(0).select(wanted.alias("_hit"))
        return df.select("*", *[F.lit(None).cast(empty.select(f"_hit.{n}").schema[0].dataType).alias(n) for n in columns])

    def comparable(value: Column) -> Column:
        """Texts without case; numbers of different types as doubles; all else as it is."""
        return folded(value, "string") if kinds[0] == "string" else value if kinds[0] == kinds[1] else value.cast("double")

    keyed = numbered(table.filter(F.col(key).isNotNull()), *order, name="_pos")
    right = keyed.select(comparable(F.col(key)).alias("_k"), F.lit(0).alias("_side"), "_pos", F.lit(0.0).alias("_salt"), wanted.alias("_hit"), F.lit(None).alias("_row"))
    rows = df.select(F.struct(*df.columns).alias("_row"), comparable(F.col(x)).alias("_k")).filter("_k is not null")
    left = rows.select("_k", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_pos"), F.rand(7).alias("_salt"), F.lit(None).alias("_hit"), "_row")
    sort = [F.col("_k").desc() if up else F.col("_k"), F.col("_side"), F.col("_pos").desc(), F.col("_salt")]
    both = right.unionByName(left).repartitionByRange(*sort).sortWithinPartitions(*sort)
    both = settled(both.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    # Of the keys read so far the best is the last in the table's order, or the latest, as keys come nearer.
    rank = F.col("_pos") if mode.startswith("last") else F.col("_at")
    both = both.withColumn("_best", F.when(F.col("_side") == 0, F.struct(rank.alias("rank"), F.col("_at").alias("at"), F.col("_hit").alias("hit"))))
    ends = both.groupBy("_part").agg(F.max_by("_best", F.struct("_best.rank", "_best.at")).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_part").alias("_p"), F.max_by("_end", F.struct("_end.rank", "_end.at")).over(before).alias("_carry"))  # one row per partition
    local = F.max_by("_best", F.struct("_best.rank", "_best.at")).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_now", local).filter("_side = 1").join(F.broadcast(carried), F.col("_part") == F.col("_p"))
    better = F.col("_carry.rank").isNotNull() & (F.col("_now.rank").isNull() | (F.col("_carry.rank") > F.col("_now.rank")))
    met = met.withColumn("_now", F.when(better, F.col("_carry")).otherwise(F.col("_now")))
    found = met.select("_row.*", *[F.col(f"_now.hit.{n}").alias(n) for n in columns])
    blank = df.filter(F.col(x).isNull())
    return found.unionByName(blank.select("*", *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in columns]))


def wild(df: DataFrame, x: str, table: DataFrame, key: str, columns: dict[str, str], order: Sequence[str], block: int = 10_000) -> DataFrame:
    """XLOOKUP mode 2: ``x`` is a pattern, the first key that it matches.

    Patterns without wildcards are looked up by equality. The others, different ones once, meet the table in
    blocks of about ``block``, each broadcast, whatever their number.
    """
    patterns = settled(df.select(F.col(x).alias("_pattern")).filter("_pattern is not null").distinct())
    pick, least = F.struct(*dict.fromkeys(columns.values())), F.struct(*order)
    plain = ~F.col("_pattern").rlike(r"[*?~]")
    literal = patterns.filter(plain).join(_first_hits(table, key, list(dict.fromkeys(columns.values())), order), F.lower("_pattern") == F.col("_key")).select("_pattern", "_hit")
    rest = patterns.filter(~plain)
    blocks = max(1, -(-rest.count() // block))
    hit = F.rlike(F.col(key), F.concat(F.lit("(?is)^(?:"), wildcard(F.col("_pattern")), F.lit(")$")))
    found = literal
    for i in range(blocks):
        some = rest.filter(F.pmod(F.xxhash64("_pattern"), F.lit(blocks)) == i)
        found = found.union(table.join(F.broadcast(some), hit).groupBy("_pattern").agg(F.min_by(pick, least).alias("_hit")))
    return joined(df, found, F.col(x) == F.col("_pattern")).select(*df.columns, *[F.col(f"_hit.{c}").alias(n) for n, c in columns.items()])


def existing(df: DataFrame, x: str, table: DataFrame, key: str, missing: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``x`` is a key of ``table`` (with ``missing``: is none), texts without case: a semi or anti join."""
    keys = table.filter(F.col(key).isNotNull()).select(folded(F.col(key), dict(table.dtypes)[key]).alias("_key")).distinct()
    return joined(df, keys, folded(F.col(x), dict(df.dtypes)[x]) == F.col("_key"), "left_anti" if missing else "left_semi")


def horizontal(df: DataFrame, x: str, table: DataFrame, row: int, name: str, *order) -> DataFrame:
    """HLOOKUP(..., FALSE): adds the value, as text, in row ``row`` (from 1) of the column of ``table`` whose name ``x`` is."""
    one = numbered(table, *order, name="_pos").filter(F.col("_pos") == row)
    cells = F.array(*[F.struct(F.lit(c.lower()).alias("_key"), as_text(F.col(c)).alias(name)) for c in table.columns])
    header = one.select(F.explode(cells).alias("x")).select("x.*")  # as many rows as the table has columns
    return df.join(F.broadcast(header), F.lower(x) == F.col("_key"), "left").drop("_key")


def match_position(df: DataFrame, x: str, table: DataFrame, key: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """MATCH(..., 0): the place of the first hit in the table's order."""
    return exact(df, x, numbered(table, *order, name="_pos"), key, {name: "_pos"}, ["_pos"])
