"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The session names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine stands in.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabulon-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bind(value: Column, body) -> Column:
    """``let x = value in body(x)``: evaluates ``value`` once per row.

    A lambda variable of a one-element ``transform`` holds the value, so ``body`` may
    mention it many times, inside other lambdas too, at the price of one evaluation.
    """
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str, *others: DataFrame) -> str:
    """A column name that no given frame has (names are matched without case)."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def place_of(df: DataFrame, name: str) -> int | None:
    """The place of a column among ``df``'s, matched as Spark does: exactly, else without case; None if there is none."""
    if name in df.columns:
        return df.columns.index(name)
    low = [c.lower() for c in df.columns]
    return low.index(name.lower()) if name.lower() in low else None


def joinable(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, made durable, with a broadcast hint if it has at most ``rows`` rows; beyond
    that it is left to a shuffled join, whose hot partitions adaptive execution splits.

    100,000 is meant for rows of up to a hundred bytes; rows of a few numbers may be a million.
    """
    kept = durable(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")
