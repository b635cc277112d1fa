"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, durable, joinable, unused, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Signals of which more is worse, each between 0 and 1.
SIGNALS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "shout_ratio")


@dataclass(frozen=True)
class RiskPolicy:
    """``alpha``: the share of good documents that the thresholds of a stratum may reject, over
    all signals together. ``delta``: the probability that this fails anywhere, over all strata
    and signals. ``grid``: candidate cutoffs; a document is rejected above its cutoff."""

    alpha: float = 0.02
    delta: float = 0.05
    grid: tuple[float, ...] = field(default=(0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the word array ``w``, the first included.

    Windows are compared by a 64-bit hash. Sorted by hash, equal windows are neighbours; the
    starts of those are walked in order, and each adds the words that its predecessor doesn't
    cover. n log n in the length of a text.
    """

    def repeated(windows: Column) -> Column:
        def starts(s: Column) -> Column:
            alike = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, j: F.when(alike(x, j - 1) | alike(x, j + 1), x["i"])), lambda i: i.isNotNull())

        found = F.sort_array(bind(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts))
        none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        total = F.aggregate(found, none, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(0)

    def hashed(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))

    return bind(w, lambda v: F.when(F.size(v) >= 4, bind(hashed(v), repeated)).otherwise(0))


def counts(text: Column) -> Column:
    """Struct of the ``COUNTS`` of a text, longs; zero for null."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def over(w: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
            "n_dup_lines": bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": repeat_words(w),
            "n_lines": F.size(full),
            "n_shout": F.length(F.regexp_replace(t, r"[^A-Z!]+", "")),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return bind(words(text), over)


def signals(c: Column) -> list[Column]:
    """The ``SIGNALS`` of a struct of counts."""
    share = lambda a, b: F.when(c[b] > 0, F.least(c[a] / c[b], F.lit(1.0))).otherwise(0.0)
    pairs = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_shout", "word_chars"))
    return [share(*p).alias(s) for s, p in zip(SIGNALS, pairs)]


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    x = x.cast("double")
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact to rounding, for k <= n p; 1 beyond, where no test would pass.

    Terms are summed from the largest, k, downwards; after 10 standard deviations and 100 terms
    the rest is below 1e-20 of the sum.
    """
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.sequence(F.lit(0).cast("long"), F.least(k, (10 * F.sqrt(n * p) + 100).cast("long")))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, j: Column) -> Column:
        i = k - j
        return F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("term"))

    total = F.aggregate(terms, zero, step, lambda a: a["sum"])
    return F.when(k <= n * p, F.least(F.exp(first) * total, F.lit(1.0))).otherwise(1.0)


def thresholds(holdout: DataFrame, policy: RiskPolicy = RiskPolicy()) -> DataFrame:
    """Per stratum, the strictest cutoff of each signal that provably rejects few good documents.

    ``holdout`` has stratum, good (boolean) and the signals. For each stratum, signal and
    cutoff, the number of good documents above the cutoff tests "the false rejection rate
    exceeds alpha / signals" by its exact binomial tail. The cutoffs of one stratum and signal
    are tested from the loosest on until one fails (a fixed sequence), and the sequences share
    delta by Bonferroni, so with probability 1 - delta no stratum loses more than alpha of its
    good documents. Where nothing passes the cutoff is null: nothing is rejected.

    Counts cover the whole holdout, in one aggregate with map-side combine.
    """
    grid, rate = policy.grid, policy.alpha / len(SIGNALS)
    over = [F.sum(F.when(F.col("good") & (F.col(s) > c), 1).otherwise(0)).alias(f"{s}_{i}") for s in SIGNALS for i, c in enumerate(grid)]
    seen = holdout.groupBy("stratum").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("n"), *over)
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"{s}_{i}").alias("k")) for s in SIGNALS for i, c in enumerate(grid)])
    rows = seen.select("stratum", "n", F.explode(cells).alias("x")).select("stratum", "n", "x.*")
    strata = seen.agg(F.count("*").alias("strata"))
    rows = rows.crossJoin(F.broadcast(strata)).filter("n > 0")
    passed = F.when(binomial_tail(F.col("k"), F.col("n"), rate) <= F.lit(policy.delta / len(SIGNALS)) / F.col("strata"), 1).otherwise(0)
    order = Window.partitionBy("stratum", "signal").orderBy(F.desc("cutoff"))
    rows = rows.withColumn("passed", F.min(passed).over(order)).filter("passed = 1")
    return rows.groupBy("stratum").agg(*[F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"max_{s}") for s in SIGNALS])


def _measured(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    got = docs.select(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), counts(F.col(text)).alias("c"))
    return got.select("key", "stratum", "c")


def _learned(measured: DataFrame, labels: DataFrame, policy: RiskPolicy) -> DataFrame:
    """Thresholds of the labelled documents; a document with any label other than 1 isn't good."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    good = joinable(good, 1_000_000)
    held = measured.join(good, F.col("key") == F.col("doc_id")).select("stratum", "good", *signals(F.col("c")))
    return joinable(thresholds(held, policy))


def _kept(c: Column, limits: list[Column]) -> Column:
    above = F.lit(False)
    for s, limit in zip(signals(c), limits):
        above = above | F.coalesce(s > limit, F.lit(False))
    return ~base_failed(c) & ~above


def quality_verdicts(docs: DataFrame, labels: DataFrame, policy: RiskPolicy = RiskPolicy(), key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: key, the ``COUNTS``, base_failed and kept.

    ``labels`` has doc_id and quality (1 is good). Null texts have zero words and so fail the
    base rule; a null stratum is a stratum of its own; repeated rows are judged alike; without
    labels only the base rule rejects; an empty table gives no rows; other columns are ignored.
    """
    measured = durable(_measured(docs, key, text, stratum))
    found = _learned(measured, labels, policy)
    c = F.col("c")
    judged = measured.join(found, "stratum", "left")
    return judged.select(F.col("key").alias(key), *[c[n].alias(n) for n in COUNTS], base_failed(c).alias("base_failed"), _kept(c, [F.col(f"max_{s}") for s in SIGNALS]).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, policy: RiskPolicy = RiskPolicy(), key: str = "doc_id", text: str = "text", stratum: str = "lang", broadcast_keys: int = 1_000_000) -> DataFrame:
    """``docs``, all columns, without the rows that ``quality_verdicts`` rejects, among them those with null or empty texts.

    Repeated rows are judged alike, an empty table gives none, and columns keep their names whatever
    they are. The thresholds need the counts of the labelled documents only: up to ``broadcast_keys``
    labelled keys pick them out in the scan; beyond that the counts, not the texts, of all meet the labels.
    """
    keys = durable(labels.filter("doc_id is not null and quality is not null").select("doc_id").distinct())
    if keys.limit(broadcast_keys + 1).count() <= broadcast_keys:
        measured = _measured(docs.join(F.broadcast(keys.select(F.col("doc_id").alias(key))), key, "left_semi"), key, text, stratum)
    else:
        measured = _measured(docs, key, text, stratum)
    learned = _learned(measured, labels, policy)
    c, level = unused(docs, "counts", learned), unused(docs, "stratum", learned)
    limits = {s: unused(docs, f"max_{s}") for s in SIGNALS}
    found = learned.select(F.col("stratum").alias(level), *[F.col(f"max_{s}").alias(n) for s, n in limits.items()])
    whole = docs.select("*", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(level), counts(F.col(text)).alias(c)).filter(~base_failed(F.col(c)))
    return whole.join(found, level, "left").filter(_kept(F.col(c), [F.col(n) for n in limits.values()])).select(*docs.columns)
