"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, joinable, unused, words


def _split(prefix: str, groups: Mapping[str, range]) -> dict[str, str]:
    return {f"{prefix}{i}": d for d, r in groups.items() for i in r}


@dataclass(frozen=True)
class Mix:
    """The tree and its weights. ``domain_of`` maps sources to domains, others belong to
    ``rest``; weights are whole numbers relative to their siblings, ``default`` where a name
    isn't listed. ``share``: the budget as a share of the input's tokens, in thousandths.
    ``epochs``: how often a leaf may be repeated."""

    domain_of: Mapping[str, str] = field(default_factory=lambda: _split("src", {"web": range(0, 10), "reference": range(10, 16), "books": range(16, 19)}))
    rest: str = "other"
    domains: Mapping[str, int] = field(default_factory=lambda: {"web": 50, "reference": 30, "books": 15, "other": 5})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 60, "de": 15, "fr": 15, "es": 10})
    sources: Mapping[str, int] = field(default_factory=dict)
    default: int = 1
    share: int = 600
    epochs: int = 3
    seed: int = 20


LEAF = ("domain", "lang", "source")


def leaf_of(docs: DataFrame, mix: Mix, lang: str = "lang", source: str = "source") -> list[Column]:
    """Domain, language and source of a row; null ones are named '?'."""
    name = F.coalesce(F.col(source).cast("string"), F.lit("?"))
    domain = F.lit(mix.rest)
    for d in sorted(set(mix.domain_of.values())):
        domain = F.when(name.isin(*[s for s, x in mix.domain_of.items() if x == d]), d).otherwise(domain)
    return [domain.alias("domain"), F.coalesce(F.col(lang).cast("string"), F.lit("?")).alias("lang"), name.alias("source")]


def _weight(name: str, table: Mapping[str, int], default: int) -> Column:
    w = F.lit(default)
    for k, v in table.items():
        w = F.when(F.col(name) == k, v).otherwise(w)
    return w.cast("long")


def _filled(nodes: DataFrame, by: list[str], own: str) -> DataFrame:
    """Shares ``budget``, the same for all children of a parent (``by``), among them: to each its
    weight's part, none more than its ``cap``; what full children leave goes to their siblings.

    Sorted by cap / weight, a child is full if its cap is below its part of what the fuller
    ones left, and the first that isn't full sets the level of the rest.
    """
    order = Window.partitionBy(*by).orderBy(F.col("cap") / F.col("w"), own)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("budget") - before) / left
    found = nodes.filter("w > 0").withColumn("level", level)
    open_ = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col(own), F.col("level").alias("level")))).over(Window.partitionBy(*by))
    found = found.withColumn("open", open_["level"])
    part = F.when(F.col("cap") / F.col("w") <= F.col("level"), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("w") * F.col("open"))))
    return found.withColumn("part", F.greatest(part, F.lit(0)).cast("long")).drop("level", "open", "budget", "w")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds to ``leaves`` (domain, lang, source, tokens) the budget ``part`` of each.

    From the root down every node's budget, at most what its leaves can give in ``epochs``
    repeats, is shared among its children, so a shortage goes to siblings first, and what a
    whole subtree can't take goes to the siblings of its ancestors.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * mix.share / 1000).cast("long").alias("budget"))
    domain = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total)).withColumn("root", F.lit(0)).withColumn("w", _weight("domain", mix.domains, mix.default))
    top = durable(_filled(domain, ["root"], "domain").select("domain", F.col("part").alias("budget")))
    lang = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(top, "domain").withColumn("w", _weight("lang", mix.langs, mix.default))
    middle = durable(_filled(lang, ["domain"], "lang").select("domain", "lang", F.col("part").alias("budget")))
    low = caps.join(middle, ["domain", "lang"]).withColumn("w", _weight("source", mix.sources, mix.default))
    return _filled(low, ["domain", "lang"], "source").drop("cap")


def _draw(mix: Mix, epoch: Column, key: Column) -> Column:
    """A document's place in the order of an epoch: a seeded hash, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def plan_mix(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf of ``rows`` (key, domain, lang, source, n_tokens): budget, whole epochs and the last hash of the prefix.

    An epoch of a leaf is its documents in the order of a hash of seed, epoch and key. The
    budget is spent on whole epochs, then on the prefix of the next one that fits. The prefix
    is found without sorting a leaf: its rows are summed in buckets of the hash's first digits,
    as many as the square root of its rows, whose running sum shows the bucket in which the
    budget ends; only that bucket is sorted.
    """
    rows = rows.filter("n_tokens > 0")
    leaves = durable(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")))
    parts = budgets(leaves, mix)
    parts = parts.withColumn("epochs", F.floor(F.col("part") / F.col("tokens")).cast("long"))
    parts = parts.withColumn("rest", F.col("part") - F.col("epochs") * F.col("tokens")).withColumn("digits", F.greatest(F.lit(1), F.ceil(F.log(F.col("n_rows")) / F.log(F.lit(256.0)))).cast("int"))
    parts = joinable(parts)
    hashed = rows.join(parts.filter("rest > 0"), list(LEAF)).withColumn("h", _draw(mix, F.col("epochs"), F.col("key"))).withColumn("bucket", F.col("h").substr(F.lit(1), F.col("digits")))
    sums = hashed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    running = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    ends = sums.withColumn("sum", running).filter("sum > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("sum") - F.col("t")).alias("before"))).alias("x"))
    ends = joinable(ends.select(*LEAF, F.col("x.bucket").alias("end"), F.col("x.before").alias("before")))
    last = hashed.join(ends, list(LEAF)).filter("bucket = end")
    inside = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("inside", inside).filter("inside <= rest").groupBy(*LEAF).agg(F.max("h").alias("last"))
    cuts = parts.join(ends, list(LEAF), "left").join(last, list(LEAF), "left")
    # The prefix ends at the last hash that fits, or before the whole bucket if none of it does.
    cut = F.when(F.col("rest") > 0, F.coalesce("last", "end"))
    return cuts.select(*LEAF, "tokens", "part", "epochs", cut.alias("cut"))


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", narrow: bool = False) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``, how often each is taken.

    With ``narrow``: key, domain, lang, source, n_tokens and copies only. Tokens are words
    ``[^\\x20\\x09-\\x0D]+``; documents without any, null texts among them, are never taken. Null
    languages and sources are leaves named '?'; rows that repeat a key are taken together;
    rows with a null key are ordered as one; an empty table gives none.
    """
    t = F.size(words(F.col(text))).cast("long")
    rows = durable(docs.select(F.col(key).alias("key"), *leaf_of(docs, mix, lang, source), t.alias("n_tokens")))
    plan = joinable(plan_mix(rows, mix))
    if narrow:
        whole, names = rows, {n: n for n in (*LEAF, "key", "n_tokens")}
    else:
        names = {n: unused(docs, n) for n in (*LEAF, "n_tokens")} | {"key": key}
        whole = docs.select("*", *[c.alias(names[n]) for c, n in zip(leaf_of(docs, mix, lang, source), LEAF)], t.alias(names["n_tokens"])).filter(F.col(names["n_tokens"]) > 0)
    plan = plan.select(*[F.col(n).alias(f"_of_{n}") for n in LEAF], F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"))
    on = [F.col(names[n]) == F.col(f"_of_{n}") for n in LEAF]
    drawn = _draw(mix, F.col("_epochs"), F.col(names["key"])) <= F.col("_cut")
    copies = F.when(F.col(names["n_tokens"]) > 0, F.col("_epochs") + F.coalesce(drawn, F.lit(False)).cast("long")).otherwise(0)
    kept = whole.join(plan, on).withColumn("copies", copies).filter("copies > 0")
    if narrow:
        return kept.select(F.col("key").alias(key), *LEAF, "n_tokens", "copies")
    return kept.select(*docs.columns, "copies")
