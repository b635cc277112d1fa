"""Language ID with interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

BLANK = 32
#: Characters of a text that are scored at a time.
PIECE = 1 << 18


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample. The model is fitted on at most ``rows`` training documents
    of each language and ``total`` of all (one of each language at least), of up to ``chars``
    characters each, and calibrated on as many others; all are chosen by a hash of their key. No
    language is left out. ``order``: longest n-gram."""

    rows: int = 1500
    total: int = 30_000
    chars: int = 20_000
    order: int = 4
    folds: int = 5
    reject: float = 0.5


def _char_table() -> np.ndarray:
    """Lower-case letter of each code point, BLANK where it isn't a letter or mark; marks have MARK added."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        if kind == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
        elif kind == "M":
            out[c] = c + MARK
    return out


MARK = 1 << 21
_CHARS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of a text: letters lower-cased, each run of others as one blank, blanks at both ends;
    marks stay where they are; empty without letters."""
    if not _CHARS:
        _CHARS.append(_char_table())
    x = _CHARS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not ((x != BLANK) & (x < MARK)).any():
        return x[:0]
    x &= np.uint32(MARK - 1)
    x = np.concatenate((np.array([BLANK], np.uint32), x, np.array([BLANK], np.uint32)))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != BLANK) | (x[:-1] != BLANK)
    return x[keep]


def _keys(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n-gram that ends at each place from n - 1 on."""
    out = np.full(max(len(x) - n + 1, 0), np.uint64(n), np.uint64)
    for i in range(n if len(out) else 0):
        out = (out ^ x[i : i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sample(docs: DataFrame, how: Training) -> DataFrame:
    """(lang, text, part) of the labelled sample: part 0 trains, part 1 calibrates.

    Rows are thinned by a hash threshold before they are numbered, so no task sees more than a
    few times the bound however large the table.
    """
    train = docs.filter("lang is not null and text is not null and length(text) <= " + str(how.chars) + " and pmod(crc32(cast(cast(key as string) as binary)), " + str(how.folds) + ") <> 0")
    sizes = durable(train.groupBy("lang").agg(F.count("*").alias("n")))
    rows = max(1, min(how.rows, how.total // max(1, sizes.count())))
    draw = F.xxhash64(F.lit("language sample"), F.col("key"))
    share = (draw.bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) * F.col("n") < 3.0 * rows
    drawn = train.join(F.broadcast(sizes), "lang").filter(share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "text"))
    picked = drawn.withColumn("place", place).filter(F.col("place") <= 2 * rows)
    return durable(picked.select("lang", "text", ((F.col("place") - 1) % 2).cast("int").alias("part")))


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, c): how often each n-gram of 1 to ``order`` characters occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                s = "".join(map(chr, letters(text).tolist()))
                for n in range(1, order + 1):
                    for g, c in Counter(s[i : i + n] for i in range(len(s) - n + 1)).items():
                        seen[lang, n, g] += c
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], ["lang", "n", "gram", "c"])

    return texts.mapInArrow(run, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> tuple[list[tuple[DataFrame, DataFrame]], int]:
    """Interpolated Kneser-Ney tables for n = 1 to ``order``: (lang, gram, tail, p), and the size of the alphabet.

    The longest n-grams count occurrences, the others the different characters before them.
    A discount n1 / (n1 + 2 n2) per language and length goes to the next shorter gram; the
    shortest interpolate with the uniform distribution over the alphabet, the characters seen in
    any language and one for all others. With each table comes (lang, head, total, d, gamma): what a
    context leaves to shorter grams.
    """
    counts = durable(counts)
    alphabet = counts.filter("n = 1").select("gram").distinct().count() + 1  # a number
    out, lower = [], None
    for n in range(1, order + 1):
        if n == order:
            c = counts.filter(F.col("n") == n).select("lang", "gram", "c")
        else:
            longer = counts.filter(F.col("n") == n + 1)
            c = longer.groupBy("lang", F.expr("substr(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        c = c.withColumn("head", F.expr(f"left(gram, {n - 1})")).withColumn("tail", F.expr("substr(gram, 2)"))
        d = c.groupBy("lang").agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("n2"))
        d = d.select("lang", F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5)).alias("d")).withColumn("d", F.least(F.greatest("d", F.lit(0.1)), F.lit(0.9)))
        context = c.groupBy("lang", "head").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        context = durable(context.join(F.broadcast(d), "lang").select("lang", "head", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma")))
        t = c.join(context, ["lang", "head"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if lower is None:
            t = t.select("lang", "gram", "tail", (own + F.col("gamma") / alphabet).alias("p"))
        else:
            t = t.join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q")), ["lang", "tail"], "left")
            t = t.select("lang", "gram", "tail", (own + F.col("gamma") * F.coalesce("q", F.lit(1.0 / alphabet))).alias("p"))
        lower = durable(t)
        out.append((lower, context))
    return out, alphabet


class Hashed:
    """A sorted array of 64-bit hashes, with one number per language for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys: the hashes in any order; values: hashes by languages."""
        order = np.argsort(keys)
        keys = keys[order]
        self.values = np.ascontiguousarray(values[order].T.astype(np.float32))
        self.starts = np.searchsorted(keys >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))  # where each value of the first 16 bits begins
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes ``q``, whether they are there)."""
        i = self.starts[(q >> np.uint64(48)).view(np.int64)]
        j = np.flatnonzero(self.keys[i] < q)
        while len(j):
            i[j] += 1
            j = j[self.keys[i[j]] < q[j]]
        return i, (self.keys[i] == q) & (i < len(self.keys) - 1)

    def total(self, i: np.ndarray) -> list[float]:
        """For each language the sum of the numbers at the places ``i``."""
        return [v.take(i).sum(dtype=np.float64) for v in self.values]


def _keys_of(grams: list[str], n: int) -> np.ndarray:
    return np.array([_keys(np.array(list(map(ord, g)), np.uint32), n)[0] for g in grams], np.uint64)


class Scorer:
    """The n-grams of all languages in sorted hash arrays, with their log probabilities, and their
    contexts with the log weights gamma at which what they leave goes to shorter grams."""

    def __init__(self, langs: list[str], grams: list[Hashed], contexts: list[Hashed], floor: np.ndarray):
        """grams and contexts for each length from 1 on; floor: each language's log probability of a character nobody saw."""
        self.langs, self.grams, self.contexts, self.floor = langs, grams, contexts, floor

    @classmethod
    def build(cls, levels: list[tuple[DataFrame, DataFrame]], alphabet: int) -> Scorer:
        """From the tables of ``kneser_ney``. Their size is bounded by the training sample's characters.

        For a gram that some language saw, the others' interpolated probability is what their
        contexts leave to shorter grams, so that one lookup gives all languages' values.
        """
        langs = sorted(r[0] for r in levels[0][0].select("lang").distinct().collect())
        place = {x: i for i, x in enumerate(langs)}
        below, grams, contexts = {}, [], []
        uniform = np.full(len(langs), 1.0 / alphabet)
        for n, (table, context) in enumerate(levels, 1):
            heads: dict[str, np.ndarray] = {}
            for lang, head, gamma in zip(*(c.to_pylist() for c in context.select("lang", "head", "gamma").toArrow().columns)):
                heads.setdefault(head, np.ones(len(langs)))[place[lang]] = gamma
            if n == 1:
                low = uniform * heads.get("", 1.0)
            now: dict[str, np.ndarray] = {}
            rows = table.select("lang", "gram", "p").toArrow()
            for g in dict.fromkeys(rows.column("gram").to_pylist()):
                shorter = below[g[1:]] if n > 1 else uniform
                now[g] = heads[g[:-1]] * shorter
            for lang, g, p in zip(*(c.to_pylist() for c in rows.columns)):
                now[g][place[lang]] = p
            stack = lambda d: np.log(np.array(list(d.values())).reshape(len(d), len(langs)))
            grams.append(Hashed(_keys_of(list(now), n), stack(now)))
            contexts.append(Hashed(_keys_of(list(heads), n - 1) if n > 1 else np.zeros(len(heads), np.uint64), stack(heads)))
            below = now
        return cls(langs, grams, contexts, np.log(low) if levels else np.zeros(0))

    def cross_entropy(self, x: np.ndarray) -> np.ndarray:
        """Nats per character of the letters ``x`` under each language, that of each character given those before it.

        Where no language saw the longest gram that ends at a character, each pays its context's gamma
        and the next shorter gram is looked up, down to the floor.
        """
        total = np.zeros(len(self.langs))
        top = len(self.grams)
        for at in range(1, len(x), PIECE):
            piece = x[max(0, at - top + 1) : at + PIECE]
            todo = np.arange(at - max(0, at - top + 1), len(piece))
            for n in range(top, 0, -1):
                if not len(todo):
                    break
                old, mine = (todo[todo < n - 1], todo[todo >= n - 1]) if todo[0] < n - 1 else (todo[:0], todo)
                i, met = self.grams[n - 1].find(_keys(piece, n)[mine - (n - 1)])
                total += self.grams[n - 1].total(i[met])
                mine = mine[~met]
                if n > 1 and len(mine):
                    i, met = self.contexts[n - 1].find(_keys(piece, n - 1)[mine - (n - 1)])
                    total += self.contexts[n - 1].total(i[met])
                todo = np.concatenate((old, mine))
            total += len(todo) * self.floor
        return -total / (len(x) - 1)


def _features(scorer: Scorer, text: str | None) -> tuple[int, float] | None:
    """(best language's place, margin to the second in nats per character times the root of the length)."""
    x = letters(text) if text else np.empty(0, np.uint32)
    if not len(x) or not scorer.langs:
        return None
    h = scorer.cross_entropy(x)
    order = np.argsort(h, kind="stable")
    best = int(order[0])
    margin = float(h[order[1]] - h[best]) if len(order) > 1 else 1.0
    return best, margin * float(np.sqrt(min(len(x), 10_000)))


def calibrated(margins: np.ndarray, right: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from margin to probability of being right, with smoothed targets."""
    if not len(margins):
        return 1.0, 0.0
    good, bad = right.sum(), len(right) - right.sum()
    y = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, np.array([(g * margins).sum() - 1e-3 * (a - 1), g.sum() - 1e-3 * b]))
        a, b = a + float(np.clip(move[0], -1, 1)), b + float(np.clip(move[1], -1, 1))
    return max(a, 0.0), b


def train(docs: DataFrame, how: Training) -> tuple[Scorer, float, float]:
    """The model of ``docs`` (key, text, lang), from its training folds only."""
    drawn = sample(docs, how)
    counts = gram_counts(drawn.filter("part = 0").select("lang", "text"), how.order)
    scorer = Scorer.build(*kneser_ney(counts, how.order))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            got = [(f[1], s.langs[f[0]] == lang) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) if (f := _features(s, t))]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in got], pa.float64()), pa.array([r for _, r in got], pa.bool_())], ["margin", "right"])

    seen = drawn.filter("part = 1").select("lang", "text").mapInArrow(run, "margin double, right boolean").toArrow()  # two numbers per sampled row
    slope, intercept = calibrated(seen.column("margin").to_numpy(), seen.column("right").to_numpy(zero_copy_only=False).astype(bool)) if seen.num_rows else (1.0, 0.0)
    return scorer, slope, intercept


def identify(docs: DataFrame, how: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score and rejected.

    Learns from rows with text and language whose crc32(key as text) mod folds isn't 0, within
    the bounds of ``Training``; held_out marks the others. lang_pred is the language of lowest
    cross-entropy per character, ties to the first by name; ``und`` with score 0 for null texts,
    texts without a letter and where nothing could be learned. score is the calibrated
    probability that lang_pred is right; below ``reject`` the row is marked rejected. A null key
    isn't held out, nor learned from. Whole texts are scored, in pieces; other columns are ignored.
    """
    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(slim, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, a, b0 = model.value
        for b in batches:
            pred, score = [], []
            for t in b.column("text"):
                f = _features(scorer, t.as_py())
                pred.append(scorer.langs[f[0]] if f else "und")
                score.append(float(1 / (1 + np.exp(-np.clip(a * f[1] + b0, -30, 30)))) if f else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([s < how.reject for s in score])], ["key", "held_out", "lang_pred", "score", "rejected"])

    held = F.coalesce(F.expr(f"pmod(crc32(cast(cast(key as string) as binary)), {how.folds}) = 0"), F.lit(False))
    out = slim.select("key", "text", held.alias("held_out")).mapInArrow(run, f"key {dict(slim.dtypes)['key']}, held_out boolean, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("key", key)
