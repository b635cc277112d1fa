"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, joinable, unused

#: Words of a window, of a hashed k-gram, and k-grams of a winnow: K + W - 1 = SPAN, so any
#: SPAN shared words share a whole winnow and with it its least k-gram.
SPAN, K = 10, 5
W = SPAN - K + 1
#: Slots of each of the two filters of benchmark hashes that go to every task: 512 KB, whatever the benchmark's size.
SLOTS = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+")
_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_P, _PINV))
        return self.up, self.down


_POWERS = Powers()


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, and no other letters."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_spans(raw: bytes, of_words: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words, runs of bytes that ``of_words`` marks, begin and end."""
    inside = of_words[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, as differences of one running sum."""
    up, down = _POWERS.upto(len(raw) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out * _P + h[i : i + n])
    return out


def winnow(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the least hash of each run of ``w`` k-grams, the last of equal ones; sorted, once each."""
    if len(grams) < w:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(len(runs)) + (w - 1) - runs.argmin(axis=1))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the benchmark's items: (item, len, hash, seeds, window): an item of fewer than SPAN words is one window.

    seeds: the hashes of the k-grams that winnowing keeps of the window; a short window has none.
    """
    for b in batches:
        out: dict[str, list] = {"item": [], "len": [], "hash": [], "seeds": [], "window": []}
        for item, text in zip(b.column("item"), b.column("text")):
            raw = lowered(text.as_py())
            starts, ends = word_spans(raw)
            if not len(starts):
                continue
            h, words, n = word_hashes(raw, starts, ends), _TOKENS.findall(raw), min(len(starts), SPAN)
            grams = gram_hashes(h, K)
            for i, whole in enumerate(_signed(gram_hashes(h, n)).tolist()):
                seeds = _signed(grams[i + winnow(grams[i : i + W])]).tolist() if n == SPAN else []
                for k, v in zip(out, (item.as_py(), n, whole, seeds, b" ".join(words[i : i + n]))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["item"], b.schema.field("item").type), pa.array(out["len"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["seeds"], pa.list_(pa.int64())), pa.array(out["window"], pa.binary())], list(out))


def _windows(seeds: bytes, hashes: bytes, short: list[int]):
    """Task code: of each document its number of words and its windows that may be the benchmark's.

    A kept k-gram that passes the filter of seeds is extended to the windows that hold it; those
    that pass the filter of whole windows go on, with their words.
    """
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("window", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded, there = (np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in (seeds, hashes))
        mask = np.uint64(SLOTS - 1)
        for b in batches:
            sizes, found = [], []
            for text in b.column("text"):
                raw = lowered(text.as_py())
                starts, ends = word_spans(raw)
                n, mine = len(starts), []
                sizes.append(n)
                found.append(mine)
                h = word_hashes(raw, starts, ends) if n else None

                def add(whole: np.ndarray, at: np.ndarray, size: int) -> None:
                    at = at[there[whole[at] & mask]]
                    for i, x in zip(at.tolist(), _signed(whole[at]).tolist()):
                        mine.append({"hash": x, "start": i, "len": size, "window": b" ".join(_TOKENS.findall(raw[starts[i] : ends[i + size - 1]]))})

                for size in short:
                    if n >= size:
                        add(gram_hashes(h, size), np.arange(n - size + 1), size)
                if n >= SPAN:
                    grams = gram_hashes(h, K)
                    at = winnow(grams)
                    at = at[seeded[grams[at] & mask]]
                    if len(at):
                        around = np.unique(at[:, None] - np.arange(W))
                        add(gram_hashes(h, SPAN), around[(around >= 0) & (around <= n - SPAN)], SPAN)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int64()), pa.array(found, kind)], ["key", "n_words", "windows"])

    return run


def _slots(hashes: DataFrame) -> bytes:
    """A bit for each slot that a value of the column ``hash`` falls into; at most SLOTS numbers reach the driver."""
    out = np.zeros(SLOTS, bool)
    out[hashes.select(F.col("hash").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(out).tobytes()


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (the item ids with occurring windows, sorted as strings).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is SPAN
    consecutive words of an item, or a whole item of fewer; a word of a document inside any
    occurrence of a window is hit. Null texts have no words; items without words have no
    windows; null item ids are ignored; repeated rows of either table are fine; empty tables
    are fine; other columns are ignored.

    Both sides keep the least of each W k-gram hashes, so a shared window shares a seed. Filters of
    fixed size drop the documents' seeds, and then the windows around them, that no item has; the rest
    meet the different windows of the benchmark in a join on the hash and the words, so that rows
    are real matches: a phrase that many windows share doesn't multiply.
    """
    bench = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter("item is not null")
    kind = dict(bench.dtypes)["item"]
    owned = durable(bench.mapInArrow(_items, f"item {kind}, len int, hash long, seeds array<long>, window binary"))
    windows = durable(owned.select("hash", "len", "window").distinct().withColumn("wid", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in windows.filter(F.col("len") < SPAN).select("len").distinct().collect())  # at most SPAN - 1 values
    filters = _slots(owned.select(F.explode("seeds").alias("hash"))), _slots(windows)

    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    inner = "array<struct<hash:long,start:int,len:int,window:binary>>"
    scanned = slim.mapInArrow(_windows(*filters, short), f"key {dict(slim.dtypes)['key']}, n_words long, windows {inner}")
    scanned = durable(scanned.withColumn("row", F.monotonically_increasing_id()))
    met = scanned.filter(F.size("windows") > 0).select("row", F.explode("windows").alias("x")).select("row", "x.hash", "x.start", "x.len", "x.window")
    matches = durable(met.join(joinable(windows.drop("len")), ["hash", "window"]).select("row", "wid", "start", "len"))
    # Sorted intervals [start, end) are walked once; each adds what its predecessors don't cover.
    none = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"))
    cover = F.aggregate(F.array_sort("spans"), none, step, lambda a: a["n"])
    hits = matches.groupBy("row").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("spans")).select("row", cover.alias("n_hit"))
    owners = owned.join(windows, ["hash", "window"]).select("wid", "item").distinct()
    items = matches.select("row", "wid").distinct().join(owners, "wid").groupBy("row").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    found = joinable(hits.join(items, "row"))
    whole = scanned.select("row", "key", "n_words").join(found, "row", "left")
    return whole.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_contamination`` with the items as a count and a SHA-256 of their list."""
    found = find_contamination(docs, benchmark, **options)
    key = options.get("key", "doc_id")
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """``docs``, all columns, without the documents of which more than ``max_share`` of the words are hit.

    Null texts stay, repeated rows are judged alike, an empty table of documents gives none, an empty
    benchmark drops none. Rows are told apart by a 128-bit hash of key and text; those of the
    dropped ones go to all tasks while they are at most a million (16 bytes each), and are joined by a shuffle beyond.
    """
    a, b = unused(docs, "high"), unused(docs, "low")
    row = (F.col(key).cast("string"), F.col(text))
    marked = docs.select("*", F.xxhash64(F.lit("high"), *row).alias(a), F.xxhash64(F.lit("low"), *row).alias(b))
    k = unused(marked, "identity")
    found = find_contamination(marked.select(F.struct(a, b).alias(k), F.col(text)), benchmark, key=k, text=text, **options)
    bad = joinable(found.filter((F.col("n_hit") > 0) & (F.col("n_hit") > max_share * F.col("n_words"))).select(f"{k}.*").distinct(), 1_000_000)
    return marked.join(bad, [a, b], "left_anti").select(*docs.columns)
