"""SimHash near-duplicates through multi-index hashing."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joinable, unused
from .components import connected_components
from .decontaminate import gram_hashes, lowered, mix, word_hashes, word_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PIECE = 1 << 16  # shingles that are turned into bits at a time


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64.

    Shingles are ``size`` words, repeats included; fewer words make one shingle. Null,
    empty and blank texts give 0.
    """
    if not text:
        return 0
    words = _WORD.findall(text.translate(LOWER).encode("utf-8", "surrogatepass"))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()))
    for at in range(0, n, _PIECE):
        piece = np.array([digest(joined[s:e], 42) for s, e in spans[at : at + _PIECE]], ">u8")
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > n else "0" for c in counts.tolist()), 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = 3) -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a long in ``out``; one row per row."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept).schema.add(out, "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_signed(fingerprint(t.as_py(), size)) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [found], [*kept, out])

    return docs.select(*kept, text).mapInArrow(scan, schema)


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of ``m`` segments that make up 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` set bits among ``width``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def links(fps: DataFrame, distance: int = 3, segments: int = 2, dense: int = 2048) -> DataFrame:
    """Links (u, v) whose closure joins every two values of ``fps`` within ``distance`` bits.

    ``fps`` has one long column ``fp`` of different values. Two values within ``distance``
    agree in one of ``segments`` segments up to distance // segments bits, so each value
    probes the table of each segment with the Hamming ball around its own segment; what is
    fetched is verified over all 64 bits.

    A bucket of more than ``dense`` values (a group of very many almost equal documents)
    would fetch the square of its size. Its values, and the values that probe it, are
    joined through shared neighbours instead, see ``_hub_links``: linear in their number
    and exact, so no link is lost to a cap.
    """
    cut, radius = _segments(segments), distance // segments
    width = lambda w: (1 << w) - 1
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(width(w))).alias("k")) for s, (a, w) in enumerate(cut)])).alias("x"))
    table = table.select("fp", "x.s", "x.k")
    # Of two segments that differ, the one that a probe starts from is lower, so that each pair is fetched from one side.
    probes = None
    for s, (a, w) in enumerate(cut):
        ball = F.array(*[F.lit(m).cast("long") for m in _ball(w, radius)])
        mine = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(width(w)))
        part = fps.select("fp", F.lit(s).alias("s"), mine.alias("mine"), F.explode(ball).alias("m")).select("fp", "s", F.expr("mine ^ m").alias("k"), (F.col("m") == 0).alias("same"), (F.expr("mine ^ m") > F.col("mine")).alias("up"))
        part = part.filter("same or up").drop("up")
        probes = part if probes is None else probes.union(part)
    big = durable(table.groupBy("s", "k").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("s", "k"))
    some = not big.isEmpty()
    if some:
        inside = table.join(big, ["s", "k"], "left_semi").select("fp").union(probes.join(big, ["s", "k"], "left_semi").select("fp")).distinct()
        table = table.join(big, ["s", "k"], "left_anti")
    met = probes.join(table.withColumnRenamed("fp", "other"), ["s", "k"])
    near = F.bit_count(F.expr("fp ^ other")) <= distance
    found = met.filter(near & F.when(F.col("same"), F.col("fp") < F.col("other")).otherwise(F.col("fp") != F.col("other"))).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    return found.union(_hub_links(inside, distance)) if some else found


def _hub_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links among ``fps`` through hubs, the values in a small ball around each of them.

    Two values are within ``distance`` if and only if some hub lies within distance // 2 of
    one and within the rest of the other. Around a hub with a value that near (a), all such
    values and all of the wider ball are within ``distance`` of a, so a star around the
    least of the near ones carries all links that meet there. The rows are a constant
    (2,081 for distance 3) times the values.
    """
    near = distance // 2
    ball = _ball(64, distance - near)
    masks = F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("m"), F.lit(bin(m).count("1") <= near).alias("near")) for m in ball])
    hubs = fps.select("fp", F.explode(masks).alias("x")).select("fp", F.expr("fp ^ x.m").alias("hub"), "x.near")
    centre = hubs.groupBy("hub").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("c"), F.count("*").alias("n")).filter("c is not null and n > 1")
    return hubs.join(centre, "hub").filter("fp <> c").select(F.col("fp").alias("u"), F.col("c").alias("v")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, segments: int = 2, dense: int = 2048, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per row of ``docs``: (key, fingerprint of 16 hex digits, component_id).

    component_id is the smallest ``key`` that links of at most ``distance`` bits reach. Null,
    empty and blank texts have fingerprint zero and are linked like any other. Repeated keys
    give repeated rows; a null key keeps its row and is never a component_id unless all keys
    of its component are null. An empty table gives no rows. Other columns are ignored.

    Equal fingerprints are merged before any search, so exact copies cost one map-side
    combined row, and the links are found among different fingerprints only.
    """
    marked = durable(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "fp", size))
    least = durable(marked.groupBy("fp").agg(F.min("key").alias("least")))
    label = connected_components(links(least.select("fp"), distance, segments, dense))
    whole = least.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    whole = durable(whole)
    named = durable(whole.join(whole.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id"))
    return marked.join(named, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by Jaccard similarity -------------------------------------------------------------
@dataclass(frozen=True)
class Wide:
    """A wide fingerprint: 64 bits, and ``segments`` segments of ``width`` bits for the multi-index search."""

    width: int = 24
    segments: int = 32

    @property
    def bits(self) -> int:
        return 64 + self.width * self.segments

    @classmethod
    def of(cls, rows: int, similarity: float = 0.8, recall: float = 0.97) -> Wide:
        """For a table of so many rows: segments so wide that few cells hold two unlike nodes, 24 bits at least, and so many that
        two texts of ``similarity`` agree but for one bit in some segment with probability ``recall``."""
        width = max(24, math.ceil(math.log2(max(rows, 1))) + 2)
        p = share_differing(similarity)
        met = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
        return cls(width, math.ceil(math.log(1 - recall) / math.log(1 - met)))

    def differing(self, similarity: float, deviations: float) -> int:
        """In how many bits shingle sets of a Jaccard similarity differ, so many standard deviations from the mean."""
        p = share_differing(similarity)
        return round(self.bits * p + deviations * math.sqrt(self.bits * p * (1 - p)))


def share_differing(similarity: float) -> float:
    """The share of bits that differ: the angle between the sets' indicator vectors over pi, whose cosine is,
    for sets of like size, 2 s / (1 + s)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


_SPACES = np.ones(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = False


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the different runs of ``size`` words of a text, sorted; of all its words if there are fewer; none for null or blank."""
    raw = lowered(text)
    starts, ends = word_spans(raw, _SPACES)
    if not len(starts):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(raw, starts, ends), min(size, len(starts))))


def wide_fingerprint(grams: np.ndarray, shape: Wide = Wide()) -> tuple[int, list[int]]:
    """(64 bits as a signed number, the numbers of the segments): each bit is set if it is in over half of the shingles' hashes."""
    words = -(-shape.bits // 64)
    salts = (np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    counts, n = np.zeros(64 * words, np.int64), len(grams)
    for at in range(0, n, 255):  # counts of 255 hashes fit a byte
        mixed = mix(grams[at : at + 255, None] ^ salts)
        counts += np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    bits = 2 * counts > n
    first = int(np.packbits(bits[:64]).view(">u8")[0])
    return _signed(first), (bits[64 : shape.bits].reshape(shape.segments, shape.width) @ (1 << np.arange(shape.width)[::-1])).tolist()


def _wide(docs: DataFrame, size: int, shape: Wide) -> DataFrame:
    """``docs`` (key, id, text) as (key, id, fp, wide)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(shingles(t.as_py(), size), shape) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array([f for f, _ in found], pa.int64()), pa.array([w for _, w in found], pa.list_(pa.int32()))], ["key", "id", "fp", "wide"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(scan, f"key {types['key']}, id long, fp long, wide array<int>")


def _grams(texts: DataFrame, size: int) -> DataFrame:
    """``texts`` (fp, text) as (fp, grams)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), size).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(found, pa.list_(pa.int64()))], ["fp", "grams"])

    return texts.mapInArrow(scan, "fp long, grams array<long>")


def _cells(nodes: DataFrame, shape: Wide) -> DataFrame:
    """(k, x, fp) of each segment of ``nodes`` (fp, wide): k numbers segment and value, x is the value."""
    return nodes.select("fp", F.posexplode("wide").alias("s", "x")).select((F.col("s").cast("long") * (1 << shape.width) + F.col("x")).alias("k"), "x", "fp")


def _shared(nodes: DataFrame, shape: Wide) -> DataFrame:
    """(k, fp, n) of the cells that n > 1 ``nodes`` (fp, wide) are in."""
    cells = _cells(nodes, shape).select("k", "fp")
    return durable(cells.join(joinable(cells.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), 1_000_000), "k"))


def _apart(fp: str, wide: str, other: str, other_wide: str) -> Column:
    """In how many bits two wide fingerprints differ."""
    return F.aggregate(F.zip_with(wide, other_wide, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d) + F.bit_count(F.col(fp).bitwiseXOR(F.col(other)))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shape: Wide, similarity: float, size: int) -> DataFrame:
    """Of the pairs (u, v) of ``nodes``, links (u, v) that join all of them that are of at least ``similarity``.

    Pairs that differ in so few bits that only a similarity well above the limit explains it are links; of
    those in doubt only the ones that would join different components are verified by the Jaccard similarity of their shingles.
    """
    mine = nodes.select(F.col("fp").alias("u"), F.col("wide").alias("a"))
    apart = _apart("u", "a", "v", "b")
    met = pairs.join(mine, "u").join(mine.select(F.col("u").alias("v"), F.col("a").alias("b")), "v").select("u", "v", apart.alias("distance"))
    met = durable(met.filter(F.col("distance") <= shape.differing(similarity, 3)))
    sure = met.filter(F.col("distance") <= shape.differing(similarity, -3)).select("u", "v")
    label = durable(connected_components(sure))
    named = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    doubtful = met.filter(F.col("distance") > shape.differing(similarity, -3)).join(named("u"), "u", "left").join(named("v"), "v", "left")
    doubtful = durable(doubtful.filter(F.coalesce("label_u", "u") != F.coalesce("label_v", "v")).select("u", "v"))
    if doubtful.isEmpty():
        return sure
    some = joinable(doubtful.select(F.col("u").alias("fp")).union(doubtful.select("v")).distinct(), 1_000_000)
    grams = durable(_grams(texts.join(some, "fp"), size).dropDuplicates(["fp"]))
    both = doubtful.join(grams.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u").join(grams.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return durable(sure.union(both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")))


def central_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (u, v) of each node with the most central one in each cell it shares with others (``_shared``): that whose own cells are fullest."""
    weight = shared.groupBy("fp").agg(F.sum("n").alias("weight"))
    centre = shared.join(weight, "fp").groupBy("k").agg(F.max(F.struct("weight", "fp")).alias("x")).select("k", F.col("x.fp").alias("centre"))
    return shared.join(centre, "k").filter("fp <> centre").select(F.least("fp", "centre").alias("u"), F.greatest("fp", "centre").alias("v")).distinct()


def crossing_pairs(nodes: DataFrame, shared: DataFrame, labels: DataFrame, shape: Wide, similarity: float = 0.8) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (fp, wide) of different ``labels`` (node, label) that a multi-index search finds near each other.

    Each node is put into one table per segment and probes it with the ball of radius 1 around its own
    segment. A probe that meets a single node is verified by its 64 bits at once; one of a
    cell of several meets its members if they don't all bear its label, and the join gives only those with
    other labels that all bits verify. Nodes without a label are their own; ``shared`` is what ``_shared`` gives of them.
    """
    p = share_differing(similarity)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= round(64 * p + 4 * math.sqrt(64 * p * (1 - p)))
    cells = _cells(nodes, shape)
    table = cells.select("k", "fp")
    # A bit is only ever added, so that two nodes that differ in one meet from one side; equal segments are in ``shared``.
    flips = F.filter(F.array(*[F.lit(1 << i) for i in range(shape.width)]), lambda m: F.col("x").bitwiseAND(m) == 0)
    probes = cells.select("fp", "k", F.explode(flips).alias("m")).select((F.col("k") + F.col("m")).alias("k"), "fp")
    inside = table.groupBy("k").agg(F.min("fp").alias("first"), F.count("*").alias("n"))
    hits = durable(probes.join(inside, "k").filter((F.col("n") > 1) | near).select("k", "fp"))
    labels = joinable(labels.select(F.col("node").alias("fp"), "label"), 1_000_000)
    named = lambda rows: durable(rows.join(labels, "fp", "left").select("k", "fp", F.coalesce("label", "fp").alias("label")))
    mine = named(hits.union(shared.select("k", "fp")))
    theirs = named(table.join(joinable(mine.select("k").distinct(), 1_000_000), "k"))
    both = mine.select("k", "label").union(theirs.select("k", "label")).groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = joinable(both.filter("low <> high").select("k"), 1_000_000)
    # Only the rows of cells with several labels take their bits along.
    whole = lambda rows: rows.join(mixed, "k").join(nodes.select("fp", "wide"), "fp").select("k", "fp", "label", "wide")
    other = (F.col("label") != F.col("theirs")) & (_apart("fp", "wide", "other", "b") <= shape.differing(similarity, 3))
    found = whole(mine).join(whole(theirs).toDF("k", "other", "theirs", "b"), "k").filter(other)
    return found.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def similar_components(nodes: DataFrame, texts: DataFrame, shape: Wide, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(node, label) of the ``nodes`` (fp, wide) with others of at least ``similarity``: label is the least that links reach.

    First each node meets the central ones of its cells only, which joins most of a large group by as many rows
    as it has members; then nodes of different components meet by the full search. ``texts`` (fp, text) holds
    the nodes' texts.
    """
    shared = _shared(nodes, shape)
    central = _verified(central_pairs(shared), nodes, texts, shape, similarity, size)
    labels = durable(connected_components(central))
    return connected_components(central.union(_verified(crossing_pairs(nodes, shared, labels, shape, similarity), nodes, texts, shape, similarity, size)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: that with the smallest key.

    Two steps, both by multi-index search among SimHash fingerprints of ``size``-word shingles. First, documents linked by
    at most 3 differing bits of 64 (``links``) leave one each, so that large groups of all but equal
    documents shrink to a few. Second, of the documents left, those linked by a Jaccard similarity of
    at least ``similarity`` (``similar_components``) leave one each.

    Null, empty and blank texts are copies of each other. Rows with a null key stay. Of rows that
    repeat both key and text one stays, the least by its columns. An empty table gives none;
    columns keep their names whatever they are. Texts are read, not moved: the dropped rows' keys and 64-bit
    text hashes go to all tasks while they are at most a million, and are joined by a shuffle beyond.
    """
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("id"), F.col(text).alias("text")).filter("key is not null")
    shape = Wide.of(docs.count(), similarity)
    rows = durable(_wide(slim, size, shape).groupBy("key", "id").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("wide").alias("wide")))
    nodes = durable(rows.groupBy("fp").agg(F.min(F.struct("key", "id")).alias("least"), F.min("wide").alias("wide")))

    def survivors(of: DataFrame, label: DataFrame) -> DataFrame:
        label = of.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        first = label.groupBy("label").agg(F.min(F.struct("least", "fp")).alias("x")).select(F.col("x.fp").alias("fp"))
        return durable(of.join(first, "fp", "left_semi"))

    nodes = survivors(nodes, connected_components(links(nodes.select("fp"))))
    ids = joinable(nodes.select("least.key", "least.id", "fp"), 1_000_000)
    nodes = survivors(nodes, similar_components(nodes, slim.join(ids, ["key", "id"]).select("fp", "text"), shape, similarity, size))
    kept = nodes.select("least.key", "least.id").withColumn("kept", F.lit(True))
    judged = durable(rows.select("key", "id", "n").join(kept, ["key", "id"], "left").filter("kept is null or n > 1"))

    k, i = unused(docs, "key"), unused(docs, "id")
    named = lambda df: df.select(F.col("key").alias(k), F.col("id").alias(i))
    marked = docs.select("*", F.col(key).alias(k), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(i))
    left = marked.join(joinable(named(judged), 1_000_000), [k, i], "left_anti")
    again = judged.filter("kept")
    if not again.isEmpty():
        repeated = marked.join(joinable(named(again), 1_000_000), [k, i], "left_semi")
        least = F.first if "map<" in docs.schema.simpleString() else F.min
        left = left.unionByName(repeated.groupBy(k, i).agg(least(F.struct(*docs.columns)).alias("row")).select(k, i, "row.*"))
    return left.select(*docs.columns)
