"""Token counts with overlapping chunks of huge documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Stands before chunks; the model knows it as a byte only.
GUARD = "\n"


class Splicer:
    """Token ids of texts, equal to those of one call of the library on the whole text.

    A text of over ``chunk`` characters is encoded in chunks that overlap. Two neighbours are
    spliced at a boundary in their overlap at which both put a token boundary and which is
    proven stable: no piece of the vocabulary holds the two characters around it side by side,
    so no merge can ever cross it and the pieces left and right of it don't depend on each
    other. Where an overlap has no such boundary it is widened, up to the rest of the text.

    The proof needs a vocabulary that is merged pair by pair without rewriting characters:
    a BPE model of sentencepiece with the identity normalizer. Other models are refused.
    """

    def __init__(self, model: str, chunk: int = 16_384, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        if self.sp.decode(self.sp.encode("ﬁ Ａ  x")) != "ﬁ Ａ  x":
            raise ValueError("the model rewrites characters; chunks can't be proven equal to the whole")
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i)))
        pieces = list(pieces)
        if any(GUARD in p for p in pieces):
            raise ValueError("the model has pieces with line ends, which guard the chunks here")
        self.adjacent = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, left: str, right: str) -> bool:
        """No token can hold ``left`` and ``right`` side by side."""
        pair = (left + right).replace(" ", SPACE)
        return pair not in self.adjacent

    def _chunk(self, text: str, at: int, to: int) -> tuple[list[int], list[int]]:
        """Ids of text[at:to] and the offsets in ``text`` at which their tokens begin.

        The model puts a space before what it encodes. Only the first chunk may keep it; the
        others stand behind a guard character that no piece holds, and lose its tokens.
        """
        guard = GUARD if at else ""
        out = self.sp.encode(guard + text[at:to], return_type="offset_mapping")
        kept = [(i, at + b - len(guard)) for i, (b, e) in zip(out["ids"], out["offsets"]) if e > len(guard) or b >= len(guard)]
        return [i for i, _ in kept], [b for _, b in kept]

    def encode(self, text: str | None) -> list[int]:
        """Ids without begin, end or added special tokens; none for null and empty texts."""
        if not text:
            return []
        if len(text) <= self.chunk:
            return self.sp.encode(text)
        ids: list[int] = []
        at, end, width = 0, self.chunk, self.overlap
        now, begins = self._chunk(text, at, end)
        while end < len(text):
            start = max(at + 1, end - width)
            to = min(len(text), max(start + self.chunk, end + 1))
            then, after = self._chunk(text, start, to)
            cut = self._splice(text, begins, after, start, end)
            if cut is not None:
                ids += now[: begins.index(cut)]
                k = after.index(cut)
                at, end, width, now, begins = cut, to, self.overlap, then[k:], after[k:]
            elif start > at + 1:
                width *= 2
            else:  # no such boundary in all of the chunk: it grows itself, from a start known to be stable
                end, width = min(len(text), at + 2 * (end - at)), self.overlap
                now, begins = self._chunk(text, at, end)
        return ids + now

    def _splice(self, text: str, mine: list[int], theirs: list[int], start: int, end: int) -> int | None:
        """The last stable boundary between start and end at which both chunks begin a token."""
        common = set(theirs)
        for b in reversed(mine):
            if b <= start:
                return None
            if b < end and b in common and self.stable(text[b - 1], text[b]):
                return b
        return None

    def counts(self, texts: list[str | None]) -> list[int]:
        """Numbers of tokens; short texts go to the library together."""
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if t and len(t) <= self.chunk]
        for i, ids in zip(short, self.sp.encode([texts[i] for i in short], num_threads=1, return_type="numpy") if short else ()):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if t and len(t) > self.chunk:
                out[i] = len(self.encode(t))
        return out


@lru_cache(maxsize=4)
def splicer(model: str, chunk: int = 16_384, overlap: int = 256) -> Splicer:
    return Splicer(model, chunk, overlap)


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``model`` is the path of a sentencepiece BPE model, the same on every executor. Null and
    empty texts have 0 bytes and tokens; special strings inside texts are ordinary text;
    repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    A single pass without a shuffle; a task holds one Arrow batch and one chunk's tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splicer(model, chunk, overlap)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = s.counts(texts)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["key", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return slim.mapInArrow(run, f"key {dict(slim.dtypes)['key']}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
