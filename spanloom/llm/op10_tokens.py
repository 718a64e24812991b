"""Operator 10, token counts with overlap resynchronisation.

A text is encoded in overlapping chunks with offsets; one of at most ``chunk`` code points is a single chunk.  Where two
chunks overlap they are spliced at a *stable common boundary*: a place at which both encodings end one token and begin the
next, with the same tokens, ids and offsets, on either side of it.  Tokens left of it come from the left chunk, the others
from the right one.

Why that is the encoding of the whole text.  Inside one piece of the pre-tokenizer a sequence of tokens is what byte-pair
merging gives if every two neighbours are what it gives for the string of those two: merges inside a token do not see
beyond its ends, so the first merge to cross one of its ends would cross it in the pair alone as well.  After a splice all
neighbours were neighbours in one of the two encodings, those at the seam in both.  The pieces are the same too, as the
pre-tokenizers read from left to right with no memory beyond the piece at hand, and both chunks are past their common
tokens in the same piece.  What the cut ends of the chunks change stays near them: a chunk starts at a boundary of the one
before, and a boundary counts only with ``context`` equal tokens on either side.

If an overlap holds no such boundary, it is widened, the right chunk starting earlier; once it starts where the left one
does, the left chunk itself grows to twice its length.  So work is in proportion to the text whatever it is made of, unless
no two chunks of it ever agree, when it ends as one chunk, which is the library's own answer.

Cases: null counts as the empty text: 0 bytes, 0 tokens.  Special strings inside texts are handled as the library does by
default.  Repeated rows are counted one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import importlib
import itertools
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, pieces


class Chunk:
    """Tokens of a chunk: ids and, when asked for, places in the text, in code points."""

    def __init__(self, ids: Sequence[int], place: Callable[[int], tuple[int, int]], begin: int):
        self.ids, self._place, self.begin, self.n = ids, place, begin, len(ids)

    def span(self, i: int) -> tuple[int, int]:
        start, end = self._place(i)
        return start + self.begin, end + self.begin

    def after(self, place: int) -> int:
        """The number of tokens that start before ``place``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.span(middle)[0] < place:
                low = middle + 1
            else:
                high = middle
        return low

    def is_boundary(self, i: int) -> bool:
        """Whether token i begins at or after the end of the one before; tokens that share a character do not."""
        return i > 0 and self.span(i)[0] >= self.span(i - 1)[1]

    def around(self, i: int, context: int) -> list[tuple[int, int, int]] | None:
        """Ids and places of the tokens about a boundary; None where there are too few."""
        if i < context or i + context > self.n:
            return None
        return [(self.ids[k], *self.span(k)) for k in range(i - context, i + context)]


class Encoder:
    """A ``tokenizers`` file: tokens with offsets, and counts of texts of one chunk."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = importlib.import_module("tokenizers").Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def chunk(self, text: str, begin: int, end: int) -> Chunk:
        found = self.library.encode(text[begin:end], add_special_tokens=False)
        return Chunk(found.ids, found.token_to_chars, begin)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceEncoder(Encoder):
    """The same for a ``sentencepiece`` model."""

    def __init__(self, path: str):
        self.library = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)

    def chunk(self, text: str, begin: int, end: int) -> Chunk:
        part = text[begin:end]
        found = self.library.encode(part, return_type="proto").pieces
        bytes_before = list(itertools.accumulate((len(c.encode("utf-8", "surrogatepass")) for c in part), initial=0))
        place = lambda i: (bisect.bisect_left(bytes_before, found[i].begin), bisect.bisect_left(bytes_before, found[i].end))
        return Chunk([x.id for x in found], place, begin)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path)


def align(left: Chunk, right: Chunk, context: int) -> tuple[int, int] | None:
    """The last stable boundary of both, as the tokens of either that come before it."""
    places = {right.span(m)[0]: m for m in reversed(range(right.after(left.span(left.n - 1)[0] + 1))) if right.is_boundary(m)} if left.n else {}
    for n in reversed(range(left.after(right.begin), left.n)):
        m = places.get(left.span(n)[0])
        if m is not None and left.is_boundary(n) and (own := left.around(n, context)) and own == right.around(m, context):
            return n, m
    return None


def count_long(text: str, encode: Callable[[str, int, int], Chunk], chunk: int = 8_192, overlap: int = 256, context: int = 4) -> int:
    """Tokens of a text of any length, from overlapping chunks."""
    end, total, first = min(chunk, len(text)), 0, 0  # first: tokens of the held chunk that are counted already
    held = encode(text, 0, end)
    while end < len(text):
        width = overlap
        while True:
            # the next chunk starts at a boundary of this one, so that runs of one pattern are cut in step
            edge = min(held.after(end - width + 1), held.n) - 1
            while edge > first and not held.is_boundary(edge):
                edge -= 1
            if edge <= first:
                end = min(len(text), held.begin + 2 * (end - held.begin))
                grown = encode(text, held.begin, end)
                tail = range(max(0, first - context), first)
                if grown.n < first or any((grown.ids[k], grown.span(k)) != (held.ids[k], held.span(k)) for k in tail):
                    return encode(text, 0, len(text)).n  # the growth changed what was counted: the library's answer for the whole
                held = grown
                break
            until = min(len(text), end + chunk)
            following = encode(text, held.span(edge)[0], until)
            found = align(held, following, context)
            if found and found[0] > first:
                total += found[0] - first
                held, end, first = following, until, found[1]
                break
            width *= 2
    return total + held.n - first


def count_texts(texts: list[str | None], own: Encoder, chunk: int, overlap: int) -> list[int]:
    """Counts of texts; those of one chunk have nothing to splice and go to the library together."""
    one = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
    out = [0] * len(texts)
    for i, n in zip(one, own.counts([texts[i] for i in one]), strict=True):
        out[i] = n
    for i, t in enumerate(texts):
        if t and len(t) > chunk:
            out[i] = count_long(t, own.chunk, chunk, overlap)
    return out


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """Per row: UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.  ``path``: a .json or .model file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, texts in pieces(batches, limit=1_000_000):
            n = count_texts(texts, own, chunk, overlap)
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([ids_of(batch), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
