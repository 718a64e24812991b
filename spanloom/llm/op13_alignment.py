"""Operator 13, cross-tokenizer alignment by segment deduplication.

Two tokenizers, A (a byte-level ``tokenizers`` file) and B (a ``sentencepiece`` model), encode a space and the text.  Where
tokens of both end at the same byte the text is cut into *groups*; a *link* is an A and a B token that share a byte.

* Segments.  A text is split before runs of white space, but only where neither vocabulary can merge across: no entry of A
  or B holds the two characters that meet there, which is read from the vocabularies (``Splitter``).  As no merge can cross such
  a place, the tokens of a text are those of its segments, and as both end a token there, groups and links lie inside one.
* Every task collects its documents into blocks of about ``block_chars`` characters: the block's distinct segments with
  their counts, and per document the numbers of its segments in order.
* One shuffle brings equal segments of all blocks together in order.  Distinct segments get numbers and are tokenised and
  aligned once; from there on rows name a segment by its number.  Links of all segments, times their counts, are summed per
  id pair; what a segment's links add to a document is summed per segment.
* Alignments are joined back to the blocks by segment, once per block and segment, and travel to them as compressed messages,
  from which each block's documents are composed.  So no row stands for a single occurrence, and the commonest segment has one row per block.

Why the bytes of a text need not be compared token by token: all 256 bytes are entries of A and of B, so either joins to
what its normalisation leaves of the text.  A file of A with a normaliser is refused; for B the normalised text is compared.

Cases: null and empty texts, and those that B's normalisation changes (a U+2581 in the text is one), have no tokens: zeros,
and an empty alignment; their links count nowhere.  A text without white space is one segment, a very long one is split like
others.  Repeated rows are composed and counted one by one; a null id stays null.  Ties for a B id's highest count all count
as best.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import importlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, materialize, pieces, release, tidy

#: Places to split: before a run that begins with one of these, after a character that is no white space.
STARTS = " \n\t"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if json.loads(Path(path).read_text())["normalizer"]:
            raise ValueError(f"{path} changes texts before it encodes them")
        self.library = importlib.import_module("tokenizers").Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.library.get_vocab(with_added_tokens=False)
        self.entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
        if not {bytes([b]) for b in range(256)} <= set(self.entries):
            raise ValueError(f"{path} lacks single bytes")

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str):
        self.library = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        single = [self.library.is_byte(i) for i in range(len(names))]
        if sum(single) != 256:
            raise ValueError(f"{path} lacks single bytes")
        self.entries = [bytes([int(x[3:5], 16)]) if b else x.replace("▁", " ").encode() for x, b in zip(names, single, strict=True)]
        for i in range(len(names)):
            if self.library.is_control(i) or self.library.is_unknown(i):
                self.entries[i] = b""
        self.space = self.library.piece_to_id("▁")

    def keeps(self, text: str) -> bool:
        """Whether the pieces of a text join to a space and the text."""
        return self.library.normalize(text).replace("▁", " ") == " " + text

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The model adds a space to each: it is the segment's own where one begins it, and is taken off again where none does."""
        found = self.library.encode([x[1:] if x[0] == " " else x for x in segments], num_threads=1)
        return [x if s[0] == " " else x[1:] for s, x in zip(segments, found, strict=True)]


class Splitter:
    """Splits before white space where no entry of either vocabulary holds the two characters that meet."""

    def __init__(self, *vocabularies: list[bytes]):
        # entries that begin or end inside a character have the bytes of its part as lone surrogates
        texts = [e.decode("utf-8", "surrogateescape") for entries in vocabularies for e in entries]
        met = {pair for t in texts for pair in zip(t, t[1:])}
        rules = []
        for start in STARTS:
            before = {a for a, b in met if b == start}
            # a part of some character, or a space that B sets before a segment, rules the place out altogether
            if any("\ud800" <= a <= "\udfff" for a in before) or (start != " " and " " in before):
                continue
            unsafe = "".join(re.escape(a) for a in sorted(before) if not a.isspace())
            rules.append(rf"(?<=[^\s{unsafe}])(?={start}\s*\S)")
        self.split = re.compile("|".join(rules)).split if rules else lambda text: [text]


@functools.lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, Splitter]:
    a, b = ByteLevel(a_path), Pieces(b_path)
    return a, b, Splitter(a.entries, b.entries)


class Numbered(dict):
    """Numbers of segments in order of their first use."""

    def __missing__(self, segment: str) -> int:
        self[segment] = found = len(self)
        return found


BLOCK = "block long, doc_id long, places binary, segments array<string>, counts array<long>"


def blocks_of(a_path: str, b_path: str, block_chars: int):
    """Documents as segment numbers, and a row with a block's segments and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, b, splitter = tokenizers(a_path, b_path)
        squeeze = zstandard.ZstdCompressor(1).compress
        task, number, known, ids, places, held = TaskContext.get().partitionId(), 0, Numbered(), [], [], 0

        def flush() -> pa.RecordBatch:
            block, n = (task << 32) + number, len(ids)
            counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *(p for p in places if p is not None)]).astype(np.int64), minlength=len(known))
            return pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1), pa.int64()), pa.array([*ids, None], pa.int64()), pa.array([*(b"" if p is None else squeeze(p.tobytes()) for p in places), None], pa.binary()),
                pa.array([None] * n + [list(known)], pa.list_(pa.string())), pa.array([None] * n + [counts], pa.list_(pa.int64())),
            ], names=["block", "doc_id", "places", "segments", "counts"])

        for batch, texts in pieces(batches):
            for doc, text in zip(ids_of(batch).to_pylist(), texts, strict=True):
                ids.append(doc)
                if text and b.keeps(text):
                    found = splitter.split(" " + text)
                    places.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    held += len(text)
                else:
                    places.append(None)
                if held >= block_chars or len(ids) >= 200_000:
                    yield flush()
                    number, known, ids, places, held = number + 1, Numbered(), [], [], 0
        if ids:
            yield flush()

    return run


def ends_of(ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the byte where each ends."""
    flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
    return flat, np.cumsum(lengths[flat])


def align(segments: list[str], a: ByteLevel, b: Pieces) -> dict[str, list]:
    """Ids, groups and links of segments.

    The ends of either cut the bytes into stretches; a stretch lies in one A and one B token, and two tokens that overlap
    share just one.  So stretches are links, and places that both cut are the ends of groups.
    """
    ids_a, ids_b = a.encode(segments), b.encode(segments)
    flat_a, end_a = ends_of(ids_a, np.array([len(e) for e in a.entries]))
    flat_b, end_b = ends_of(ids_b, np.array([len(e) for e in b.entries]))
    edge = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in segments])
    cut = np.union1d(end_a, end_b)
    both = np.intersect1d(end_a, end_b)
    link_a, link_b = flat_a[np.searchsorted(end_a, cut)], flat_b[np.searchsorted(end_b, cut)]
    last_link, last_group = np.searchsorted(cut, edge, "right"), np.searchsorted(both, edge, "right")
    stop_a, stop_b = np.searchsorted(end_a, both, "right").tolist(), np.searchsorted(end_b, both, "right").tolist()
    name_a, name_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
    groups, x, y = [], 0, 0
    for i, j in zip(stop_a, stop_b, strict=True):
        groups.append(f"{','.join(name_a[x:i])}|{','.join(name_b[y:j])}")
        x, y = i, j
    cut_at = lambda whole, stops: [whole[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
    grouped = cut_at(groups, last_group.tolist())
    return {"n_a": [len(x) for x in ids_a], "groups": [";".join(g) for g in grouped], "link_a": cut_at(link_a, last_link.tolist()), "link_b": cut_at(link_b, last_link.tolist())}


ALIGNED = "segment long, block long, no int, n long, n_a int, groups string, link_a array<int>, link_b array<int>"


def align_segments(a_path: str, b_path: str):
    """From (segment, n, block, no) rows in order of segments, all of a segment's in one task: the segments get numbers.

    A row per place (segment, block, no), and one per distinct segment with its count and its alignment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = tokenizers(a_path, b_path)
        kinds = dict(zip(("segment", "block", "no", "n", "n_a", "groups", "link_a", "link_b"), (*[pa.int64()] * 2, pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 2), strict=True))

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

        number, held, total = TaskContext.get().partitionId() << 40, None, 0
        for batch, segments in pieces(batches, "segment", 500_000):
            fresh = np.array([x != y for x, y in zip(segments, [held, *segments], strict=False)])
            at = number + np.cumsum(fresh) - (held is None)
            yield rows(len(at), segment=at, block=ids_of(batch, "block"), no=ids_of(batch, "no"))
            starts = np.flatnonzero(fresh)
            sums = np.add.reduceat(np.r_[total, ids_of(batch, "n").to_numpy()], np.r_[0, starts + 1])
            names = [held, *(segments[i] for i in starts)]
            if held is None:
                names, sums = names[1:], sums[1:]
            if len(names) > 1:
                yield rows(len(names) - 1, segment=number + np.arange(len(names) - 1), n=sums[:-1], **align(names[:-1], a, b))
            number, held, total = number + len(names) - 1, names[-1], int(sums[-1])
        if held is not None:
            yield rows(1, segment=[number], n=[total], **align([held], a, b))

    return run


ANSWER = pa.schema([("no", pa.int32()), ("n_a", pa.int32()), ("n_best", pa.int32()), ("count_sum", pa.int64()), ("groups", pa.string())])


def bundled(batches: Iterator[pa.RecordBatch], most: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Answers as compressed messages, one per block and about ``most`` bytes of a task, so that rows are not shuffled one by one."""
    squeeze, held = zstandard.ZstdCompressor(3).compress, []

    def flush() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("no", "ascending")]).combine_chunks()
        block, no = whole.column("block").to_numpy(), whole.column("no").to_numpy()
        # numbers are kept as steps, which are small
        answers = whole.select(ANSWER.names).set_column(0, "no", pa.array(np.diff(no, prepend=0).astype(np.int32))).cast(ANSWER)
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        first = pa.array(no[edge[:-1]], pa.int32())
        parts = [answers.slice(i, j - i).combine_chunks().to_batches()[0] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]], pa.int64()), first, pa.array([squeeze(p.serialize()) for p in parts], pa.binary())], names=["block", "first", "held"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield flush()
            held.clear()
    if held:
        yield flush()


def compose(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents from the alignments of its segments.

    Tokens are told from the text: a group of p and q has p + q - 2 commas, and p + q - 1 links.
    """
    expand = zstandard.ZstdDecompressor().decompress
    parts = [pa.ipc.read_record_batch(pa.py_buffer(expand(x)), ANSWER) for x in right.column("held").to_pylist()]
    numbers = [first + np.r_[0, np.cumsum(p.column(0).to_numpy()[1:])] for first, p in zip(right.column("first").to_pylist(), parts, strict=True)]
    order, right = np.argsort(np.concatenate([np.zeros(0, np.int64), *numbers]), kind="stable"), pa.Table.from_batches(parts, ANSWER)
    groups = pa.concat_arrays(right.column("groups").chunks).take(pa.array(order)) if len(order) else pa.array([], pa.string())
    values = [right.column(m).to_numpy()[order].astype(np.int64) for m in ("n_a", "n_best", "count_sum")]
    places = [np.frombuffer(expand(p) if p else b"", np.int32) for p in left.column("places").to_pylist()]
    offset = np.r_[0, np.cumsum([len(p) for p in places])].astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *places])
    n_a, n_best, count_sum = (np.diff(np.r_[0, np.cumsum(v[flat])][offset]) for v in values)
    texts = [pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), groups.take(pa.array(p))), ";")[0].as_py() for p in places]
    n_groups = np.array([t.count(";") + 1 if t else 0 for t in texts], np.int64)
    both = np.array([t.count(",") for t in texts], np.int64) + 2 * n_groups
    counted = (n_a, both - n_a, n_groups, both - n_groups, n_best, count_sum)
    return pa.table([left.column("doc_id"), *(pa.array(v, pa.int64()) for v in counted), pa.array(texts, pa.string())], names=["doc_id", *MEASURES, "groups"])


def links_of(aligned: DataFrame) -> DataFrame:
    """A row per link of a distinct segment."""
    return aligned.select("segment", "n", F.explode(F.arrays_zip("link_a", "link_b")).alias("l")).select("segment", "n", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count: how many links of the corpus hold the two ids; best: whether no A id has more with this B id."""
    counts = links_of(aligned).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_chars: int = 16_000_000) -> tuple[DataFrame, DataFrame]:
    """Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (`a1,a2|b1;a3|b2,b3`); and the pair counts."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = materialize(rows.mapInArrow(blocks_of(a_path, b_path, block_chars), BLOCK), "alignment-blocks")
    named = blocks.where("segments is not null").select("block", F.posexplode(F.arrays_zip("segments", "counts")).alias("no", "s"))
    named = named.select("block", "no", F.col("s.segments").alias("segment"), F.col("s.counts").alias("n"))
    ordered = named.repartition("segment").sortWithinPartitions("segment")
    numbered = materialize(ordered.mapInArrow(align_segments(a_path, b_path), ALIGNED), "alignment-segments")
    documents = materialize(blocks.where("places is not null").select(F.col("block").alias("own"), "doc_id", "places"), "alignment-documents")
    release(blocks)
    places, aligned = numbered.where("block is not null").select("segment", "block", "no"), numbered.where("block is null")
    tidy(docs.sparkSession)
    pairs = materialize(pair_counts(aligned), "alignment-pairs")
    tidy(docs.sparkSession)
    sums = links_of(aligned).join(pairs, ["a", "b"]).groupBy("segment").agg(F.sum("count").alias("count_sum"), F.sum(F.col("best").cast("int")).cast("int").alias("n_best"))
    joined = places.join(aligned.select("segment", "n_a", "groups"), "segment").join(sums, "segment")
    answers = materialize(joined.select("block", "no", "n_a", "n_best", "count_sum", "groups"), "alignment-answers")
    release(numbered)
    tidy(docs.sparkSession)
    kind = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups string"
    messages = answers.mapInArrow(bundled, "block long, first int, held binary")
    return documents.groupBy("own").cogroup(messages.groupBy("block")).applyInArrow(compose, kind), pairs
