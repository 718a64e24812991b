"""Operator 2, quality rules on repetition inside a text.

The words of a piece of the table are numbered and put into one suffix array by prefix doubling, ranks starting from
(row, word), so that no two rows ever share a prefix.  Ranks of every level give the longest common prefix of suffix
array neighbours by binary descent.  Each suffix belongs to the deepest LCP interval of ``min_repeat`` words or more that
holds it; the spans of these maximal repeated substrings are united per row.  A row passes if the united spans cover at
most ``max_fraction`` of its words and no repeat is longer than ``max_longest`` words.

Cases: a null or empty text has no words and fails the base rule.  Repeated rows are judged one by one, whatever stands
elsewhere in the table.  Occurrences may overlap each other.  An empty table gives an empty result.  Texts of any length
are taken whole; a piece holds about two million characters, or one text.  Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, ids_of, pieces

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def number_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, and where each text starts (one more entry at the end)."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    starts, parts = np.zeros(len(texts) + 1, dtype=np.int64), []
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes.split() splits at SPACES only
        parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        starts[i + 1] = starts[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), starts


class SuffixRanks:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; equal ranks mean equal prefixes within one row."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        n = self.n = len(words)
        self.row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.end = starts[1:][self.row] if n else np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []
        key = self.row * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key)
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, n])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, sizes)
        active = np.sort(order[np.repeat(sizes > 1, sizes)]) if n else order
        kind = np.int32 if n < 1 << 31 else np.int64  # levels are kept, so they are kept small
        self.levels.append(rank.astype(kind))
        width = 1
        while len(active):
            after = active + width
            inside = after < self.end[active]
            tail = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            own = rank[active]
            by = np.argsort(own * (n + 1) + tail)
            own, tail, active = own[by], tail[by], active[by]
            new_own = np.r_[True, own[1:] != own[:-1]]
            new_sub = new_own | np.r_[True, tail[1:] != tail[:-1]]
            at = np.arange(len(active))
            head_own = np.maximum.accumulate(np.where(new_own, at, 0))
            head_sub = np.maximum.accumulate(np.where(new_sub, at, 0))
            rank = rank.copy()
            rank[active] = own + head_sub - head_own
            groups = np.diff(np.r_[np.flatnonzero(new_sub), len(active)])
            active = np.sort(active[np.repeat(groups > 1, groups)])
            width *= 2
            self.levels.append(rank.astype(kind))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, by descent over the levels."""
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[level], a + got, b + got
            ok = (x < self.end[a]) & (y < self.end[b])
            same = ok & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            got += np.where(same, 1 << level, 0)
        return got

    def longest_from(self, least: int) -> np.ndarray:
        """For each suffix, the words it shares with another one of its row, where that is ``least`` or more; else 0."""
        best = np.zeros(self.n, np.int64)
        if self.n < 2:
            return best
        array = np.empty(self.n, np.int64)
        array[self.levels[-1]] = np.arange(self.n)  # all ranks of the last level differ
        level = min(least.bit_length() - 1, len(self.levels) - 1)
        near = self.levels[level][array]
        at = np.flatnonzero(near[1:] == near[:-1])
        a, b = array[at], array[at + 1]
        lcp = self.common(a, b)
        lcp[lcp < least] = 0
        np.maximum.at(best, a, lcp)
        np.maximum.at(best, b, lcp)
        return best


def repeated_windows(ranks: SuffixRanks, words: np.ndarray, size: int = 3) -> np.ndarray:
    """Words inside windows of three that their row holds twice or more, as a mask."""
    mask = np.zeros(ranks.n, bool)
    two = ranks.levels[min(1, len(ranks.levels) - 1)].astype(np.int64)
    at = np.flatnonzero(np.arange(ranks.n) + size <= ranks.end) if ranks.n else np.zeros(0, np.int64)
    if not len(at):
        return mask
    at = at[np.bincount(two, minlength=ranks.n + 1)[two[at]] > 1]
    if not len(at):
        return mask
    third = words[at + 2]
    by = np.argsort(two[at] * (int(third.max()) + 1) + third)
    x, y = two[at][by], third[by]
    same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    twice = np.r_[same, False] | np.r_[False, same]
    for d in range(size):
        mask[at[by][twice] + d] = True
    return mask


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray | list]:
    """All per-text figures of a piece; spans are (first word, words) of the united repeats."""
    words, starts = number_words(texts)
    ranks = SuffixRanks(words, starts)
    longest = ranks.longest_from(min_repeat)
    delta = np.zeros(ranks.n + 1, np.int64)
    hit = np.flatnonzero(longest)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + longest[hit], -1)
    covered = np.cumsum(delta[:-1]) > 0
    per_row = lambda x: np.add.reduceat(np.r_[x.astype(np.int64), 0], starts[:-1]) * (np.diff(starts) > 0) if len(texts) else np.zeros(0, np.int64)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, ranks.row, longest)
    edge = np.flatnonzero(covered & ~(np.r_[False, covered[:-1]] & (np.r_[-1, ranks.row[:-1]] == ranks.row)))
    stop = np.flatnonzero(covered & ~(np.r_[covered[1:], False] & (np.r_[ranks.row[1:], -1] == ranks.row))) + 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for s, e in zip(edge.tolist(), stop.tolist(), strict=True):
        row = int(ranks.row[s])
        spans[row].append((s - int(starts[row]), e - s))
    lines = []
    for text in texts:
        seen, again = set(), 0
        for line in text.split("\n") if text else ():
            if line.strip(SPACES):
                again += line in seen
                seen.add(line)
        lines.append(again)
    return {"n_words": np.diff(starts), "word_chars": np.array([len(t) - sum(map(t.count, SPACES)) if t else 0 for t in texts], dtype=np.int64), "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], dtype=np.int64), "n_dup_lines": np.array(lines, dtype=np.int64), "n_repeat_words": per_row(repeated_windows(ranks, words)), "covered_words": per_row(covered), "longest_repeat": top, "spans": spans}


def verdicts(m: dict, max_fraction: float, max_longest: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails, and whether a text is kept."""
    n = m["n_words"]
    failed = (n < min_words) | (100 * m["n_repeat_words"] > 50 * n)
    return failed, ~failed & (m["covered_words"] <= max_fraction * n) & (m["longest_repeat"] <= max_longest)


def keep(docs: DataFrame, text: str = "text", min_repeat: int = 8, max_fraction: float = 0.4, max_longest: int = 200, min_words: int = 50) -> DataFrame:
    """The rows that pass, with all their columns."""
    return filter_rows(docs, lambda: lambda texts: verdicts(measure(texts, min_repeat), max_fraction, max_longest, min_words)[1], text)


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", min_repeat: int = 8, max_fraction: float = 0.4, max_longest: int = 200, min_words: int = 50) -> DataFrame:
    """Per row: the base figures, covered words, the longest repeat, the united spans and the verdicts."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            m = measure(texts, min_repeat)
            failed, kept = verdicts(m, max_fraction, max_longest, min_words)
            figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
            spans = pa.array([[{"start": s, "words": w} for s, w in x] for x in m["spans"]], kind)
            yield pa.RecordBatch.from_arrays([ids_of(batch), *(pa.array(m[f], pa.int64()) for f in figures), pa.array(failed), pa.array(kept), spans], names=["doc_id", *figures, "base_failed", "kept", "spans"])

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean, spans array<struct<start:long,words:long>>")
