"""Quality rules from a suffix array over the words of each text.

Many documents are laid end to end as numbers of words that differ between documents, so no repeat crosses from one to the
next. Prefix doubling (each round sorts only suffixes that are still tied) gives the suffix array and the ranks by which
the longest common prefix of neighbours is found. A neighbour pair's common prefix of ``min_repeat`` words or more is a
maximal repeat; the union of these spans must not cover too much of a text, nor the longest be too long.

Defined results: a null text has no words and fails the base rule; any id is passed through; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored (``filter_docs`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, portions

#: White space between words, and the symbols counted.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
WORDS_AT_ONCE = 500_000


def common_prefixes(docs: np.ndarray, words: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """For each place, how many words from there on occur again elsewhere in its document; numbers under ``least`` may be less.

    docs, words: the document and the word number at each place; ends: where its document ends. The result is the larger
    common prefix with the two neighbours in suffix order.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    key = docs * (int(words.max()) + 1) + words
    ranks, tied, h = [], np.arange(n), 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is where it starts
    first_of = np.flatnonzero(new)
    sizes = np.diff(np.r_[first_of, n])
    tied = order[np.repeat(sizes > 1, sizes)]
    ranks.append(rank.astype(np.int32))
    while len(tied):
        beyond = tied + h
        second = np.where(beyond < ends[tied], rank[np.minimum(beyond, n - 1)] + 1, 0)
        own = rank[tied]
        combined = own * (n + 1) + second
        order = np.argsort(combined, kind="stable")
        at, combined, own = tied[order], combined[order], own[order]
        new = np.r_[True, combined[1:] != combined[:-1]]
        group = np.r_[True, own[1:] != own[:-1]]
        index = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank = rank.copy()
        rank[at] = own + offset
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(at)])
        tied = at[np.repeat(sizes > 1, sizes)]
        ranks.append(rank.astype(np.int32))
        h *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    pair = np.flatnonzero(ranks[0][a] == ranks[0][b]) if n > 1 else np.zeros(0, dtype=np.int64)
    level = min(max(1, least).bit_length() - 1, len(ranks) - 1)
    pair = pair[ranks[level][a[pair]] == ranks[level][b[pair]]]  # shorter ones than 2**level words don't matter
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x + (1 << k) <= ends[a]) & (y + (1 << k) <= ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += np.where(inside & (ranks[k][x] == ranks[k][y]), 1 << k, 0)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document in the union of the spans; a span stays inside its document."""
    edge = np.zeros(len(docs) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.bincount(docs[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def _plain(text: str) -> tuple[int, int, int]:
    """Characters in words, symbols, repeated lines."""
    blank = sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(text) - blank, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


class Rules:
    """Thresholds of the two verdicts."""

    def __init__(self, min_words: int = 10, max_repeat_percent: int = 20, min_repeat: int = 10, max_covered_percent: int = 30, max_longest: int = 100, unit: str = "words"):
        """``unit``: what repeats, covered shares and lengths are counted in, words or characters; the base rule is in words."""
        if unit not in ("words", "characters"):
            raise ValueError("the unit is words or characters")
        self.unit = unit
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.min_repeat, self.max_covered_percent, self.max_longest = min_repeat, max_covered_percent, max_longest

    def judge(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Counts and verdicts of whole texts."""
        split = [(t or "").encode().split() for t in texts]
        n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        plain = np.array([_plain(t or "") for t in texts], dtype=np.int64).reshape(-1, 3)
        repeated, covering, longest = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + n_words[end] <= WORDS_AT_ONCE):
                size += int(n_words[end])
                end += 1
            part, count = split[at:end], n_words[at:end]
            numbers = {w: k for k, w in enumerate(set().union(*part))}
            words = np.fromiter((numbers[w] for ws in part for w in ws), dtype=np.int64, count=size)
            docs = np.repeat(np.arange(end - at), count)
            ends = np.repeat(np.cumsum(count), count)
            prefix = common_prefixes(docs, words, ends, min(WINDOW, self.min_repeat))
            twice = np.flatnonzero(prefix >= WINDOW)
            repeated[at:end] = covered(twice, np.full(len(twice), WINDOW), docs, end - at)
            long = np.flatnonzero(prefix >= self.min_repeat)
            covering[at:end] = covered(long, prefix[long], docs, end - at)
            np.maximum.at(longest, at + docs[long], prefix[long])
            at = end
        size_of = n_words
        if self.unit == "characters":
            size_of = np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))
            covering, longest = self._by_character(texts, size_of)
        failed = (n_words < self.min_words) | (100 * repeated > self.max_repeat_percent * n_words)
        fine = (100 * covering <= self.max_covered_percent * size_of) & (longest <= self.max_longest)
        return {
            "n_words": n_words, "word_chars": plain[:, 0], "n_symbols": plain[:, 1], "n_dup_lines": plain[:, 2],
            "n_repeat_words": repeated, "base_failed": failed, "kept": ~failed & fine, "n_covered": covering, "longest_repeat": longest,
        }

    def _by_character(self, texts: list[str | None], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters in the union of repeated substrings, and the longest."""
        covering, longest, at = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + sizes[end] <= WORDS_AT_ONCE):
                size += int(sizes[end])
                end += 1
            letters = np.frombuffer("".join(t or "" for t in texts[at:end]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            docs, ends = np.repeat(np.arange(end - at), sizes[at:end]), np.repeat(np.cumsum(sizes[at:end]), sizes[at:end])
            prefix = common_prefixes(docs, letters, ends, self.min_repeat)
            long = np.flatnonzero(prefix >= self.min_repeat)
            covering[at:end] = covered(long, prefix[long], docs, end - at)
            np.maximum.at(longest, at + docs[long], prefix[long])
            at = end
        return covering, longest


FLAGS = ("base_failed", "kept")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FLAGS, "n_covered", "longest_repeat")


def judge_docs(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts and verdicts for each document; no shuffle."""
    rules = rules or Rules()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.BooleanType() if c in FLAGS else T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                found = rules.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c]) for c in COUNTS)], schema.names)

    return rows.mapInArrow(lean(run), schema)


def filter_docs(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows that are kept, all their columns as they were; no shuffle."""
    rules = rules or Rules()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, place):
                yield part.filter(pa.array(rules.judge(part.column(place).to_pylist())["kept"]))

    return docs.mapInArrow(lean(run), docs.schema)
