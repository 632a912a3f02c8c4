"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged numpy arrays.

A text becomes pre-tokens: a run of the space symbol with what follows it up to the next one. No piece of the vocabulary
holds a space symbol after another character (this is checked), so no merge crosses a pre-token. Pre-tokens that were not
seen before are laid end to end as one array of symbols; in each step every sequence merges its best-scored pair, all at
once. A step that makes a pair which the one-by-one order would have taken first hands that sequence to an exact queue.

Defined results: a null text counts as an empty one (0 tokens); any id is passed through; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
LOOSE = re.compile(f"^ | $|  | \n|{SPACE}").search
BARE = (SPACE, "\n")
CACHED = 1_200_000
AT_ONCE = 500_000
NEVER = np.int32(2**31 - 1)


class RankMerger:
    """Counts of surviving symbols for pre-tokens, under the merges that a scored vocabulary implies."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: the score of each ordinary piece; a pair merges if its concatenation is a piece, best score first."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece holds a space symbol after another character")
        order = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        chars = sorted({c for p in pieces for c in p})
        self.names = [*chars, *(p for p in pieces if len(p) > 1)]
        self.ids = {p: k for k, p in enumerate(self.names)}
        self.chars = {c: self.ids[c] for c in chars}
        size = self.size = len(self.names) + 1  # the last id is any character that no piece has
        merges = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    merges[a * size + b] = (order[score], self.ids[p])
        self.merges = merges
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.ranks = np.array([merges[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.whole = set(pieces)
        self.cache: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        if not len(self.keys):
            return np.full(len(key), NEVER), np.zeros(len(key), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]

    def queue(self, symbols: list[int]) -> int:
        """Surviving symbols by one merge at a time: best score first, then leftmost."""
        n = len(symbols)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self.merges.get(symbols[i] * self.size + symbols[after[i]])):
                heapq.heappush(heap, (m[0], i, m[1], symbols[i], symbols[after[i]], after[i]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, made, a, b, j = heapq.heappop(heap)
            if symbols[i] != a or after[i] != j or symbols[j] != b:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            n -= 1
            offer(before[i])
            offer(i)
        return n

    def survivors(self, words: list[str]) -> np.ndarray:
        """How many symbols are left of each word after all merges."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        table = np.full(int(code.max(initial=0)) + 1, self.size - 1, dtype=np.int32)
        for c, k in self.chars.items():
            if ord(c) < len(table):
                table[ord(c)] = k
        first, out = table[code], lengths.copy()
        symbols, owner = first.copy(), np.repeat(np.arange(len(words)), lengths)
        starts = np.cumsum(lengths) - lengths
        rank, made = self._pairs(symbols, owner)
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(symbols)])
            done = best == NEVER
            if done.any():
                out[owner[heads[done]]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
                heads, best, sizes = None, best[~done], sizes[~done]
                if not len(symbols):
                    break
            here = (rank == np.repeat(best, sizes)) & (rank != NEVER)
            at = np.flatnonzero(here)
            fresh = np.r_[True, np.diff(at) != 1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = at[(np.arange(len(at)) - run_start) % 2 == 0]  # of overlapping pairs the leftmost, then every other
            limit = rank[take]
            symbols[take] = made[take]
            keep = np.ones(len(symbols), dtype=bool)
            keep[take + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            new = place[take]
            self._renew(symbols, owner, rank, made, new)
            left = np.maximum(new - 1, 0)
            self._renew(symbols, owner, rank, made, left)
            several = np.bincount(owner[new], minlength=len(words))[owner[new]] > 1
            early = several & ((rank[new] <= limit) | ((owner[left] == owner[new]) & (left != new) & (rank[left] <= limit)))
            if early.any():
                odd = np.unique(owner[new[early]])
                for w in odd.tolist():
                    out[w] = self.queue(first[starts[w] : starts[w] + lengths[w]].tolist())
                keep = ~np.isin(owner, odd)
                symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
        return out

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), dtype=np.int32)
        if len(symbols) > 1:
            r, m = self.rank(symbols[:-1], symbols[1:])
            rank[:-1], made[:-1] = np.where(owner[:-1] == owner[1:], r, NEVER), m
        return rank, made

    def _renew(self, symbols, owner, rank, made, at) -> None:
        """Recompute the pairs that start at these places."""
        last = at == len(symbols) - 1
        to = np.where(last, at, at + 1)
        r, m = self.rank(symbols[at], symbols[to])
        rank[at], made[at] = np.where(last | (owner[at] != owner[to]), NEVER, r), m

    def learn(self, words: list[str]) -> None:
        """Put the counts of these new words in the cache, a bounded number of characters at a time.

        A word that starts with neither a space symbol nor a line break stood after a single space.
        """
        words.sort(key=len)
        at = 0
        while at < len(words):
            end, chars = at, 0
            while end < len(words) and (end == at or chars + len(words[end]) <= AT_ONCE):
                chars += len(words[end])
                end += 1
            part = [w if w[:1] in BARE else SPACE + w for w in words[at:end]]
            counts = self.survivors(part) + self._bytes_beyond(part)
            self.cache.update(zip(words[at:end], counts.tolist(), strict=True))
            at = end

    def _bytes_beyond(self, words: list[str]) -> np.ndarray:
        """A character that is no piece stands for its UTF-8 bytes: what these add to one symbol each."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
        known[[ord(c) for c in self.chars if c in self.whole and ord(c) < len(known)]] = True
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        return np.bincount(np.repeat(np.arange(len(words)), lengths), np.where(known[code], 0, width - 1), len(words)).astype(np.int64)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a space symbol is put before a text that is not empty."""
        known, out, todo = self.cache, [], set()
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif "\n" in self.chars or LOOSE(text):
                split.append(PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)))
            else:  # single spaces only; no piece has a line break, so nothing merges across one
                split.append(text.replace("\n", " \n").split(" "))
                if text[0] == "\n":
                    split[-1][0] = SPACE
        for words in split:
            todo.update(words)
        new = todo.difference(known)
        if len(known) + len(new) > CACHED:
            known.clear()
            new = todo
        self.learn(list(new))
        for words in split:
            out.append(sum(map(known.__getitem__, words)))
        return out


_mergers: dict[str, RankMerger] = {}


def merger(model_path: str) -> RankMerger:
    """One merger a worker process and model file."""
    if model_path not in _mergers:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ordinary = [k for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        _mergers[model_path] = RankMerger({model.id_to_piece(k): model.get_score(k) for k in ordinary})
    return _mergers[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for whole texts; no shuffle."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = []
            for at in range(0, len(texts), 500):
                counts += model.count(texts[at : at + 500])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(lean(run), schema)
