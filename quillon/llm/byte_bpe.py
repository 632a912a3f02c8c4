"""Byte-level BPE by backtracking over longest matches.

Bytes are read as Latin-1 characters, so one Aho-Corasick automaton over the vocabulary finds every token at every place.
A sequence of tokens is the one that the merges give exactly if each two neighbours are: their joined bytes encode to these
two. The walk takes the longest token that is compatible with the one before it, goes back where none is, and never tries a
place twice; compatibility is memoised, so the time is linear in the text.

Defined results: a null text is an empty one (no ids); any id column is passed through; repeated rows give repeated results;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHED = 400_000
NONE = 1 << 60
#: Fixed value: the pattern for which the split at single spaces holds.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOSE_SPACE = re.compile(r"^ | $|\s | \s").search


class ByteBpe:
    """Encoder and decoder for a table of token bytes to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.bytes_of = ranks, {k: t for t, k in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.sizes = {k: len(t) for t, k in ranks.items()}
        self.singles = [ranks[bytes([b])] for b in range(256)]
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.cache: dict[str, tuple[str, bytes]] = {}  # of what stands between two single spaces, with the first of them
        self.spaced = pattern == SPACE_LED
        self.automaton = ahocorasick.Automaton()
        for token, k in ranks.items():
            if len(token) > 1 and self.merge(token) == [k]:  # a token that merges never reach takes no part
                self.automaton.add_word(token.decode("latin-1"), k)
        self.automaton.make_automaton()

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the pair of least rank, leftmost first, until none is left. For short pieces."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        pairs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave these two neighbours as they are; memoised."""
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > CACHED:
                self.fits.clear()
            found = self.fits[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        quick = self.greedy(piece)
        if quick is not None:
            return quick
        n, fits, compatible, sizes = len(piece), self.fits, self.compatible, self.sizes
        longer: dict[int, list[int]] = {}  # by place: tokens of two bytes or more, the longest last
        for end, k in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - sizes[k]
            if start in longer:
                longer[start].append(k)
            else:
                longer[start] = [k]
        dead: set[int] = set()  # places from which no compatible rest was found
        path: list[int] = []
        left: list[int] = []  # by step of the path: how many shorter tokens are untried there
        place, last, untried = 0, -1, None
        singles = self.singles
        while place < n:
            options = longer.get(place, ())
            i = len(options) if untried is None else untried
            while i >= 0:  # option 0 is the single byte
                k = options[i - 1] if i else singles[piece[place]]
                i -= 1
                end = place + sizes[k]
                if end not in dead and (last < 0 or fits.get(last << 32 | k) or compatible(last, k)):
                    path.append(k)
                    left.append(i)
                    place, last, untried = end, k, None
                    break
            else:
                dead.add(place)
                place -= sizes[path.pop()]
                untried = left.pop()
                last = path[-1] if path else -1
        return path

    def greedy(self, piece: bytes) -> list[int] | None:
        """The longest token at each place in turn, if every two neighbours are compatible."""
        path, place, last, fits, sizes = [], 0, -1, self.fits, self.sizes
        for end, k in self.automaton.iter_long(piece.decode("latin-1")):
            start = end + 1 - sizes[k]
            for b in piece[place:start]:
                single = self.singles[b]
                if last >= 0 and not (fits.get(last << 32 | single) or self.compatible(last, single)):
                    return None
                path.append(single)
                last = single
            if last >= 0 and not (fits.get(last << 32 | k) or self.compatible(last, k)):
                return None
            path.append(k)
            last, place = k, end + 1
        for b in piece[place:]:
            single = self.singles[b]
            if last >= 0 and not self.compatible(last, single):
                return None
            path.append(single)
            last = single
        return path

    def piece(self, word: str) -> tuple[str, bytes]:
        """The ids of one pre-token in decimal, and the bytes they decode to; memoised."""
        found = self.pieces.get(word)
        if found is None:
            if len(self.pieces) > CACHED:
                self.pieces.clear()
            ids = self.encode_piece(word.encode())
            found = self.pieces[word] = " ".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        return found

    def chunk(self, text: str) -> tuple[str, bytes]:
        """The same of a stretch of text that no match of the pattern crosses."""
        found = [self.piece(w) for w in self.split(text)]
        return " ".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids in decimal, digest of the bytes that the ids decode to."""
        if not text:
            none = hashlib.sha256(b"").hexdigest()
            return 0, none, none
        if self.spaced and not LOOSE_SPACE(text):
            # a space between two characters that are no white space starts a match, which ends before the next one
            parts = text.split(" ")
            known = self.cache
            new = set(parts[1:]).difference(known)
            if len(known) + len(new) > CACHED:
                known.clear()
                new = set(parts[1:])
            for p in new:
                known[p] = self.chunk(f" {p}")
            found = [self.chunk(parts[0]), *map(known.__getitem__, parts[1:])]
        else:
            found = [self.chunk(text)]
        ids = " ".join([f[0] for f in found])
        back = b"".join([f[1] for f in found])
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    def encode(self, text: str) -> list[int]:
        return [k for w in self.split(text) for k in self.encode_piece(w.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_encoders: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder a worker process and vocabulary file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _encoders[path, pattern]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text."""
    rows = _rows(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, pattern)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes every whole text, decodes the ids; no shuffle."""
    rows = _rows(docs, id_col, text_col)
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path, pattern)
        for batch in batches:
            found = [model.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
