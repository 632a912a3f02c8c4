"""SimHash near-duplicates by anchor-point covering.

The bits of a fingerprint are cut into blocks. Two fingerprints within ``threshold`` bits agree within ``threshold div blocks``
bits in one block at least (pigeonhole). In each block a covering code of radius 1, a Hamming code on its leading bits times
all values of the rest, gives the anchors: a fingerprint lives at its nearest anchor, and a copy goes to every anchor within
the covering radius plus the block's threshold. A pair within the threshold therefore meets at an anchor, where the distance
is computed. Equal fingerprints are one row, an anchor's matches leave it as a spanning forest, and the homes of a crowded
anchor are dealt over several tiles, each of which sees all copies there: no link is lost and none is sampled.

``near_duplicates`` links 64-bit fingerprints within a number of bits. ``similar`` links texts whose sets of word shingles have
a Jaccard similarity of ``least`` or more. A similarity of 0.8 leaves two of 13 bits different, too many for 64 bits and a sure
threshold; its fingerprints have ``WIDE`` words of 64 bits and many blocks, so that a pair meets at one of their anchors with a
probability that ``meeting`` states: 0.989 at 0.8, 0.9975 at 0.82, 0.9995 at 0.85. Pairs that meet and are near enough in all
bits are compared shingle by shingle, so that nothing else is ever linked. Links that span
what is near are compared first; after that all pairs that meet and are still apart, none left out.

Defined results: a null text has no words; no words give fingerprint zero, which links like any other; texts without words are
similar to each other; a text of fewer words than a shingle is one shingle; a null id never becomes a component's name unless
all its ids are null; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored, or
kept by ``keep_one`` and ``keep_one_similar``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, components, lean, packed_row, portions

BITS = 64
#: Homes at one anchor beyond which they are dealt over tiles.
CROWDED = 4096
#: A list of crowded anchors never has more entries than this: the limit above grows with the input.
MOST_CROWDED = 200_000
#: Pairs compared in one step, and rows held before the anchors that are complete are compared.
PAIRS_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 1 << 18
#: Pairs of homes and copies at an anchor beyond which it is compared home by home, and homes that are compared with all first.
LARGE, PIVOTS = 1 << 18, 64
#: Words of a wide fingerprint, those of them that have anchors and their blocks, the bits in which texts of similarity 0.8 differ at
#: most (but for 6 in a thousand), and those in which pairs that are compared first do.
WIDE, ANCHORED, WIDE_BLOCKS, NEAR, CLOSE = 20, 10, 4, 226, 165
#: Bits of the first two words in which similar texts differ at most (but for one in thirty thousand).
FIRST = 36


def shingles(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; of a short text, of all its words; none without words."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(split)
    if len(split) <= words:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts + lengths - 1)[words - 1 :]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)), dtype=np.uint64, count=len(ends))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of hashes (words of 64 bits): the words whose bits are those that over half of the rows have."""
    total = np.zeros(64 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        part = np.ascontiguousarray(hashes[at : at + 255].astype("<u8", copy=False))
        total += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is set if it is set in over half of the hashes of its word shingles."""
    return int(majority(shingles(text, words, seed)[:, None])[0])


def wide_fingerprint(found: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """A fingerprint of ``wide`` words from a set of hashes: each hash gives as many words by mixing."""
    mixed = found[:, None] + np.arange(1, wide + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(mixed ^ (mixed >> np.uint64(31)))


def meeting(similarity: float, wide: int = WIDE, blocks: int = WIDE_BLOCKS, anchored: int = ANCHORED) -> float:
    """The probability that texts of this similarity have a home in common and are near enough in all bits."""
    from math import acos, comb, pi

    differ = acos(2 * similarity / (1 + similarity)) / pi
    none = 1.0
    for _, _, n in Cover(0, blocks).blocks:
        coded = next(2**m - 1 for m in range(6, 0, -1) if 2**m - 1 <= n)
        ball = coded + 1
        met = sum(comb(coded, d) * differ**d * (1 - differ) ** (coded - d) * w for d, w in ((0, 1.0), (1, 2 / ball), (2, 2 / ball)))
        none *= 1 - met * (1 - differ) ** (n - coded)
    bits = BITS * wide
    return (1 - none**anchored) * sum(comb(bits, d) * differ**d * (1 - differ) ** (bits - d) for d in range(NEAR + 1))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) and ``hash``, of the whole text."""
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), F.xxhash64(docs[text_col].cast("string")).alias("hash")
    )
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], schema.names)

    return rows.mapInArrow(lean(run), schema)


class Cover:
    """A covering code of radius 1 on each block of bits, and the anchors of fingerprints (rows of words of 64 bits)."""

    def __init__(self, threshold: int, blocks: int, words: int = 1):
        self.near = 1 + threshold // (blocks * words)  # covering radius plus the block's threshold
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        self.blocks = [(w, low, high - low) for w in range(words) for low, high in zip(edges, edges[1:], strict=False)]
        self.width = max(n for *_, n in self.blocks)
        self.key_bits = self.width + len(self.blocks).bit_length()
        self.code = [next(2**m - 1 for m in range(6, 0, -1) if 2**m - 1 <= n) for *_, n in self.blocks]
        made = {(n, c): self._masks(n, c) for (*_, n), c in zip(self.blocks, self.code, strict=True)}
        self.masks = [made[n, c] for (*_, n), c in zip(self.blocks, self.code, strict=True)]

    def _masks(self, n: int, coded: int) -> list[np.ndarray]:
        """By syndrome: what to flip in a value to reach each anchor within reach. Bit i of the coded ones has column i+1."""
        found: dict[int, list[int]] = {}

        def grow(first: int, left: int, mask: int, syndrome: int) -> None:
            found.setdefault(syndrome, []).append(mask)
            if left:
                for i in range(first, n):
                    grow(i + 1, left - 1, mask | 1 << i, syndrome ^ (i + 1 if i < coded else 0))

        grow(0, self.near, 0, 0)
        return [np.array(found.get(s, []), dtype=np.int64) for s in range(coded + 1)]

    def values(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By block: its number, the values there, their syndromes."""
        for k, (word, low, n) in enumerate(self.blocks):
            value = ((fps[:, word] >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64)
            syndrome = np.zeros(len(fps), dtype=np.int64)
            for i in range(self.code[k]):
                syndrome ^= np.where(value >> i & 1, i + 1, 0)
            yield k, value, syndrome

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The key of the nearest anchor of each fingerprint in each block: one row a fingerprint."""
        return np.stack([(k << self.width) | np.where(s > 0, v ^ (1 << np.maximum(s - 1, 0)), v) for k, v, s in self.values(fps)], axis=1)

    def copies(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all anchors within reach, and which fingerprint each is for."""
        keys, rows = [], []
        for k, value, syndrome in self.values(fps):
            for s, masks in enumerate(self.masks[k]):
                at = np.flatnonzero(syndrome == s)
                keys.append(((k << self.width) | (value[at, None] ^ masks)).ravel())
                rows.append(np.repeat(at, len(masks)))
        return np.concatenate(keys), np.concatenate(rows)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, for links a[i]-b[i] among n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        apart = label[a] != label[b]
        if not apart.any():
            break
        # hook the larger root below the smaller one
        np.minimum.at(label, np.maximum(label[a[apart]], label[b[apart]]), np.minimum(label[a[apart]], label[b[apart]]))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        a, b = a[apart], b[apart]
    return label


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a[i]-b[i] among n nodes are enough to join what all join (few more than a forest): each part's first link
    to another, again and again."""
    label, open_, chosen = np.arange(n), np.flatnonzero(a != b), [np.zeros(0, dtype=np.int64)]
    while len(open_):
        _, first = np.unique(np.r_[label[a[open_]], label[b[open_]]], return_index=True)
        chosen.append(np.unique(np.r_[open_, open_][first]))
        label = forest(label[a[chosen[-1]]], label[b[chosen[-1]]], n)[label]
        open_ = open_[label[a[open_]] != label[b[open_]]]
    return np.concatenate(chosen)


class Rows:
    """Rows of words, and of sizes if there are any: which two are within a number of bits, and of similar size."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray | None, threshold: int, ratio: float):
        self.bits, self.sizes, self.threshold, self.ratio = bits, sizes, threshold, ratio
        # of many words, two are looked at first
        self.head = np.ascontiguousarray(bits[:, :2]) if bits.shape[1] > 2 else None

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places at which rows ``left`` and ``right`` are near."""
        left, right = np.broadcast_arrays(left, right)
        if self.head is None:
            at = np.flatnonzero(np.bitwise_count(self.bits[left] ^ self.bits[right]).sum(axis=1, dtype=np.int64) <= self.threshold)
        else:
            at = np.flatnonzero(np.bitwise_count(self.head[left] ^ self.head[right]).sum(axis=1, dtype=np.int64) <= FIRST)
            at = at[np.bitwise_count(self.bits[left[at]] ^ self.bits[right[at]]).sum(axis=1, dtype=np.int64) <= self.threshold]
        if self.sizes is not None and len(at):  # no similarity is above the ratio of the sizes
            a, b = self.sizes[left[at]], self.sizes[right[at]]
            at = at[np.minimum(a, b) >= self.ratio * np.maximum(a, b) - 1e-6]
        return at


def _pairs(keys: np.ndarray, home: np.ndarray, at: np.ndarray, rows: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that are near, a home and a copy at one anchor, or two homes where there are no copies; ``at``: the rows with these keys,
    sorted by key, homes first."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    at_home = np.add.reduceat(home.astype(np.int64), starts)
    homes = np.flatnonzero(home)
    group = np.repeat(np.arange(len(starts)), at_home)
    alone = (sizes == at_home)[group]
    counts = np.where(alone, (starts + sizes)[group] - homes - 1, (sizes - at_home)[group])
    first = np.where(alone, homes + 1, (starts + at_home)[group])
    upto, done = np.cumsum(counts), 0
    while done < len(homes):
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS_AT_ONCE, side="right")))
        for low in range(0, int(counts[done]) if end == done + 1 else 1, PAIRS_AT_ONCE) or [0]:
            c = counts[done:end] if end > done + 1 else np.minimum(counts[done:end] - low, PAIRS_AT_ONCE)
            left = np.repeat(homes[done:end], c)
            right = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[done:end], c) + (low if end == done + 1 else 0)
            left, right = at[left], at[right]
            hit = rows.near(left, right)
            yield left[hit], right[hit]
        done = end


def _crowd(h: np.ndarray, c: np.ndarray, rows: Rows, node: np.ndarray, label: np.ndarray, join: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Links within a large group at one anchor, as a row and those it meets: between nodes of different labels only.

    h, c: rows of homes and copies; node: by row; label: by node. With ``join``, labels that are linked become one, and one link of
    each pair of labels is enough: what comes out are real links that span the group. A few homes are compared with all copies;
    after that most nodes have one label, and only what has another is compared with all.
    """

    def meet(row: int, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        others = others[label[node[others]] != label[node[row]]]
        hit = others[rows.near(np.array([row]), others)] if len(others) else others
        if len(hit):
            if join:
                known, at = np.unique(label[node[hit]], return_index=True)
                hit = hit[at]
                known = np.r_[known, label[node[row]]]
                label[np.isin(label, known)] = known.min()
            yield row, hit

    pivots = min(len(h), PIVOTS)
    for k in h[:pivots]:
        yield from meet(k, c)
    _, first, counts = np.unique(label[node[c]], return_index=True, return_counts=True)
    member = node[c[first[counts.argmax()]]]  # of the most frequent label, which may get another name
    for k in c[label[node[c]] != label[member]]:
        yield from meet(k, h)
    for k in h[pivots:]:
        if label[node[k]] != label[member]:
            yield from meet(k, c)


def _match(keys: np.ndarray, home: np.ndarray, rows: Rows, nodes: np.ndarray, roots: np.ndarray | None, once=None) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows, sorted by key with homes first, that span what is linked; or, with ``roots``, all whose roots differ.

    ``once``: of rows that are linked, whether this anchor is the one to say so.
    """
    distinct, node = np.unique(nodes, return_inverse=True)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    at_home = np.add.reduceat(home.astype(np.int64), starts)
    alone = at_home == ends - starts  # no copies: the homes meet each other
    large = at_home * np.where(alone, at_home, ends - starts - at_home) > LARGE
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    place = np.empty(len(keys), dtype=np.int64)
    for g in np.flatnonzero(large):
        s, m, e = starts[g], starts[g] + at_home[g], ends[g]
        local, place[s:e] = np.unique(node[s:e], return_inverse=True)
        if roots is None:
            label = np.arange(len(local))
        else:
            label = np.empty(len(local), dtype=np.int64)
            label[place[s:e]] = np.unique(roots[s:e], return_inverse=True)[1]
        homes = s + np.argsort(place[s:m], kind="stable")  # the same nodes come first at every anchor
        for one, others in _crowd(homes, homes if alone[g] else np.arange(m, e), rows, place, label, roots is None):
            others = others if once is None else others[once(np.full(len(others), one), others)]
            found_a.append(np.full(len(others), node[one]))
            found_b.append(node[others])
    small = np.flatnonzero(np.repeat(~large, ends - starts))
    if len(small):
        for left, right in _pairs(keys[small], home[small], small, rows):
            a, b = node[left], node[right]
            apart = a != b if roots is None else roots[left] != roots[right]
            if once is not None:
                apart[apart] = once(left[apart], right[apart])
            pair = np.unique(np.minimum(a, b)[apart] * len(distinct) + np.maximum(a, b)[apart])
            if roots is None and len(pair):
                names, at = np.unique(np.r_[pair // len(distinct), pair % len(distinct)], return_inverse=True)
                pair = pair[spanning(at[: len(pair)], at[len(pair) :], len(names))]
            found_a.append(pair // len(distinct))
            found_b.append(pair % len(distinct))
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pair = np.unique(np.minimum(a, b) * len(distinct) + np.maximum(a, b))
    return distinct[pair // len(distinct)], distinct[pair % len(distinct)]


def links(distinct: DataFrame, shelf: Shelf, threshold: int = 4, blocks: int = 3, wide: int = 1, near: int | None = None, ratio: float = 0.0, anchored: int = 1, taken: int | None = None) -> DataFrame:
    """Pairs ``src, dst`` of a written table with a row for each fingerprint.

    With the column ``fp`` alone: links that span the fingerprints within the threshold. With ``node`` and ``wide`` (bytes of
    ``wide`` words, the first ``anchored`` with blocks) the pairs are of nodes that meet at an anchor and whose first ``taken`` words (all if not given) are within ``near`` bits and whose sizes ``n`` have ``ratio`` at least; with ``root`` as well, all such pairs of different roots.
    """
    n = distinct.count()
    near = threshold if near is None else near
    cover = Cover(threshold, blocks, anchored)
    width, columns = cover.key_bits, [c for c in ("fp", "node", "n", "root", "wide") if c in distinct.columns]
    rest = [c for c in columns if c != "wide"]
    words = [f"w{k}" for k in range(wide if taken is None else taken)] if "wide" in columns else ["fp"]
    sent = [*words, *(c for c in rest if c != "fp")]  # what goes along to an anchor

    def words_of(batch: pa.RecordBatch) -> np.ndarray:
        if "wide" not in columns:
            return np.asarray(batch.column(0)).view(np.uint64)[:, None].copy()
        return np.frombuffer(b"".join(batch.column(columns.index("wide")).to_pylist()), dtype="<u8").reshape(-1, wide)

    def home_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cover.homes(words_of(batch)).ravel())], ["key"])

    limit = max(CROWDED, -(-n * len(cover.blocks) // MOST_CROWDED))
    fps = distinct.select(*columns)
    crowded = {
        r["key"]: -(-r["count"] // limit)
        for r in fps.mapInArrow(lean(home_keys), "key long").groupBy("key").count().filter(F.col("count") > limit).toLocalIterator()
    }  # MOST_CROWDED entries at most
    heavy = np.array(sorted(crowded), dtype=np.int64)
    tiles = np.array([crowded[k] for k in heavy.tolist()], dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(keys: np.ndarray) -> np.ndarray:
            if not len(heavy):
                return np.ones(len(keys), dtype=np.int64)
            at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
            return np.where(heavy[at] == keys, tiles[at], 1)

        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                whole = words_of(part)
                others = [np.asarray(part.column(columns.index(c))) for c in rest if c != "fp"]
                own_columns = [*np.ascontiguousarray(whole[:, : len(words)].T).view(np.int64), *others]
                home = cover.homes(whole)
                own = np.repeat(np.arange(len(whole)), home.shape[1])
                home = home.ravel()
                if cover.near > 1:
                    keys, row = cover.copies(whole)
                else:  # equal blocks have equal homes: copies are only needed where the homes are dealt over tiles
                    keys, row = home[parts(home) > 1], own[parts(home) > 1]
                many = parts(keys)
                tile = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                keys, row = np.repeat(keys, many), np.repeat(row, many)
                spread = (others[0] if others else own_columns[0]).view(np.uint64)[own]
                home_tile = (spread * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts(home)
                both = np.r_[own, row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[home_tile << width | home, tile << width | keys]), pa.array(np.r_[np.zeros(len(home), np.int8), np.ones(len(keys), np.int8)]), *(pa.array(c[both]) for c in own_columns)],
                    ["key", "copy", *sent],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(last: bool):
            nonlocal held, size
            keys, copy, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            bits, others = np.stack(more[: len(words)], axis=1).view(np.uint64), more[len(words) :]
            once = None if len(others) < 3 else lambda left, right: (cover.homes(bits[left]) == cover.homes(bits[right])).argmax(axis=1) == keys[left] >> cover.width & (1 << cover.key_bits - cover.width) - 1
            a, b = _match(keys, copy == 0, Rows(bits, others[1] if others else None, near, ratio), others[0] if others else more[0], others[2] if len(others) > 2 else None, once)
            if last:
                held, size = [], 0
            else:  # of the key that may go on, its homes stay
                stay = (keys == keys[-1]) & (copy == 0)
                held, size = [tuple(c[stay] for c in (keys, copy, *more))], int(stay.sum())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(np.asarray(c) for c in batch.columns))
                size += batch.num_rows
                if size >= ROWS_AT_ONCE:
                    yield out(False)
        if size:
            yield out(True)

    dealt = fps.mapInArrow(lean(deal), ", ".join(["key long", "copy byte", *(f"{c} long" for c in sent)]))
    pieces = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(pieces, "key").sortWithinPartitions("key", "copy").mapInArrow(lean(compare), "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", blocks: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the internal ``fp, root, hash``; the smallest id names a component.

    Fewer blocks mean more copies (45 a fingerprint for 3, 343 for 2) and fewer rows at an anchor.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    marked = shelf.put(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = shelf.put(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, shelf, threshold, blocks), shelf)
    placed = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    placed = shelf.put(placed, "placed")
    # joined by an expression, so that both sides are shuffled and a large component can be split at run time
    names = placed.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("of"), "component_id")
    named = shelf.put(placed.withColumn("of", F.bitwise_not("root")).join(names, "of").select("fp", "root", "component_id"), "named")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", "hash"
    )


def keep_one(docs: DataFrame, threshold: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group: the one with the smallest id (a null id last)."""
    return one_of_each(docs, near_duplicates(docs, threshold, words, id_col, text_col), id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the row with the smallest id of each ``root`` of ``groups`` (``doc_id, hash, root``)."""
    shelf = Shelf(docs.sparkSession, "keep")
    marks = shelf.put(groups.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("rows")), "marks")
    first = marks.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("hash"), F.col("rows"))).alias("m"))
    keep = shelf.put(first.select(F.col("m.doc_id").alias("id_b"), F.col("m.hash").alias("of_b"), F.col("m.rows").alias("rows")), "keep")
    rows = packed_row(docs, id_a=F.col(f"`{id_col}`"), of_a=F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    on = F.col("id_a").eqNullSafe(F.col("id_b")) & (F.col("of_a") == F.col("of_b"))
    kept = rows.join(keep, on, "left_semi")
    again = keep.filter("rows > 1")
    if not again.isEmpty():
        kept = kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(["id_a", "of_a"]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


# ---- similarity of shingle sets ----


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """Of rows ``doc_id, hash, text``: ``doc_id, hash, node`` (a hash of the shingle set), ``n`` (its size), ``fp`` and ``wide``."""
    from xxhash import xxh64_intdigest

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("hash", "node", "n", "fp")), T.StructField("wide", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 2)):
            found = [np.unique(shingles(t, words)) for t in part.column(2).to_pylist()]
            nodes = np.array([xxh64_intdigest(f.tobytes(), 1) for f in found], dtype=np.uint64).view(np.int64)
            prints = np.array([wide_fingerprint(f) for f in found], dtype="<u8").reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(nodes), pa.array([len(f) for f in found], pa.int64()), pa.array(prints[:, 0].view(np.int64)), pa.array([p.tobytes() for p in prints], pa.binary()),
            ], schema.names)

    return rows.mapInArrow(lean(run), schema)


def _linked(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs ``src, dst`` whose sets are similar enough, shingle by shingle."""
    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in portions(batch, 2, 3)):
            left, right = ([np.unique(shingles(t, words)) for t in part.column(k).to_pylist()] for k in (2, 3))
            near = [similarity(a, b) >= least for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["src", "dst"]).filter(pa.array(near, pa.bool_()))

    a, b = (texts.select(F.col("node").alias(k), F.col("text").alias(f"{k}_text")) for k in ("src", "dst"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "src_text", "dst_text").mapInArrow(lean(equal), "src long, dst long")


def similar(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash`` (of the text) and ``root``, the same for texts that links of this similarity join."""
    shelf = Shelf(docs.sparkSession, "similar")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = shelf.put(_marked(rows, words), "marked")
    sets = shelf.put(marked.groupBy("node").agg(*[F.min(c).alias(c) for c in ("hash", "n", "fp", "wide")]), "sets")
    sure = ANCHORED * WIDE_BLOCKS - 1

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = shelf.put(pairs.distinct(), f"pairs-{name}")
        needed = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
        wanted = sets.join(needed, "node").select("node", "hash")
        texts = shelf.put(rows.select("hash", "text").join(wanted, "hash").groupBy("node").agg(F.min("text").alias("text")), f"texts-{name}")
        return shelf.put(_linked(pairs, texts, words, least), f"links-{name}")

    # most texts are near to no other: only those that are, by two words, take all their words to their anchors
    light = shelf.put(links(sets.select("fp", "node", "n", "wide"), shelf, sure, WIDE_BLOCKS, WIDE, FIRST, least, ANCHORED, 2), "light")
    near = light.select(F.col("src").alias("node")).unionByName(light.select(F.col("dst").alias("node"))).distinct()
    sets = shelf.put(sets.join(near, "node", "left_semi"), "near-sets")
    edges = verified(links(sets.select("fp", "node", "n", "wide"), shelf, sure, WIDE_BLOCKS, WIDE, CLOSE, least, ANCHORED), "closest")
    roots = components(edges, Shelf(docs.sparkSession, "similar-first"))
    placed = shelf.put(sets.join(roots, "node", "left").select("fp", "node", "n", F.coalesce("root", "node").alias("root"), "wide"), "placed")
    more = verified(links(placed, shelf, sure, WIDE_BLOCKS, WIDE, NEAR, least, ANCHORED), "apart")
    roots = components(edges.unionByName(more), Shelf(docs.sparkSession, "similar-all"))
    return marked.select("doc_id", "hash", "node").join(roots, "node", "left").select("doc_id", "hash", F.coalesce("root", "node").alias("root"))


def keep_one_similar(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group of similar texts: the one with the smallest id (a null id last)."""
    return one_of_each(docs, similar(docs, least, words, id_col, text_col), id_col, text_col)
