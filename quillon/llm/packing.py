"""Variable-capacity best-fit packing of token sequences into training rows of several permitted lengths.

Sequences longer than the largest permitted length are cut into pieces of it, which fill rows of their own, and a rest. The
rests are packed best-fit decreasing: each goes to the open bin that it leaves least room in; when none has room, a bin of
the size that costs least for each token it is expected to hold is opened. A row costs something for itself, its tokens and
their attention, so large rows are better if they fill and worse if they don't; how well each size fills is learned from the
pass before, and at last every bin is downsized to the cheapest length that holds its contents. Of all passes, and of the
packings that open one size only or larger, the cheapest wins.

All sequences are numbered (as in ``sharding``) and dealt by number to groups of ``group`` at most, so neither memory nor
result depends on how the input is partitioned. ``build_rows`` makes the rows themselves.

Defined results: a null text has no tokens; every sequence has an end symbol, so it is 1 long at least; any id is passed
through; repeated rows are separate sequences; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf
from .sharding import number_rows

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 5000
PASSES = 4
#: What a row costs for itself, in tokens, and the length at which attention costs as much as all else in a token.
ROW, EVEN = 128, 65_536


def cost(capacity: int) -> float:
    """What a row of this length costs: itself, its tokens, and attention that grows with the square."""
    return ROW + capacity * (1 + capacity / EVEN)


class Room:
    """Open bins by the room that is left: a list of bins for each room, and the rooms that have any in order."""

    def __init__(self, most: int):
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.rooms: list[int] = []

    def take(self, need: int) -> int | None:
        at = bisect_left(self.rooms, need)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        found = self.bins[room].pop()
        if not self.bins[room]:
            del self.rooms[at]
        return found

    def put(self, room: int, bin_: int) -> None:
        if room:
            if not self.bins[room]:
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.bins[room].append(bin_)


def best_fit(lengths: list[int], capacities: tuple[int, ...], choose: Callable[[int, int], int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Bin of each length (these fall) and offset in it; contents, size and first length of the bins. choose: by length and what is left of all."""
    room, bins, offsets, used, sizes, first = Room(capacities[-1]), [], [], [], [], []
    left = sum(lengths)
    for length in lengths:
        left -= length
        k = room.take(length)
        if k is None:
            k = len(used)
            used.append(0)
            first.append(length)
            sizes.append(choose(length, left))
        bins.append(k)
        offsets.append(used[k])
        used[k] += length
        room.put(sizes[k] - used[k], k)
    return bins, offsets, used, sizes, first


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin size of each piece, none longer than the largest capacity."""
    capacities = tuple(sorted(capacities))
    price = {c: cost(c) for c in capacities}
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order].tolist()
    fill = dict.fromkeys(capacities, 1.0)
    best = None

    def cheapest(length: int, left: int) -> int:
        return min((c for c in capacities if c >= length), key=lambda c: price[c] / (length + min(left, fill[c] * (c - length))))

    rules = [cheapest] * PASSES + [lambda length, left, least=least: capacities[bisect_left(capacities, max(length, least))] for least in capacities]
    for rule in rules:
        bins, offsets, used, opened, first = best_fit(falling, capacities, rule)
        sizes = [capacities[bisect_left(capacities, u)] for u in used]  # downsized to the contents
        total = sum(price[s] for s in sizes)
        if best is None or total < best[0]:
            best = total, bins, offsets, sizes
        if rule is cheapest:  # how much of the room beyond the first piece was filled
            for c in capacities:
                room = sum(c - f for o, f in zip(opened, first, strict=True) if o == c)
                if room:
                    fill[c] = sum(u - f for o, u, f in zip(opened, used, first, strict=True) if o == c) / room
    out = np.empty((3, len(lengths)), dtype=np.int64)
    if len(lengths):
        out[:, order] = np.array([best[1], best[2], np.array(best[3])[best[1]]])
    return out[0], out[1], out[2]


def pack_docs(docs: DataFrame, counter: Callable[[DataFrame], DataFrame], capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, bin_id, bin_offset, bin_size, text_hash``.

    ``counter`` counts tokens: of rows ``doc_id, text`` it makes rows ``doc_id, n_tokens``, whatever type the id has.
    """
    shelf = Shelf(docs.sparkSession, "packing")
    text = F.col(f"`{text_col}`").cast("string")
    rows = counter(docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash")).alias("doc_id"), text.alias("text")))
    rows = rows.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.hash").alias("text_hash"), (F.col("n_tokens") + 1).cast("long").alias("length"))
    numbered, n = number_rows(rows, ["doc_id", "text_hash", "length"], shelf)
    groups, most = max(1, -(-n // group)), max(capacities)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("row_").combine_chunks()
        lengths = part["length"].to_numpy()
        pieces = -(-lengths // most)
        row = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = np.minimum(most, lengths[row] - piece * most)
        rests = np.flatnonzero(own < most)
        bins, offsets, sizes = np.empty(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64), np.full(len(row), most)
        bins[rests], offsets[rests], sizes[rests] = pack(own[rests], capacities)
        full, used = np.flatnonzero(own == most), int(bins[rests].max(initial=-1)) + 1
        bins[full] = used + np.arange(len(full))
        bins += part["group_"][0].as_py() << 40
        where = pa.array(row)
        columns = [part["doc_id"].take(where), *map(pa.array, (piece, piece * most, own, bins, offsets, sizes)), part["text_hash"].take(where)]
        return pa.table(columns, names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_size", "text_hash"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece long, start long, length long, bin_id long, bin_offset long, bin_size long, text_hash long"
    return numbered.withColumn("group_", F.col("row_") % groups).groupBy("group_").applyInArrow(run, schema)


def build_rows(packed: DataFrame, tokens: DataFrame, end: int, pad: int) -> DataFrame:
    """The training rows: ``bin_id, bin_size, input_ids`` (padded to the size) and ``starts`` (where its pieces start).

    packed: as ``pack_docs`` gives it; tokens: ``doc_id, text_hash, ids`` of the same tokenizer, one row a text at least.
    """
    ids = tokens.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "ids").dropDuplicates(["id", "hash"])
    own = F.slice(F.concat("ids", F.array(F.lit(end))), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    pieces = packed.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    rows = pieces.select("bin_id", "bin_size", F.struct("bin_offset", own.alias("ids")).alias("p")).groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = F.flatten("p.ids")
    return rows.select("bin_id", "bin_size", F.concat(whole, F.array_repeat(F.lit(pad), (F.col("bin_size") - F.size(whole)).cast("int"))).alias("input_ids"), F.col("p.bin_offset").alias("starts"))
