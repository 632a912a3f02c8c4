"""Katz backoff language model of any order: counts, discounts, weights and scores.

P(w | h) = d(c(hw)) c(hw) / c(h) if the sequence hw was seen in training; else alpha(h) P(w | h') if h was, with h' without its
first word; else P(w | h'). P(w) = d(c(w)) c(w) / N for a known word, and what these leave goes to the one unknown word. d is the
Good-Turing discount of the level for counts up to 5. Above that Katz takes none; here a thousandth of one occurrence is taken,
so that every context keeps some mass. alpha(h) is what the seen sequences leave, over what P(. | h') leaves without their words,
so that P(. | h) sums to one exactly. A text begins with a mark, so its first word has one context only.

Data flow: each task numbers the words of bounded chunks of text and writes the chunks as one row each. At each level, words and
sequences go to hash buckets as packed arrays with their counts in the chunk (pre-aggregated, so a hot one is one entry a chunk);
a bucket holds its part of the count table and answers each chunk with the corpus counts of just what the chunk asked for. The
tables are partitioned by level and bucket, and stay at ``tables`` if a place is given. Chunks then score their texts level by
level and send sums for alpha by context to buckets again, with the contexts they back off from; a bucket works out alpha and
answers by document. Sums are sent only for contexts that a held-out text has, which their buckets have told: a text of the
training part has seen all its sequences and never backs off. The number of buckets follows the number of tokens; nothing but a
few sums of counts reaches the driver. Words and sequences are known by 64-bit hashes, which are not checked for collisions.

Defined results: a null text is an empty one (only the end token); a null id counts as empty text in the training split and
is passed through; repeated rows are separate documents; with nothing to train on the base score is log10(0.1 / 0.1) a token
and the model gives every token probability one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, text_or_empty

CHUNK_BYTES = 10_000_000
KEYS_A_BUCKET = 1_500_000
DISCOUNTED = 5
KEPT_BACK = 0.001
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def packed(values: np.ndarray) -> bytes:
    """An array of unsigned integers as compressed byte planes."""
    import zstandard

    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    mixed = (h ^ (h >> np.uint64(31))) * M1 + w * M2
    return (mixed ^ (mixed >> np.uint64(29))) * M3


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, so that keys in order are in order of buckets."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket and key, the buckets present, and where each starts (and the last ends)."""
    order = np.argsort(keys)
    at = bucket_of(keys[order], buckets)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
    return order, at[starts], np.r_[starts, len(keys)]


class Discounts:
    """Good-Turing discounts from the numbers of types with count 1, 2, ..., 6."""

    def __init__(self, types: list[float]):
        n = [0.0, *types]
        last = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
        self.ratio = np.ones(DISCOUNTED + 1)
        for r in range(1, DISCOUNTED + 1):
            d = (((r + 1) * n[r + 1] / (r * n[r])) - last) / (1 - last) if n[r] and last < 1 else 0.0
            self.ratio[r] = d if 0 < d < 1 else (r - 0.5) / r  # counts too few or uneven for the estimate

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        counts = counts.astype(np.float64)
        low = np.minimum(counts, DISCOUNTED).astype(np.int64)
        return np.where(counts > DISCOUNTED, counts - KEPT_BACK, counts * self.ratio[low])


class Unigrams:
    """Base and backed-off probabilities of words from their counts."""

    def __init__(self, tokens: int, types: int, by_count: list[float]):
        self.tokens, self.types, self.discounts = tokens, types, Discounts(by_count)
        small = np.arange(1, DISCOUNTED + 1)
        kept = float((np.array(by_count[:DISCOUNTED]) * self.discounts.mass(small)).sum())
        above = types - sum(by_count[:DISCOUNTED])
        total_above = tokens - float((np.array(by_count[:DISCOUNTED]) * small).sum())
        self.unknown = 1 - (kept + total_above - KEPT_BACK * above) / tokens if tokens else 1.0

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def katz(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounts.mass(counts) / self.tokens, self.unknown)


def _special(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def chunked(rows: DataFrame) -> DataFrame:
    """Documents (``doc_id, held, text``) as chunks: numbers of words, the words' hashes, their training counts."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType()),
        T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        chunk = TaskContext.get().partitionId() << 24

        def fresh():
            vocabulary: defaultdict = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            vocabulary[b"\n"]  # the end, which is no word, is number 0
            return vocabulary, array("I"), array("i"), [], [], 0

        vocabulary, tokens, lengths, ids, held, size = fresh()

        def out() -> pa.RecordBatch:
            nonlocal chunk
            local = np.frombuffer(tokens, dtype=np.uint32)
            trained = np.repeat(~np.array(held), np.frombuffer(lengths, dtype=np.int32))
            counts = np.bincount(local, weights=trained, minlength=len(vocabulary)).astype(np.int64)
            often = np.argsort(-np.bincount(local, minlength=len(vocabulary)), kind="stable")
            renumbered = np.empty(len(often), dtype=np.uint32)
            renumbered[often] = np.arange(len(often), dtype=np.uint32)
            words = np.fromiter(map(xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))[often]
            chunk += 1
            return pa.RecordBatch.from_arrays([
                pa.array([chunk - 1]), pa.array([pa.concat_arrays(ids).to_pylist()], schema_type[1]), pa.array([held], schema_type[2]), pa.array([lengths.tolist()], schema_type[3]),
                pa.array([packed(renumbered[local])]), pa.array([words.tobytes()]), pa.array([packed(counts[often])]), pa.array([len(local)]),
            ], schema.names)

        schema_type = None
        for batch in batches:
            schema_type = [None, pa.list_(batch.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int32())]
            texts, out_of = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                words = text.encode().lower().split()
                tokens.extend(map(vocabulary.__getitem__, words))
                tokens.append(0)
                lengths.append(len(words) + 1)
                ids.append(batch.column(0).slice(i, 1))
                held.append(out_of[i])
                size += len(text) + 100
                if size >= CHUNK_BYTES:
                    yield out()
                    vocabulary, tokens, lengths, ids, held, size = fresh()
        if lengths:
            yield out()

    return rows.mapInArrow(run, schema)


ASKED = "bucket int, chunk long, keys binary, counts binary, wanted binary"
ANSWERED = "kind int, bucket int, chunk long, counts binary, own binary, wanted binary, stats array<double>, keys binary, totals binary"


def _asks(chunk: int, keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray, buckets: int) -> pd.DataFrame:
    """Sorted keys as differences, with counts and whether a held-out text has them as contexts, by bucket."""
    order, present, starts = dealt(keys, buckets)
    keys, counts, wanted = keys[order], counts[order], wanted[order]
    rows = []
    for b, s, e in zip(present.tolist(), starts, starts[1:], strict=False):
        rows.append((b, chunk, packed(np.diff(keys[s:e], prepend=np.uint64(0))), packed(counts[s:e]), np.packbits(wanted[s:e]).tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts", "wanted"])


def _bits(data: list[bytes], sizes: list[int]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(d, dtype=np.uint8), count=n) for d, n in zip(data, sizes, strict=True)]).astype(bool)


def _table(kind: int, kept: bool):
    """A bucket of a level: adds up its part of the count table and answers each chunk in the order it asked."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in part["keys"]]
        sizes = [len(k) for k in keys]
        inverse, names = pd.factorize(np.concatenate(keys))
        first = np.empty(len(names), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
        del keys
        totals = np.bincount(inverse, weights=np.concatenate([unpacked(c) for c in part["counts"]]).astype(np.float64)).astype(np.int64)
        asked = np.bincount(inverse, weights=_bits(part["wanted"].tolist(), sizes)) > 0
        own = np.zeros(len(inverse), dtype=bool)
        own[first] = True
        answer, wanted = totals[inverse].astype(np.uint64), asked[inverse]
        ends = np.cumsum(sizes)
        seen = totals[totals > 0]
        stats = [float(seen.sum()), float(len(seen)), *np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].astype(float).tolist()]
        rest = [None] * (len(sizes) - 1)
        table = [None, None]
        if kept:
            order = np.argsort(names[totals > 0])
            table = [packed(np.diff(names[totals > 0][order], prepend=np.uint64(0))), packed(seen[order].astype(np.uint64))]
        return pd.DataFrame({
            "kind": kind, "bucket": part["bucket"].to_numpy(), "chunk": part["chunk"].to_numpy(),
            "counts": [packed(answer[e - s : e]) for s, e in zip(sizes, ends, strict=True)],
            "own": [np.packbits(own[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)],
            "wanted": [np.packbits(wanted[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)],
            "stats": [stats, *rest], "keys": [table[0], *rest], "totals": [table[1], *rest],
        })

    return run


def _totals(answers: DataFrame) -> list[float]:
    """Sums over buckets: tokens, types, and types with count 1 to 6."""
    sums = answers.filter("stats is not null").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 3)]).first()
    return [float(x or 0) for x in sums]


class Chunk:
    """One chunk taken apart again: its words, and level by level its sequences."""

    def __init__(self, tokens: bytes, words: bytes, lengths, held):
        self.words = np.frombuffer(words, dtype=np.uint64)
        self.tokens = unpacked(tokens).astype(np.int64)
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.held = np.asarray(held, dtype=bool)
        self.out = np.repeat(self.held, self.lengths)  # by token
        self.starts = np.cumsum(self.lengths) - self.lengths
        # level 1: each word is its own sequence; what a text begins with comes after all words
        self.keys, self.at = np.r_[self.words, np.uint64(_special(b"\t"))], self.tokens
        self.level, self.left, self.right, self.lower = 1, None, None, None

    def deeper(self) -> Chunk:
        """The next level: ``at`` the sequence that ends at each token (-1: none), ``left`` and ``lower`` the sequences of the level
        before without the last and the first word, ``right`` the last word, ``keys``."""
        before = np.r_[0, self.at[:-1]]
        before[self.starts] = len(self.words) if self.level == 1 else -1
        shorter, keys = self.at, self.keys
        there = np.flatnonzero(before >= 0)
        base = len(self.words) + 1
        inverse, named = pd.factorize(before[there] * base + self.tokens[there])
        self.level += 1
        self.left, self.right, self.lower = named // base, named % base, np.empty(len(named), dtype=np.int64)
        self.lower[inverse] = shorter[there]
        self.at = np.full(len(before), -1, dtype=np.int64)
        self.at[there] = inverse
        self.keys = pair_keys(keys[self.left], self.words[self.right] + np.uint64(self.level))
        return self

    def trained(self) -> np.ndarray:
        there = self.at >= 0
        return np.bincount(self.at[there], weights=~self.out[there], minlength=len(self.keys)).astype(np.int64)

    def wanted(self) -> np.ndarray:
        """Which sequences are the context of a token in a held-out text."""
        found = np.zeros(len(self.keys), dtype=bool)
        last = np.zeros(len(self.at), dtype=bool)
        last[self.starts + self.lengths - 1] = True
        found[self.at[self.out & ~last & (self.at >= 0)]] = True
        return found


def _in_order(keys: np.ndarray, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, ownership and wantedness back in the order of the chunk."""
    order, _, starts = dealt(keys, buckets)
    answers = answers.sort_values("bucket")
    counts, own, wanted = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
    if not len(keys):
        return counts, own, wanted
    sizes = np.diff(starts).tolist()
    counts[order] = np.concatenate([unpacked(c) for c in answers["counts"]]).astype(np.int64)
    own[order], wanted[order] = (_bits(answers[c].tolist(), sizes) for c in ("own", "wanted"))
    return counts, own, wanted


def score(docs: DataFrame, held_one_in: int = 10, order: int = 3, id_col: str = "doc_id", text_col: str = "text", tables: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    ``tables``: where the count tables stay as ``level=k/bucket=b`` (packed keys as differences, and counts).
    """
    if order < 2:
        raise ValueError("a model that backs off has order 2 at least")
    spark = docs.sparkSession
    shelf = Shelf(spark, "katz")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.crc32(name.cast("binary")) % held_one_in == 0).alias("held"), text_or_empty(text_col).alias("text"))
    chunks = shelf.put(chunked(rows), "chunks")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // KEYS_A_BUCKET))

    def asking(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    c = Chunk(r.tokens, r.words, r.lengths, r.held)
                    if level == 1:
                        yield _asks(r.chunk, c.words, unpacked(r.counts), np.zeros(len(c.words), dtype=bool), buckets)
                    else:
                        for _ in range(level - 1):
                            c.deeper()
                        yield _asks(r.chunk, c.keys, c.trained(), c.wanted(), buckets)

        return run

    answers, known_stats = [], []
    for level in range(1, order + 1):
        asked = chunks.select("chunk", "tokens", "words", "lengths", "held", "counts").mapInPandas(asking(level), ASKED)
        found = shelf.put(asked.groupBy("bucket").applyInPandas(_table(level, tables is not None), ANSWERED), f"level-{level}")
        if tables is not None:
            found.filter("keys is not null").select(F.lit(level).alias("level"), "bucket", "keys", "totals").write.mode("append").partitionBy("level", "bucket").parquet(tables)
        known_stats.append(_totals(found))
        answers.append(found.select("kind", "bucket", "chunk", "counts", "own", "wanted"))
    n, v, *by_count = known_stats[0]
    unigrams = Unigrams(int(n), int(v), by_count)
    discounts = [None, *(Discounts(t[2:]) for t in known_stats[1:])]
    document = f"ids array<{id_type}>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>"
    scored_schema = f"chunk long, bucket int, keys binary, total binary, mass binary, seen binary, doc binary, times binary, {document}"
    columns = [c.split()[0] for c in scored_schema.split(", ")]

    def score_chunk(key, chunk: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        r = chunk.iloc[0]
        c = Chunk(r["tokens"], r["words"], r["lengths"], r["held"])
        texts = len(c.lengths)
        text_of = np.repeat(np.arange(texts), c.lengths)
        known, _, _ = _in_order(c.words, found[found["kind"] == 1], buckets)
        end = int(np.flatnonzero(c.words == np.uint64(_special(b"\n")))[0])
        p = unigrams.katz(known)
        count, wanted = np.r_[known, known[end]], np.ones(len(known) + 1, dtype=bool)  # as many texts begin as end
        lower_p, lower_keys = np.r_[p, 1.0], c.keys
        logs = np.log10(p)[c.tokens]  # by token: the score from the levels so far
        sums, asks = [], []
        for level in range(2, order + 1):
            context_count, context_wanted = count, wanted
            c.deeper()
            count, own, wanted = _in_order(c.keys, found[found["kind"] == level], buckets)
            mass, seen = discounts[level - 1].mass(count), count > 0
            own_p = np.where(seen, mass, 0.0) / np.maximum(context_count[c.left], 1)
            # sums for alpha of each context that is wanted, of the sequences that this chunk speaks for
            mine = np.flatnonzero(own & seen & context_wanted[c.left])
            at, inverse = np.unique(c.left[mine], return_inverse=True)
            total = [np.bincount(inverse, weights=x[mine], minlength=len(at)) for x in (mass, lower_p[c.lower])]
            sums.append((lower_keys[at], context_count[at].astype(np.float64), *total))
            # by token: seen here, or left to the level before, at the price of alpha where the context is known
            there = c.at >= 0
            fits = np.zeros(len(c.at), dtype=bool)
            fits[there] = seen[c.at[there]]
            logs[fits] = np.log10(own_p[c.at[fits]])
            off = np.flatnonzero(there & ~fits)
            off = off[context_count[c.left[c.at[off]]] > 0]
            asks = [(k[~fits[x]], x[~fits[x]]) for k, x in asks]  # what is seen at a higher level backs off no more
            asks.append((lower_keys[c.left[c.at[off]]], off))
            lower_p, lower_keys = own_p, c.keys
        out = []

        def deal(keys: np.ndarray, values: dict[str, np.ndarray]) -> None:
            order_, present, starts = dealt(keys, buckets)
            for b, s, e in zip(present.tolist(), starts, starts[1:], strict=False):
                part = order_[s:e]
                out.append({"bucket": b, "keys": keys[part].tobytes(), **{k: x[part].tobytes() for k, x in values.items()}})

        deal(np.concatenate([x[0] for x in sums]), dict(zip(("total", "mass", "seen"), (np.concatenate([x[k] for x in sums]) for k in (1, 2, 3)), strict=True)))
        wanted_keys, where = np.concatenate([k for k, _ in asks]), np.concatenate([x for _, x in asks])
        # one ask for each text and context
        names, inverse = np.unique(wanted_keys, return_inverse=True)
        pairs, times = np.unique(text_of[where] * max(1, len(names)) + inverse, return_counts=True)
        deal(names[pairs % max(1, len(names))] if len(names) else names, {"doc": pairs // max(1, len(names)), "times": times.astype(np.int64)})

        def by_text(values: np.ndarray) -> list:
            return np.bincount(text_of, weights=values, minlength=texts).tolist()

        out.append({
            "ids": list(r["ids"]), "held": c.held, "n_tokens": c.lengths, "n_known": np.bincount(text_of, weights=known[c.tokens] > 0, minlength=texts).astype(np.int64),
            "base": by_text(unigrams.base(known)[c.tokens]), "score": by_text(logs),
        })
        result = pd.DataFrame(out).reindex(columns=columns)
        result["chunk"] = key[0]
        result["bucket"] = result["bucket"].fillna(-1).astype(int)
        return result.astype(object).where(result.notna(), None)

    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    scored = shelf.put(
        chunks.select("chunk", "tokens", "words", "lengths", "held", "ids").groupBy("chunk").cogroup(every.groupBy("chunk")).applyInPandas(score_chunk, scored_schema), "scored"
    )
    shelf.drop("chunks", *(f"level-{k}" for k in range(1, order + 1)))

    def weigh(part: pd.DataFrame) -> pd.DataFrame:
        sums, asked = part[part["total"].notna()], part[part["doc"].notna()]
        if not len(asked):
            return pd.DataFrame({"chunk": pd.Series(dtype="int64"), "doc": pd.Series(dtype="object"), "extra": pd.Series(dtype="object")})
        joined = lambda rows, name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in rows[name]]) if len(rows) else np.zeros(0, dtype=kind)
        contexts, inverse = np.unique(joined(sums, "keys", np.uint64), return_inverse=True)
        total = np.zeros(len(contexts))
        total[inverse] = joined(sums, "total", np.float64)
        mass, seen = (np.bincount(inverse, weights=joined(sums, x, np.float64), minlength=len(contexts)) for x in ("mass", "seen"))
        alpha = np.r_[(1 - mass / np.maximum(total, 1)) / np.maximum(1 - seen, 1e-15), 1.0]
        wanted = joined(asked, "keys", np.uint64)
        at = np.minimum(np.searchsorted(contexts, wanted), max(0, len(contexts) - 1))
        at = np.where(contexts[at] == wanted, at, len(contexts)) if len(contexts) else np.zeros(len(wanted), dtype=np.int64)
        extra = np.log10(alpha[at]) * joined(asked, "times", np.int64)
        doc = [np.frombuffer(x, dtype=np.int64) for x in asked["doc"]]
        ends = np.cumsum([len(x) for x in doc])
        return pd.DataFrame({"chunk": asked["chunk"].to_numpy(), "doc": doc, "extra": np.split(extra, ends[:-1])})

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        sums = np.bincount(np.concatenate(part["doc"].to_list()).astype(np.int64), weights=np.concatenate(part["extra"].to_list()))
        at = np.flatnonzero(sums)
        return pd.DataFrame({"chunk": part["chunk"].iloc[0], "doc": at, "extra": sums[at]})

    weights = (
        scored.filter("bucket >= 0").select("bucket", "chunk", "keys", "total", "mass", "seen", "doc", "times").groupBy("bucket")
        .applyInPandas(weigh, "chunk long, doc array<long>, extra array<double>").groupBy("chunk").applyInPandas(gather, "chunk long, doc long, extra double")
    )
    texts = scored.filter("bucket < 0").select("chunk", F.posexplode(F.arrays_zip("ids", "held", "n_tokens", "n_known", "base", "score")).alias("doc", "d"))
    return texts.withColumn("doc", F.col("doc").cast("long")).join(weights, ["chunk", "doc"], "left").select(
        F.col("d.ids").alias("doc_id"), F.col("d.held").alias("held_out"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.n_known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), F.col("d.base").alias("base_score"), (F.col("d.score") + F.coalesce("extra", F.lit(0.0))).alias("score"),
    )
