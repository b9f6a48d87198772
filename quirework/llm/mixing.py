"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in an order by a hash of id and text, form a stream of words, cut in blocks. A source's target
gives whole passes over its blocks and an exact quota of a further pass; the quotas of all sources are split among
output shards by a tree: a node splits its shards in halves and draws how many blocks of each source the left half gets
from the multivariate hypergeometric distribution. A leaf's counts name disjoint ranges of each source's draws, and draws
are the blocks in a keyed pseudo-random permutation. Shards are shuffled locally, by a keyed hash.

The order of documents depends on their ids and texts alone, so reruns agree whatever the files or the cluster: rows are
dealt by ranges of that order, so no source, id or text is ever in one task, and summed range by range. Only one row a
source and the tree's leaves (at most MAX_SHARDS rows, MAX_LEAVES numbers) are on the driver.

Edge cases: null and empty texts have size 0 and are not taken; a null source is a source of its own, last in the order;
sources without words have target 0; rows of one id are separate documents, those of equal id and text in the order of
the scan; null ids are ordered by their texts; an empty table gives an empty result; other columns are not read.
`mixed_texts` needs a deterministic read (a stored table), as it is scanned twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, fresh, kept, materialise, partitions, ship, small_or_not, texts_of

#: Words of a block, at least; blocks grow so that there are at most MAX_BLOCKS of them.
BLOCK_WORDS, MAX_BLOCKS = 2048, 1 << 28
#: Words of an output shard, at least; shards grow so that there are at most MAX_SHARDS of them.
SHARD_WORDS, MAX_SHARDS = 1 << 21, 1 << 14
#: Numbers in the tree's leaves (shards times sources) that go with every task, at most.
MAX_LEAVES = 1 << 22
SEED = 20_240_601
_WORD = re.compile(b"[^" + re.escape(WHITE) + b"]+")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words of each source: `share` of all sizes by weight, none above `most` times its own size; the excess is shared
    anew by weight among the others until none is above."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds, walked on until a value is below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            h = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards + 1, sources): before each shard, how many draws of each source the shards before it have."""
    whole, counts = sum(quotas), np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            counts[low] = own
            continue
        middle = (low + high) // 2
        size = middle * whole // shards - low * whole // shards
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(own, size, method="marginals")
        todo += [(low, middle, left), (middle, high, own - left)]
    return np.concatenate((np.zeros((1, len(quotas)), np.int64), counts.cumsum(axis=0)))


@dataclass
class Source:
    """What the mix takes of one source."""

    size: int
    target: float
    blocks: int
    #: Whole passes, then draws of a further pass, the last of which has only `last` words.
    passes: int
    draws: int
    last: int


class Plan:
    """Quotas, permutation keys and the tree's leaves; small enough to go with every task."""

    def __init__(self, sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float, seed: int):
        ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        self.seed = seed
        self.names = [s for s, _ in ordered]
        self.code = {s: i for i, s in enumerate(self.names)}
        words = [n for _, n in ordered]
        wanted = targets(words, [weights[i % len(weights)] for i in range(len(words))], share, most)
        total = sum(words)
        self.block = max(BLOCK_WORDS, -(-int(total * max(1.0, share)) // MAX_BLOCKS))
        self.sources = [self._source(i, n, t) for i, (n, t) in enumerate(zip(words, wanted, strict=True))]
        self.shards = max(1, min(MAX_SHARDS, -(-int(total * share) // SHARD_WORDS), MAX_LEAVES // max(1, len(words))))
        self.leaves = splitting_tree([s.passes * s.blocks + s.draws for s in self.sources], self.shards, seed)

    def key(self, source: int, turn: int) -> int:
        return (self.seed * 1_000_003 + source * 8_191 + turn) * 0x9E3779B97F4A7C15 % (1 << 64)

    def _source(self, code: int, size: int, target: float) -> Source:
        blocks, wanted = -(-size // self.block), round(target)
        passes = wanted // size if size else 0
        rest, draws, last = (wanted - passes * size if size else 0), 0, 0
        if rest:
            short = blocks * self.block - size  # what the last block lacks
            at = int(permute(np.array([blocks - 1]), blocks, self.key(code, passes))[0])
            words = lambda r: r * self.block - (short if r > at else 0)
            draws = -(-rest // self.block)
            draws += words(draws) < rest
            last = rest - words(draws - 1)
        return Source(size, target, blocks, passes, draws, last)

    def pieces(self, code: int, start: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
        """The pieces of documents of a source, which begin at `start` in its stream: row, turn, first word, words,
        draw, shard."""
        own, out = self.sources[code], []
        first = start // self.block
        n = np.where(size > 0, (start + size - 1) // self.block - first + 1, 0)
        row = np.repeat(np.arange(len(start)), n)
        block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        low = np.maximum(start[row], block * self.block)
        high = np.minimum(start[row] + size[row], (block + 1) * self.block)
        for turn in range(own.passes + (own.draws > 0)):
            rank = permute(block, own.blocks, self.key(code, turn))
            stop = high
            if turn == own.passes:
                stop = np.where(rank == own.draws - 1, np.minimum(high, block * self.block + own.last), high)
                stop = np.where(rank < own.draws, stop, low)
            took = np.flatnonzero(stop > low)
            draw = turn * own.blocks + rank[took]
            shard = np.searchsorted(self.leaves[1:, code], draw, side="right")
            out.append((row[took], np.full(len(took), turn), (low - start[row])[took], (stop - low)[took], draw, shard))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return dict(zip(("row", "turn", "first_word", "n_words", "draw", "shard"), joined, strict=True))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("mixing")
    for batch in batches:
        n = [len(x.split()) for x in texts_of(batch.column("text"))]
        yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "source", "h")), pa.array(n, pa.int64())], names=["uid", "doc_id", "source", "h", "size"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with the number of their range, and the words of their source before them in the range."""
    kept("mixing")
    part, sums = TaskContext.get().partitionId(), {}
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        codes = batch.column("source").dictionary_encode()
        names, code = [*codes.dictionary.to_pylist(), None], codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
        before = np.zeros(len(sizes), np.int64)
        for c in np.unique(code).tolist():
            of = np.flatnonzero(code == c)
            upto = np.cumsum(sizes[of])
            before[of] = sums.get(names[c], 0) + upto - sizes[of]
            sums[names[c]] = sums.get(names[c], 0) + int(upto[-1])
        yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "source", "size")), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before)], names=["uid", "doc_id", "source", "size", "part", "before"])


def _pieces(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([plan.code[s] for s in batch.column("source").to_pylist()], np.int64)
            start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "size"))
            for code in np.unique(codes).tolist():
                of = np.flatnonzero(codes == code)
                found = plan.pieces(code, start[of], size[of])
                rows = pa.array(of[found["row"]])
                numbers = [pa.array(found[c].astype(np.int64)) for c in ("turn", "first_word", "n_words", "draw", "shard")]
                yield pa.record_batch([batch.column("uid").take(rows), batch.column("doc_id").take(rows), batch.column("source").take(rows), *numbers], names=["uid", "doc_id", "source", "turn", "first_word", "n_words", "draw", "shard"])

    return run


@dataclass
class Mix:
    """The plan of a mix, its documents (uid, doc_id, source, size, start) and its pieces."""

    plan: Plan
    documents: DataFrame
    pieces: DataFrame

    def table(self) -> DataFrame:
        """The mix: shard and position, and the words of which document stand there."""
        order = Window.partitionBy("shard").orderBy(local_order(self.plan.seed, "shard", "source", "draw", "doc_id", "first_word"), "uid", "turn")
        return self.pieces.withColumn("position", F.row_number().over(order) - 1)

    def taken(self) -> DataFrame:
        """For every document: uid, doc_id, size, source_size, target, taken, and the first place in the mix."""
        spark = self.documents.sparkSession
        known = small_or_not(spark.createDataFrame([(s, o.size, o.target) for s, o in zip(self.plan.names, self.plan.sources, strict=True)], "name string, source_size long, target double"))
        took = self.table().groupBy("uid").agg(F.sum("n_words").alias("taken"), F.min(F.struct("shard", "position")).alias("first"))
        rows = self.documents.join(took, "uid", "left").join(known, F.col("source").eqNullSafe(F.col("name")))
        return rows.select("uid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.col("first.shard").alias("first_shard"), F.col("first.position").alias("first_position"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix docs: `share` of all words, by repeating weights over the sources in the order of their code points."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = named.withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)))
    sized = materialise(rows.mapInArrow(_sizes, "uid long, doc_id long, source string, h long, size long"), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
    plan = Plan([(r.source, r["size"]) for r in sources], weights, share, most, seed)
    order = ["source", "h", "doc_id", "size", "uid"]
    dealt = sized.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = materialise(dealt.mapInArrow(_ranges, "uid long, doc_id long, source string, size long, part int, before long"), "mix-ranges")
    # a row for each range and source in it: ranges follow each other, so there are at most ranges plus sources
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    base = small_or_not(materialise(sums.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")).alias("base")), "mix-bases"))
    documents = ranged.join(base, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).select("uid", "doc_id", "source", "size", (F.col("base") + F.col("before")).alias("start"))
    pieces = documents.mapInArrow(_pieces(plan), "uid long, doc_id long, source string, turn long, first_word long, n_words long, draw long, shard long")
    return Mix(plan, documents, pieces)


def cut_words(text: bytes, first: int, n: int) -> bytes:
    """Words first to first + n - 1 of a text as they stand in it; the whole text where they are all of its words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return text if n >= len(spans) else text[spans[first][0] : spans[first + n - 1][1]]


def local_order(seed: int, *columns: str):
    """The keyed hash by which a shard is shuffled."""
    return F.xxhash64(F.lit(seed), *columns)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str = "shard", position_col: str = "position", **options) -> DataFrame:
    """docs as mixed, every column kept: one row for each run of a document's words that one shard takes in one pass, with
    text_col cut to it, and the shard and the place in it (from 0) behind the columns. Rows of a shard stand together in
    the order of their places. A run is made of the blocks that the tree gave to the shard; neighbouring blocks of one
    shard and pass are one run, in the place of the first of them. A document that a shard takes whole keeps its text as
    it is. The columns of docs may not be named shard_col or position_col."""
    taken = {c.lower() for c in docs.columns}
    if {shard_col.lower(), position_col.lower()} & taken:
        raise ValueError("name the shard and the position otherwise: docs has such a column")
    own = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    at, pieces, place = fresh(docs, "__uid"), fresh(docs, "__pieces"), fresh(docs, "__place")
    piece = F.struct("turn", "first_word", "n_words", "shard", local_order(own.plan.seed, "shard", "source", "draw", "doc_id", "first_word").alias("place"))
    runs = own.pieces.groupBy("uid").agg(F.array_sort(F.collect_list(piece)).alias(pieces)).withColumnRenamed("uid", at)
    joined = docs.withColumn(at, F.monotonically_increasing_id()).join(runs, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("mixing")
        for batch in batches:
            texts, rows, cut, shards, places = texts_of(batch.column(text_col)), [], [], [], []
            for i, taken in enumerate(batch.column(pieces).to_pylist()):
                merged: list[list[int]] = []
                for p in taken:
                    if merged and merged[-1][0] == p["turn"] and merged[-1][3] == p["shard"] and merged[-1][1] + merged[-1][2] == p["first_word"]:
                        merged[-1][2] += p["n_words"]
                    else:
                        merged.append([p["turn"], p["first_word"], p["n_words"], p["shard"], p["place"]])
                for _, first, n, shard, order in merged:
                    rows.append(i)
                    cut.append(cut_words(texts[i], first, n))
                    shards.append(shard)
                    places.append(order)
            mixed = batch.take(pa.array(rows, pa.int64()))
            where = mixed.schema.get_field_index(text_col)
            columns = mixed.columns
            columns[where] = pa.array(cut, pa.binary()).cast(mixed.schema.field(where).type)
            rest = [(c, f) for c, f in zip(columns, mixed.schema, strict=True) if f.name != pieces]
            yield pa.record_batch([*(c for c, _ in rest), pa.array(shards, pa.int64()), pa.array(places, pa.int64())], names=[*(f.name for _, f in rest), shard_col, place])

    kinds = docs.select("*", F.lit(0).cast("long").alias(at)).schema
    for name in (shard_col, place):
        kinds = kinds.add(name, "long")
    # about a shard a partition, however many there are; the repartitioning and the sort serve the window and stay where a
    # caller drops the position
    dealt = joined.select(*docs.columns, at, pieces).mapInArrow(run, kinds).repartition(own.plan.shards, shard_col).sortWithinPartitions(shard_col, place, at)
    local = Window.partitionBy(shard_col).orderBy(place, at)
    return dealt.withColumn(position_col, F.row_number().over(local) - 1).drop(at, place)
