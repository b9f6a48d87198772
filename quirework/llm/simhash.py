"""SimHash near-duplicates: BK-trees over fingerprints, sharded so that each pair in reach meets in one tree.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 hashes of the text's shingles. Two fingerprints
within `radius` bits agree on at least `blocks - radius` of `blocks` bit blocks; each choice of that many blocks is a
table, and fingerprints equal on the chosen blocks form a shard. Each shard is one BK-tree; a shard above
SHARD distinct fingerprints is split into several trees, each searched by the shard's other members in blocks.
Trees travel by the shuffle to the tasks that search them, as the driver may not hold all documents' fingerprints.
A task keeps only a spanning forest of the links it finds, so a group of near copies costs links in proportion to
its size. `components` joins the forests.

Edge cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; rows repeated in every column are separate rows with equal results; a null id takes part in its
component, whose id is the smallest that is not null; an empty table gives an empty result. Other columns are not
read. `drop_near_copies` needs a deterministic read (a stored table), as it is scanned twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, Union
from .common import BROADCAST_ROWS, kept, materialise, ship, small_or_not, texts_of, without_rows
from .components import components

#: Distinct fingerprints of one tree, at least; a tree of a shard of m has at most max(SHARD, 8 sqrt(m)).
SHARD = 1024
#: Rows that a task gathers before it builds trees.
CHUNK = 1 << 20


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    starts = (ends[: n - words + 1] - np.fromiter(map(len, parts[: n - words + 1]), np.int64, n - words + 1) - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """uid (place in the scan), doc_id, fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        for batch in batches:
            fps = np.array([fingerprint(x, words) for x in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("uid"), batch.column("doc_id"), pa.array(fps)], names=["uid", "doc_id", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, fp long")


def _tables(n: int, radius: int) -> list[int]:
    """Bit masks of the tables: as many chosen bits as keep random shards near a thousand fingerprints or fewer."""
    blocks = radius + 1
    while blocks < radius + 4 and n > 1000 * 2 ** (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    assert len(chosen) == comb(blocks, radius)
    return chosen


def _search(radius: int):
    """Rows (unit, tree, fp), sorted by unit: tree members and queries of one unit stand together."""

    def links(unit: np.ndarray, tree: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fps = fps.view(np.uint64)
        own = np.flatnonzero(tree)
        forest = Forest(unit[own], fps[own])
        first = np.ones(len(own), bool)
        first[1:] = unit[own][1:] != unit[own][:-1]
        roots = np.flatnonzero(first)
        units = unit[own][roots]
        at = np.searchsorted(units, unit)
        asked = np.flatnonzero(units[np.minimum(at, len(units) - 1)] == unit) if len(units) else np.zeros(0, np.int64)
        found = Union(len(fps))
        for q, node in forest.within(fps[asked], roots[at[asked]], radius):
            found.add(asked[q], own[node])
        linked = np.flatnonzero(found.parent != np.arange(len(fps)))
        signed = fps.view(np.int64)
        a, b = signed[linked], signed[found.parent[linked]]
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "tree", "fp")))
            if sum(len(x[0]) for x in held) >= CHUNK:
                unit, tree, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
                if cut:
                    yield links(unit[:cut], tree[:cut], fp[:cut])
                held = [(unit[cut:], tree[cut:], fp[cut:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a stored table (fp), enough to connect all in reach."""
    masks = _tables(fps.count(), radius)
    shards = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("s")).select("fp", "s.t", "s.key")
    large = shards.groupBy("t", "key").count().filter(F.col("count") > SHARD)
    large = materialise(large.withColumn("k", F.ceil(F.col("count") / F.greatest(F.lit(float(SHARD)), 8 * F.sqrt("count")))).select("t", "key", "k"), "large-shards")
    dealt = shards.join(small_or_not(large), ["t", "key"], "left")
    unit = lambda s, q: F.xxhash64("t", "key", s, q)
    whole = dealt.filter("k is null").select(unit(F.lit(0), F.lit(0)).alias("unit"), F.lit(True).alias("tree"), "fp")
    split = dealt.filter("k is not null").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    # member of tree `own` searched by later trees' members, and query of every earlier tree
    trees = split.select("*", F.explode(F.sequence(F.col("own"), F.col("k") - 1)).alias("q")).select(unit(F.col("own"), F.col("q")).alias("unit"), F.lit(True).alias("tree"), "fp")
    asks = split.filter("own > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("s")).select(unit(F.col("s"), F.col("own")).alias("unit"), F.lit(False).alias("tree"), "fp")
    rows = whole.union(trees).union(asks).repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_search(radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """uid, doc_id, fp, label (names the group) and component_id (its smallest id) of every row."""
    narrow = materialise(fingerprints(docs, id_col, text_col, words), "simhashes")
    nodes = materialise(narrow.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp"), radius))
    joined = materialise(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-labels")
    smallest = materialise(joined.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-classes")
    classes = materialise(joined.join(smallest, "label").select("fp", "label", "component_id"), "simhash-components")
    return narrow.join(classes, "fp").select("uid", "doc_id", "fp", "label", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, every column kept, with one row of each group: that with the smallest id (null last, then the first in the scan)."""
    found = materialise(near_groups(docs, id_col, text_col, words, radius), "near-groups")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    kept = materialise(first.select(F.col("first.uid").alias("uid")), "near-kept")
    dropped = materialise(found.select("uid").join(kept, "uid", "left_anti"), "near-dropped")
    return without_rows(docs, dropped, broadcast_rows)
