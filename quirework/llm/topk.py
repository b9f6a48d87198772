"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging of top lists.

Vectors are turned to integers, packed in tiles and stored; every shard of candidate tiles meets every group of query
tiles in one task, which multiplies tile by tile and keeps a top list per query and tile, then per query. The lists of a
query's shards are merged FAN at a time until one is left. Products are exact: doubles while sums stay under 2^53,
64-bit integers under 2^63, unbounded integers beyond (scores that do not fit a long are set to its limits; a component
whose scaled value is beyond a double's range counts as the largest double). Tiles, shards and groups are bounded in
bytes, so a task's memory does not grow with the number of components; tiles keep their narrow integers and are widened
one at a time.

Edge cases: rows with a null id, a null vector, or null or non-finite components take no part; vectors meet only
vectors of as many components; rows of one id are separate rows (each a query, each a candidate of the others); equal
scores go to the smaller id, then to the first in the scan; a query without candidates has no rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, materialise, ship

#: Vectors of a tile, and its bytes as doubles, at most (a tile holds one vector at least).
TILE, TILE_BYTES = 2048, 1 << 25
#: Queries that are multiplied together with a tile.
BLOCK = 512
#: Packed bytes of the candidates of a shard and of the queries of a group, about.
SHARD_BYTES, GROUP_BYTES = 1 << 26, 1 << 25
#: Top lists that are merged at a time.
FAN = 16
_TILE_SCHEMA = "dim int, n int, kind string, ids binary, uids binary, body binary"
_LONG = np.iinfo(np.int64)


def _pack(scale: float, tile: int):
    def most(dim: int) -> int:
        return max(1, min(tile, TILE_BYTES // (8 * max(1, dim))))

    def tiles(dim: int, ids: np.ndarray, uids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), most(dim)):
            part = rows[at : at + most(dim)]
            top = float(np.abs(part).max(initial=0))
            kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8" if top < 1 << 62 else "<f8"  # whole doubles
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([kind]), pa.array([ids[at : at + len(part)].tobytes()], pa.binary()), pa.array([uids[at : at + len(part)].tobytes()], pa.binary()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["dim", "n", "kind", "ids", "uids", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("topk")
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ok = batch.filter(pc.and_(batch.column("id").is_valid(), batch.column("vector").is_valid()))
            ids, uids = ok.column("id").to_numpy(zero_copy_only=False).astype(np.int64), ok.column("uid").to_numpy(zero_copy_only=False)
            vectors = ok.column("vector")
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                rows = flat[(ends[of] - dim)[:, None] + np.arange(dim)].reshape(len(of), dim)
                fine = np.isfinite(rows).all(axis=1)
                with np.errstate(over="ignore"):
                    scaled = np.clip(np.floor(scale * rows[fine]), np.finfo(float).min, np.finfo(float).max)
                held.setdefault(dim, []).append((ids[of][fine], uids[of][fine], scaled))
                if sum(len(x[0]) for x in held[dim]) >= most(dim):
                    yield from tiles(dim, *(np.concatenate(x) for x in zip(*held.pop(dim), strict=True)))
        for dim, parts in held.items():
            yield from tiles(dim, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _queries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                of = np.flatnonzero(ids % every == 0)
                if len(of):
                    body = np.frombuffer(r["body"], r["kind"]).reshape(r["n"], r["dim"])[of]
                    yield pa.record_batch([pa.array([r["dim"]], pa.int32()), pa.array([len(of)], pa.int32()), pa.array([r["kind"]]), pa.array([ids[of].tobytes()], pa.binary()), pa.array([np.frombuffer(r["uids"], np.int64)[of].tobytes()], pa.binary()), pa.array([body.tobytes()], pa.binary())], names=["dim", "n", "kind", "ids", "uids", "body"])

    return run


def _unpack(table: pa.Table) -> dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Tiles by dimension: ids, uids and the matrix."""
    out: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for r in table.select(["dim", "n", "kind", "ids", "uids", "body"]).to_pylist():
        out.setdefault(r["dim"], []).append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["uids"], np.int64), np.frombuffer(r["body"], r["kind"]).reshape(r["n"], r["dim"])))
    return out


def _whole(a: np.ndarray) -> np.ndarray:
    """a as unbounded integers."""
    return np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer rows of a and b."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63 and a.dtype.kind == b.dtype.kind == "i":
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(_whole(a) @ _whole(b).T, _LONG.min, _LONG.max).astype(np.int64)


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns of its k highest scores, equal scores to the first column, without those that `own`
    marks; and which of these are real."""
    width = scores.shape[1]
    k = min(k, width)
    if int(np.abs(scores).max(initial=0)) < 1 << 50:
        key = scores * width + np.arange(width - 1, -1, -1)  # one key for score and column
        key[own] = _LONG.min
        at = np.argpartition(key, width - k, axis=1)[:, width - k :]
    else:
        columns = np.broadcast_to(np.arange(width), scores.shape)
        at = np.lexsort((columns, ~scores, own), axis=1)[:, :k]
    return at, ~np.take_along_axis(own, at, axis=1)


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, asked: pa.Table) -> pa.Table:
        tiles, out = _unpack(candidates), []
        shard = key[0].as_py()
        for dim, blocks in _unpack(asked).items():
            sorted_tiles = []
            for ids, uids, body in tiles.get(dim, []):
                order = np.lexsort((uids, ids))
                sorted_tiles.append((ids[order], uids[order], body[order]))
            for qids, quids, qbody in blocks:
                for at in range(0, len(qids), BLOCK):
                    q, u = qids[at : at + BLOCK], quids[at : at + BLOCK]
                    lists = []
                    for ids, uids, body in sorted_tiles:
                        scores = products(qbody[at : at + BLOCK], body)
                        of, real = select(scores, u[:, None] == uids[None, :], k)
                        lists.append((real, np.take_along_axis(scores, of, axis=1), ids[of], uids[of]))
                    if not lists:
                        continue
                    real, scores, ids, uids = (np.concatenate(x, axis=1) for x in zip(*lists, strict=True))
                    order = np.lexsort((uids, ids, ~scores, ~real), axis=1)[:, :k]
                    real, scores, ids, uids = (np.take_along_axis(x, order, axis=1) for x in (real, scores, ids, uids))
                    offsets = pa.array(np.concatenate(([0], np.cumsum(real.sum(axis=1)))).astype(np.int32))
                    entries = pa.StructArray.from_arrays([pa.array(~scores[real]), pa.array(ids[real]), pa.array(uids[real])], names=["down", "vec_id", "uid"])
                    out.append(pa.table({"quid": u, "query_id": q, "node": pa.array(np.full(len(q), shard), pa.int64()), "top": pa.ListArray.from_arrays(offsets, entries)}))
        schema = pa.schema([("quid", pa.int64()), ("query_id", pa.int64()), ("node", pa.int64()), ("top", pa.list_(pa.struct([("down", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64())])))])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: for every row whose id is divisible by `every`, its k best other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(vector_col).alias("vector"))
    tiles = materialise(rows.mapInArrow(_pack(scale, TILE), _TILE_SCHEMA).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    asked = materialise(tiles.mapInArrow(_queries(every), _TILE_SCHEMA).withColumn("tile", F.monotonically_increasing_id()), "query-tiles")
    size = lambda df: df.agg(F.coalesce(F.sum(F.length("body") + F.length("ids") * 2), F.lit(0)), F.count("*")).first()
    held, wanted = size(tiles), size(asked)
    shards = max(1, -(-held[0] // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, held[1]))
    groups = max(1, -(-wanted[0] // GROUP_BYTES))
    spread = lambda df, name, n, other, m: df.withColumn(name, F.pmod(F.xxhash64("tile"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left, right = spread(tiles, "shard", shards, "group", groups), spread(asked, "group", groups, "shard", shards)
    lists = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(_search(k), "quid long, query_id long, node long, top array<struct<down:long,vec_id:long,uid:long>>")
    while shards > 1:
        lists = lists.groupBy("quid", "query_id", F.floor(F.col("node") / FAN).alias("node")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        shards = -(-shards // FAN)
    found = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.down").alias("score"))
