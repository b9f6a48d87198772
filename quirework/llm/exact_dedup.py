"""Exact duplicates by a Golomb-coded fingerprint exchange.

Every input partition hashes its texts, sorts its distinct 48-bit fingerprints and sends each owner (a range of
fingerprints) one Golomb-Rice coded list. An owner decodes the lists, marks what more than one of them holds, and
answers each sender with a bitmap over that sender's list. The number of owners follows from the counted rows. Only rows that a bitmap or their own partition marks are
suspects; their normalised bytes are shuffled, pre-aggregated by SHA-256 before the shuffle, and compared.

Edge cases: null texts count as empty; empty texts are equal to each other; rows repeated in every column are
separate rows, of which one stays; a null id ranks behind every other id; other columns of the input are not read,
so their names cannot clash. An empty table gives an empty result. `docs` must be a deterministic read (a stored
table), as it is scanned twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import BROADCAST_ROWS, WHITE, kept, materialise, partitions, ship, small_or_not, texts_of, without_rows

#: Bits of a fingerprint. False suspects are possible and harmless: bytes decide.
BITS = 48
#: Fingerprints that an owner gets, about and at most (each row sends one or none): it holds them as numbers.
OWNER_ROWS = 1 << 21
_NARROW = "part int, uid long, doc_id long, fp long, text_sha256 string, n_chars long, owner int, n int, k int, unary binary, low binary"


def _hash_partition(owners: int):
    """Rows of hashes, then one coded message to each owner that this partition has fingerprints for."""
    width = -(-(1 << BITS) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("exact_dedup")
        schema = pa.schema([("part", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string()), ("n_chars", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("unary", pa.binary()), ("low", pa.binary())])
        seen, part = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = [hashlib.sha256(x.translate(None, WHITE)).digest() for x in texts_of(batch.column("text"))]
            fp = np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype(np.uint64) >> np.uint64(64 - BITS)
            fp = fp.astype(np.int64)
            seen.append(fp)
            uid = batch.column("uid")
            part = uid[0].as_py() >> 33
            size = len(fp)
            empty = lambda kind: pa.nulls(size, kind)
            yield pa.record_batch([pa.array(np.full(size, part, np.int32)), uid, batch.column("doc_id").cast(pa.int64()), pa.array(fp), pa.array([x.hex() for x in digests]), pc.fill_null(pc.utf8_length(batch.column("text")).cast(pa.int64()), 0), empty(pa.int32()), empty(pa.int32()), empty(pa.int32()), empty(pa.binary()), empty(pa.binary())], schema=schema)
        if seen:
            fps = np.unique(np.concatenate(seen))
            cuts = np.searchsorted(fps, np.arange(owners + 1, dtype=np.int64) * width)
            sent = []
            for owner in np.flatnonzero(np.diff(cuts)):
                own = fps[cuts[owner] : cuts[owner + 1]] - int(owner) * width
                k = golomb.parameter(width, len(own))
                sent.append((part, None, None, None, None, None, int(owner), len(own), k, *golomb.encode(own, k)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's answer: for each sender a bitmap of the fingerprints that another sender has too."""
    lists = [golomb.decode(u, w, n, k) for u, w, n, k in zip(messages.unary, messages.low, messages.n, messages.k, strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, shared)).tobytes() for x in lists]
    return pd.DataFrame({"part": messages.part, "owner": messages.owner, "bitmap": bitmaps})


def _suspects(owners: int):
    width = -(-(1 << BITS) // owners)

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"uid": np.zeros(0, np.int64)})
        fp = rows.fp.to_numpy()
        values, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
        marked = counts > 1
        cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * width)
        for owner, bitmap in zip(answers.owner, answers.bitmap, strict=True):
            a, b = cuts[owner], cuts[owner + 1]
            marked[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a).astype(bool)
        return pd.DataFrame({"uid": rows.uid.to_numpy()[marked[inverse]]})

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept("exact_dedup")
    for batch in batches:
        norm = [x.translate(None, WHITE) for x in texts_of(batch.column("text"))]
        sha = [hashlib.sha256(x).hexdigest() for x in norm]
        yield pa.record_batch([batch.column("uid"), batch.column("doc_id").cast(pa.int64()), pa.array(sha, pa.string()), pa.array(norm, pa.binary()), pc.fill_null(pc.utf8_length(batch.column("text")).cast(pa.int64()), 0)], names=["uid", "doc_id", "text_sha256", "norm", "n_chars"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: uid (its place in the scan), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ASCII white space is deleted. Of equal texts the row with the most
    code points stays, then the smallest id, then the first in the scan.
    """
    spark = docs.sparkSession
    ship(spark)
    owners = max(partitions(spark), -(-docs.count() // OWNER_ROWS))  # the number of owners grows with the rows
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = materialise(rows.mapInArrow(_hash_partition(owners), _NARROW), "fingerprints")
    narrow = sent.filter("uid is not null").select("part", "uid", "doc_id", "fp", "text_sha256")
    messages = sent.filter("owner is not null").select("part", "owner", "n", "k", "unary", "low")
    answers = messages.groupBy("owner").applyInPandas(_answer, "part int, owner int, bitmap binary")
    suspects = narrow.select("part", "uid", "fp").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspects(owners), "uid long")
    suspects = small_or_not(materialise(suspects, "suspects"), broadcast_rows)
    place = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("id"), F.bitwise_not("uid").alias("at"), "doc_id", "uid")
    groups = (
        rows.join(suspects, "uid", "left_semi")
        .mapInArrow(_bytes, "uid long, doc_id long, text_sha256 string, norm binary, n_chars long")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("n"), F.max(place).alias("best"), F.min("norm").alias("low"), F.max("norm").alias("high"))
        .filter("n > 1")
        .select(
            "text_sha256",
            "n",
            "best",
            F.when(F.col("low") == F.col("high"), F.lit(True)).otherwise(F.raise_error("texts of one SHA-256 differ in their bytes")).alias("same"),
        )
        .filter("same")
        .select("text_sha256", "n", F.col("best.doc_id").alias("best_id"), F.col("best.uid").alias("best_uid"))
    )
    groups = materialise(groups, "copies")
    return narrow.join(groups, "text_sha256", "left").select(
        "uid",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, every column kept, without all but one row of each group of equal texts."""
    dropped = materialise(exact_groups(docs, id_col, text_col, broadcast_rows).filter(~F.col("kept")).select("uid"), "dropped")
    return without_rows(docs, dropped, broadcast_rows)
