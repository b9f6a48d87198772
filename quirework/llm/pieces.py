"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (space to U+2581, with a dummy prefix), cut where no vocabulary piece can cross, and each cut piece
is encoded by a score-ordered agenda: all adjacent symbol pairs that form a vocabulary piece wait in a heap by
(score, leftmost first); the best is merged, its new neighbours enter, pairs whose symbols are gone are skipped.
Symbols outside the vocabulary fall back to bytes. Every piece is encoded once per worker and remembered up to
CACHE pieces and CACHE_CHARS characters. Checked against the sentencepiece library are all pieces new to the worker (also those behind a newline,
and of runs of spaces), one whole text of each run of up to BATCH texts, chosen by a hash whatever its length, and texts
with more pieces than can be remembered; a difference stops the job. Decoding is the library's.

Edge cases: null and empty texts give only begin and end ids; very long texts and pieces cost n log n; rows repeated
in every column are separate rows; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship

SPACE = "▁"
#: Remembered pieces per worker, and their characters together, at most.
CACHE, CACHE_CHARS = 600_000, 1 << 24
#: Texts encoded together, and their characters at most.
BATCH, BATCH_CHARS = 256, 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 in (1, 5):
            n = 8 if key & 7 == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, key & 7, value


class Vocabulary:
    """A merge-type model read from its file: pieces, scores and byte fallback. Only the identity normaliser with a
    dummy prefix is supported; another model is refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes = [0] * 256
        self.unknown, self.begin, self.end = 0, 1, 2
        n = 0
        for number, _, value in _fields(data):
            if number == 1:
                piece = {k: v for k, _, v in _fields(value)}
                text, score, kind = piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, 1)
                if kind in (1, 4, 5):
                    self.ids[text] = n
                elif kind == 6:
                    self.bytes[int(text[3:5], 16)] = n
                elif kind == 2:
                    self.unknown = n
                self.scores.append(score)
                n += 1
            elif number == 2:
                trainer = {k: v for k, _, v in _fields(value)}
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only merge-type vocabularies with byte fallback are supported")
                self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
            elif number == 3:
                norm = {k: v for k, _, v in _fields(value)}
                if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a vocabulary piece crosses a white-space boundary")

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a piece of escaped text by the agenda of adjacent pairs."""
        ids, scores = self.ids, self.scores
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (found := ids.get(pair)) is not None:
                agenda.append((-scores[found], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := ids.get(new := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (-scores[found], i, new))
            h = before[i]
            if h >= 0 and (found := ids.get(new := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (-scores[found], h, new))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if (found := ids.get(s)) is not None:
                    out.append(found)
                else:
                    out.extend(map(self.bytes.__getitem__, s.encode()))
        return out


class Encoder:
    """Encodes batches of texts with remembered pieces, checking itself against the library."""

    _cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Ids of a piece as little-endian unsigned 32-bit integers, by the piece: "x" is a space and x, "\nx" is not
        #: after a space.
        self.cache: dict[str, bytes] = {}
        self.held = 0  # characters of the remembered pieces
        self.ends = [np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end)]

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE not in text and "\0" not in text:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words and "\n" not in words:
                return words
        # runs of spaces, or a mark in the text: keys "\0x" stand for x as it is, without a space before it
        return ["\0" + x for x in self._cut.findall((" " + text).replace(" ", SPACE))]

    def _new(self, keys: list[str]) -> None:
        more = sum(map(len, keys))
        if len(self.cache) + len(keys) > CACHE or self.held + more > CACHE_CHARS:
            self.cache.clear()
            self.held = 0
        self.held += more
        encode = self.vocabulary.encode_piece
        mark, line = encode(SPACE), encode("\n")
        texts, wholes = [], []  # what the library is given, and all ids that it should return
        for key in keys:
            if key[0] == "\0":
                ids = encode(key[1:])
                if key[1] == SPACE and len(key) > 2:  # the library adds the first mark itself
                    texts.append(key[2:])
                    wholes.append(ids)
                else:
                    texts.append("\n" + key[1:])
                    wholes.append(mark + line + ids)
            elif key[0] == "\n":
                ids = line + encode(key[1:])
                texts.append(key)
                wholes.append(mark + ids)
            else:
                ids = encode(SPACE + key)
                texts.append(key)
                wholes.append(ids)
            self.cache[key] = np.array(ids, "<u4").tobytes()
        for text, ids, right in zip(texts, wholes, self.library.encode(texts, num_threads=1), strict=True):
            if ids != right:
                raise ValueError(f"the agenda and the library differ on {text!r}: {ids} and {right}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian unsigned 32-bit integers."""
        lists = [self._pieces(t) for t in texts]
        out, checked = [], []
        for pieces in lists:
            try:
                body = b"".join(map(self.cache.__getitem__, pieces))
            except KeyError:
                self._new(list({p for x in lists for p in x if p not in self.cache}))
                missing = [p for p in pieces if p not in self.cache]  # more pieces than the cache holds
                if missing:
                    self._new(list(set(missing)))
                try:
                    body = b"".join(map(self.cache.__getitem__, pieces))
                except KeyError:
                    checked.append(len(out))
                    body = np.array(self.vocabulary.encode_piece((" " + "".join(texts[len(out)])).replace(" ", SPACE)), "<u4").tobytes()
            out.append(self.ends[0] + body + self.ends[1])
        if texts:
            checked.append(min(range(len(texts)), key=lambda i: (not texts[i], zlib.crc32(out[i]))))
        for i in checked:
            if np.frombuffer(out[i], "<u4").tolist() != self.library.encode(texts[i], add_bos=True, add_eos=True):
                raise ValueError("the agenda and the library differ on a whole text")
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").astype(np.int32).tolist()) for x in ids]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a model file; workers are reused, so its cache lives through many tasks, until the worker
    turns to another operator."""
    encoders = kept("pieces")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Cuts of a batch into runs of bounded rows and characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= BATCH or size + len(t) > BATCH_CHARS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with keep_ids also ids and decoded themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in runs(texts):
                ids = own.encode(texts[a:b])
                decoded = own.decode(ids)
                columns = [batch.column("doc_id")[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                    offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(offsets, values), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else ""))
