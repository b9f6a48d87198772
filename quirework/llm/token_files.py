"""Token ids in wavelet files: documents are encoded where they are read, their ids are stored and dealt by ranges of the
document's id, and each range becomes files of bounded size. Texts are never shuffled, and the number of ranges follows
from the counted tokens.

Words between ASCII white space are encoded once per worker by the tokenizers library and remembered up to CACHE words
and CACHE_BYTES (its normaliser and pre-tokenizer never join words across white space). Files are rows of a Parquet table
in the shared folder: partition, tokens before the file in its partition, tokens, documents, and the file itself.

Edge cases: null and empty texts have only the end id; null ids come first; rows repeated in every column are separate
documents, in the order of the scan; a very long text is one file of its own size; other columns are not read. An empty
table gives an empty result. `docs` must be a deterministic read (a stored table).
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialise, new_path, partitions, release, ship, small_or_not, texts_of
from .wavelet import Shard, build

#: Remembered words per worker (about 200 bytes each), and their bytes together, at most.
CACHE, CACHE_BYTES = 1_200_000, 1 << 25
#: Punctuation that is a pre-token of its own behind a word of letters; an apostrophe may join what follows.
MARKS = string.punctuation.replace("'", "")
#: Words that the library gets as one line.
LINE = 256
#: Tokens after which a file is closed, and tokens of a range at most (beside its last document), about.
FILE_TOKENS, RANGE_TOKENS = 1 << 20, 1 << 25
FILES = "part int, before long, n_tokens long, n_docs long, file binary"


def _letters_only(s: str) -> bool:
    """Whether a word is letters before and after the tokenizer makes it lower case."""
    return s.isalpha() and s.lower().isalpha()


class WordEncoder:
    """Ids of texts by the tokenizers library, word by word."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        # the same vocabulary and merges for words of letters that the normaliser would not change
        plain["normalizer"] = None
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the remembered words

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters only are one pre-token each, ended by one end-of-word token: encoded a line at a time."""
        same = [w for w in words if w.lower() == w and unicodedata.is_normalized("NFC", w)]
        return self._lines(self.plain, same) | self._lines(self.library, list(set(words).difference(same)))

    def _lines(self, library, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(words), LINE):
            part = words[at : at + LINE]
            ids = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out.update(self._others(part))
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            cuts = [0, *(ends * size).tolist()]
            out.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
        if words and out[words[0]] != self._others(words[:1])[words[0]]:
            raise ValueError(f"the library encodes {words[0]!r} in two ways")
        return out

    def _others(self, words: list[str]) -> dict[str, bytes]:
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True)}

    def _new(self, words: list[bytes]) -> None:
        more = sum(map(len, words))
        if len(self.cache) + len(words) > CACHE or self.held + more > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        self.held += more
        plain, odd, ended = [], [], []
        for w in words:
            s = w.decode()
            if _letters_only(s):
                plain.append(s)
            elif _letters_only(head := s.rstrip(MARKS)):
                word, mark = head.encode(), s[len(head) :]
                ended.append((w, word, mark.encode()))
                if word not in self.cache:
                    plain.append(head)
                if mark.encode() not in self.cache:
                    odd.append(mark)
            else:
                odd.append(s)
        for s, ids in (self._letters(list(dict.fromkeys(plain))) | self._others(list(dict.fromkeys(odd)))).items():
            self.cache[s.encode()] = ids
        for w, word, mark in ended:
            self.cache[w] = self.cache[word] + self.cache[mark]

    def encode(self, text: bytes) -> bytes:
        # the vocabulary is lower case; a text that may hold a special token is left as it is
        words = (text if b"<|" in text else text.lower()).split()
        try:
            return b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            out = []
            for at in range(0, len(words), CACHE):
                part = words[at : at + CACHE]
                self._new(list({w for w in part if w not in self.cache}))
                try:
                    out.append(b"".join(map(self.cache.__getitem__, part)))
                except KeyError:
                    self._new(list(set(part)))  # the cache was cleared meanwhile
                    out.append(b"".join(map(self.cache.__getitem__, part)))
            return b"".join(out)


def token_bits(tokenizer: str) -> int:
    """Bits that hold every id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length())


def encoder(path: str) -> WordEncoder:
    encoders = kept("token_files")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def _encode(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        stop = np.array([end], own.kind).tobytes()
        for batch in batches:
            ids = [own.encode(x) + stop for x in texts_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("uid"), pa.array(ids, pa.binary())], names=["doc_id", "uid", "ids"])

    return run


def _write(bits: int):
    kind = np.dtype("<u2") if bits <= 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal before, size
            lengths = [len(x) // kind.itemsize for x in ids]
            file = build(np.frombuffer(b"".join(ids), kind), names, lengths, bits)
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([file], pa.binary())], names=["part", "before", "n_tokens", "n_docs", "file"])
            before += sum(lengths)
            ids.clear()
            names.clear()
            size = 0
            return out

        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(x)
                names.append(name)
                size += len(x) // kind.itemsize
                if size >= FILE_TOKENS:
                    yield close()
        if names:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of docs, in ascending order of the id, as a Parquet table at path."""
    spark = docs.sparkSession
    ship(spark)
    bits = token_bits(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    encoded = materialise(rows.mapInArrow(_encode(tokenizer, end), "doc_id long, uid long, ids binary"), "token-ids")
    tokens = encoded.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // (2 if bits <= 16 else 4)
    ranges = max(1, -(-tokens // RANGE_TOKENS), min(partitions(spark), -(-tokens // FILE_TOKENS)))
    dealt = encoded.repartitionByRange(ranges, "doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    dealt.select("doc_id", "ids").mapInArrow(_write(bits), FILES).write.option("compression", "uncompressed").parquet(path)
    release(encoded)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, file in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("file"), strict=True):
            rows = [(i, before + at, len(t), zlib.crc32(t.astype("<u4").tobytes())) for i, at, t in Shard(file.as_py()).documents()]
            ids, starts, sizes, crcs = zip(*rows, strict=True)
            yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files at path."""
    files = spark.read.parquet(path)
    # one narrow row a range of the writer, of RANGE_TOKENS tokens each
    totals = files.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = small_or_not(materialise(totals.select("part", (F.sum("n").over(ahead) - F.col("n")).alias("offset")), "token-offsets"))
    rows = files.select("part", "before", "file").mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a new folder under the shared one, and read them back."""
    path = new_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, end, id_col, text_col)
    return read(docs.sparkSession, path)
