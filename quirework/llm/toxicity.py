"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a seed lexicon and of a lexicon learned from labelled texts, how near their words stand to
words of the second person, rates of capitals, punctuation and obfuscated spellings, and length. The classifier is fit
on at most SAMPLE labelled rows (those with the smallest hash of their id), one row of each group of near copies among
them; out-of-fold scores of that sample fit the calibration. Every row's whole text is scored.

Edge cases: null and empty texts get the score of a text without any sign; rows repeated in every column get equal
scores; a null id counts as not held out and takes no part in learning; an id with several labels is toxic if one of
them is, an id with several texts is learned from the one with the smallest hash, whatever the order of the rows;
without labels of both kinds every score is the share of positives (0 without labels); other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, isotonic
from .common import kept, materialise, ship, texts_of

#: Labelled rows that the classifier is fit on, at most.
SAMPLE = 20_000
#: Words of the learned lexicon, at most.
LEARNED = 300
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3

# Common insults, and words of the second person.
SEED = "idiot idiots moron morons stupid dumb loser losers scum trash garbage filth worthless pathetic disgusting clown fool jerk liar imbecile dimwit vermin ugly freak creep crap bastard bitch shut imbécile débile connard salaud ordure dummkopf trottel arschloch abschaum idiota imbécil estúpido basura escoria".split()
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros tus".split()

_SEED = frozenset(w.encode() for w in SEED)
_SECOND = frozenset(w.encode() for w in SECOND)
_LOWER_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_HIDDEN = re.compile(rb"(?<![a-z0-9])[a-z@$][a-z]*[*@$0-9!._-]+[a-z*@$0-9!._-]*[a-z]")
_LEET = bytes.maketrans(b"01345@$!", b"oieasasi")
_MARKS = b"*._-"
NEAR = 4


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_LOWER_WORDS).split()


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    """The dense features of one whole text."""
    words = _words(text)
    n = len(words)
    per = 100 / max(1, n)
    seed = sum(map(_SEED.__contains__, words))
    hits = [] if seed == 0 and learned.keys().isdisjoint(words) else [i for i, w in enumerate(words) if w in _SEED or w in learned]
    second = sum(map(_SECOND.__contains__, words))
    near = 0
    if hits and second:
        near = sum(any(w in _SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    weights = [learned.get(words[i], 0.0) for i in hits]
    hidden = _HIDDEN.findall(text.lower())
    plain = [w.translate(_LEET, _MARKS) for w in hidden]
    told = sum(w in _SEED or w in learned for w in plain)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, int)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    chars = max(1, len(text))
    raw = text.split() if upper > 1 else []
    shouted = sum(w.isupper() and len(w) > 2 for w in raw)
    punctuation = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        seed * per,
        math.log1p(seed),
        len(hits) * per,
        math.log1p(len(hits)),
        max(weights, default=0.0),
        sum(weights) * per,
        float(len({words[i] for i in hits})),
        near * per,
        second * per,
        upper / max(1, upper + lower),
        shouted * per,
        100 * int(counts[33]) / chars,
        100 * int(counts[63]) / chars,
        100 * punctuation / chars,
        len(hidden) * per,
        math.log1p(told),
        100 * int(counts[48:58].sum()) / chars,
        math.log1p(n),
        len(text) / max(1, n),
    ]


class Model:
    def __init__(self, learned: dict[bytes, float], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.learned, self.trees, self.knots = learned, trees, knots

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, self.learned) for t in texts]))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def _sketch(words: list[bytes]) -> int:
    """The smallest hash of a text's five-word shingles: near copies mostly share it."""
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def _held_out(of: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(of).cast("string")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the bounded sample, one row of each group of near copies."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~_held_out())
    picked = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    several = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    # one text of each id, by partial aggregation, so that an id that stands very often cannot swell the sample
    chosen = several.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    rows = chosen.select("doc_id", F.col("least.text").alias("text"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            marks = [_sketch(_words(t)) for t in texts_of(batch.column("text"))]
            yield pa.record_batch([*batch.columns, pa.array(marks, pa.int64())], names=["doc_id", "text", "toxic", "mark"])

    marked = materialise(rows.mapInArrow(run, "doc_id long, text string, toxic int, mark long"), "toxic-sample")
    first = marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id"))
    return marked.join(F.broadcast(first), ["mark", "doc_id"]).select("doc_id", "text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a word, by label, as far as this partition goes."""
    kept("toxicity")
    with_, without, n = Counter(), Counter(), [0, 0]
    for batch in batches:
        for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            n[toxic != 0] += 1
            (with_ if toxic else without).update(set(_words(text)))
    words = [b"", *(with_.keys() | without.keys())]
    yield pa.record_batch([pa.array(words, pa.binary()), pa.array([n[1], *(with_[w] for w in words[1:])], pa.int64()), pa.array([n[0], *(without[w] for w in words[1:])], pa.int64())], names=["word", "yes", "no"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit lexicon, trees and calibration on the bounded sample of labelled rows."""
    sample = materialise(_labelled(docs, labels), "toxic-learn")
    counted = materialise(sample.select("text", "toxic").mapInArrow(_counts, "word binary, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "toxic-words")
    totals = counted.filter(F.length("word") == 0).collect()
    yes, no = (int(totals[0].yes), int(totals[0].no)) if totals else (0, 0)
    odds = F.log((F.col("yes") + 0.5) / (yes - F.col("yes") + 0.5)) - F.log((F.col("no") + 0.5) / (no - F.col("no") + 0.5))
    words = counted.filter(F.length("word") > 2).filter(F.col("yes") >= max(3, yes // 50)).withColumn("odds", odds).filter("odds > 3").orderBy(F.desc("odds"), "word").limit(LEARNED)
    learned = {bytes(r.word): float(r.odds) for r in words.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            x = [features(t, learned) for t in texts_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    rows = sorted((r.doc_id, r.toxic, r.x) for r in sample.mapInArrow(run, "doc_id long, toxic int, x array<double>").collect())
    if not rows:
        return Model(learned, Trees(), (np.zeros(1), np.zeros(1)))
    x, y = np.array([r[2] for r in rows]), np.array([r[1] != 0 for r in rows], float)
    if 0 < y.sum() < len(y):
        fold, out = np.arange(len(y)) % 4, np.zeros(len(y))
        for k in range(4):
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        return Model(learned, Trees().fit(x, y), isotonic(out, y))
    return Model(learned, Trees(), (np.zeros(1), np.array([y.mean()])))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (place in the scan), doc_id, held_out, score and predicted of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            yield pa.record_batch([batch.column("uid"), batch.column("doc_id"), pa.array(model.scores(texts_of(batch.column("text"))))], names=["uid", "doc_id", "score"])

    scored = rows.mapInArrow(run, "uid long, doc_id long, score double")
    return scored.select("uid", "doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, every column kept, without the rows that are predicted toxic. Each row is decided where it is read."""
    ship(docs.sparkSession)
    model = learn(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array(model.scores(texts_of(batch.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
