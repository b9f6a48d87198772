"""Language ID: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

Characters are predicted within words (marked at both ends), from up to ORDER - 1 characters before. Each model keeps,
for every order, the sorted 64-bit hashes of its n-grams with their interpolated log-probabilities, and of its contexts
with their back-off weights; a word's characters are looked up together by binary search, and its log-probabilities are
remembered per worker. A text's language has the lowest cross-entropy a character over the whole text; the score is a
logistic calibration of how far the next language lies behind and of the length, and texts below REJECT are marked.

Models are fit on about SAMPLE documents a language (those with the smallest hashes of their id, at a rate from the
language's count), a tenth of which fits the calibration instead; of the sample's words on the LEARN_WORDS most frequent
ones of a language (words longer than LEARN_CHARS letters are left out), and of the languages on the LANGUAGES most
frequent ones, so that the driver's memory is bounded. Prediction reads every word of every text.

Edge cases: null texts and texts without a letter get `und` and score 0; without learned languages every text does;
rows repeated in every column get equal results; a null id counts as not held out; ties go to the first language by
code point; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialise, ship

#: About so many documents a language are learned from; distinct words a language, letters of a word, and languages, at
#: most.
SAMPLE = 2_000
LEARN_WORDS, LEARN_CHARS, LANGUAGES = 400_000, 64, 1_000
ORDER = 5
DISCOUNT = 0.75
#: Scores under this are marked as rejected.
REJECT = 0.5
#: Remembered words per worker, their scores (a number for each language and word), and their characters, at most.
CACHE, CACHE_SCORES, CACHE_CHARS = 500_000, 1 << 23, 1 << 24

_START, _END = "\x02", "\x03"
_STEP = 0x9E3779B97F4A7C15


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1, 2, ...: a hash of the n codes that end at each place (of fewer at the first places)."""
    total, power = np.zeros(len(codes), np.uint64), 1
    for n in range(1, ORDER + 1):
        moved = np.zeros(len(codes), np.uint64)
        moved[n - 1 :] = codes[: len(codes) - n + 1]
        total = total + (moved + np.uint64(1)) * np.uint64(power)
        power = power * _STEP % (1 << 64)
        mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        yield mixed ^ (mixed >> np.uint64(32))


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all marked words, each one's place in its word, and each word's first place."""
    text = "".join([_START + w + _END for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes), starts


class Model:
    """The sorted arrays of one language."""

    def __init__(self, counts: dict[str, int], alphabet: int):
        """counts: how often each distinct word was seen. alphabet: distinct characters of all languages."""
        words = list(counts)
        weight = np.array([counts[w] for w in words], np.float64)
        self.floor = float(-np.log(alphabet + 2))
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        if not words:
            empty = (np.zeros(0, np.uint64), np.zeros(0))
            self.grams, self.contexts = [empty] * ORDER, [empty] * ORDER
            return
        codes, place, _ = _flat(words)
        times = np.repeat(weight, np.fromiter(map(len, words), np.int64, len(words)) + 2)
        hashes = list(_hashes(codes))
        lower: np.ndarray | None = None  # probability below, at every place
        for n in range(1, ORDER + 1):
            ok = np.flatnonzero(place >= max(1, n - 1))
            keys, first, inverse = np.unique(hashes[n - 1][ok], return_index=True, return_inverse=True)
            raw = np.bincount(inverse, times[ok])
            if n < ORDER:  # how many distinct characters stand before; as often as seen where a word starts
                start = place[ok] == n - 1
                wide = np.flatnonzero(place >= n)
                left = np.unique(np.stack((hashes[n - 1][wide], hashes[n][wide])), axis=1)[0] if len(wide) else np.zeros(0, np.uint64)
                count = np.bincount(np.searchsorted(keys, left), minlength=len(keys)).astype(float)
                begins = np.unique(inverse[start])
                count[begins] = raw[begins]
                count = np.maximum(count, 1)
            else:
                count = raw
            at = ok[first]
            if n == 1:
                context = np.zeros(len(keys), np.uint64)
                below = np.full(len(keys), np.exp(self.floor))
            else:
                context = hashes[n - 2][at - 1]
                below = lower[at]
            names, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, count)
            spare = DISCOUNT * np.bincount(which) / total
            p = (count - DISCOUNT) / total[which] + spare[which] * below
            self.grams.append((keys, np.log(p)))
            self.contexts.append((names, np.log(spare)))
            known = np.full(len(codes), np.exp(self.floor)) if lower is None else lower.copy()
            known[ok] = p[inverse]
            lower = known

    def word_scores(self, hashes: list[np.ndarray], place: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probability of every word of a flat list, from its hashes."""
        out = np.zeros(len(place))
        todo = np.flatnonzero(place >= 1)
        for n in range(ORDER, 0, -1):
            reach = place[todo] >= n - 1
            at = todo[reach]
            keys, values = self.grams[n - 1]
            if len(keys):
                found = np.minimum(np.searchsorted(keys, hashes[n - 1][at]), len(keys) - 1)
                hit = keys[found] == hashes[n - 1][at]
            else:
                found, hit = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            out[at[hit]] += values[found[hit]] if len(keys) else 0
            missed = at[~hit]
            names, weights = self.contexts[n - 1]
            if len(missed) and len(names):
                context = hashes[n - 2][missed - 1] if n > 1 else np.zeros(len(missed), np.uint64)
                found = np.minimum(np.searchsorted(names, context), len(names) - 1)
                same = names[found] == context
                out[missed[same]] += weights[found[same]]
            todo = np.concatenate((todo[~reach], missed))
        out[todo] += self.floor
        return np.add.reduceat(out, starts) if len(starts) else np.zeros(0)


class Languages:
    """All models, the calibration, and the words that this worker has scored."""

    def __init__(self, names: list[str], models: list[Model], fit: np.ndarray):
        self.names, self.models, self.fit = names, models, fit
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._chars = 0
        self._rows = np.zeros((1024, len(self.names) + 1))
        self._most = max(1, min(CACHE, CACHE_SCORES // (len(self.names) + 1)))

    def __getstate__(self):
        return self.names, self.models, self.fit

    def __setstate__(self, state):
        self.names, self.models, self.fit = state
        self._forget()

    def _new(self, words: list[str]) -> None:
        bare = [letters(w) for w in words]
        full = [w for w in bare if w]
        rows = np.zeros((len(words), len(self.names) + 1))
        if full:
            codes, place, starts = _flat(full)
            hashes = list(_hashes(codes))
            has = np.array([bool(w) for w in bare])
            for j, m in enumerate(self.models):
                rows[has, j] = m.word_scores(hashes, place, starts)
            rows[has, -1] = [len(w) + 1 for w in full]
        n = len(self._at)
        self._chars += sum(map(len, words))
        if n + len(words) > len(self._rows):
            self._rows = np.concatenate((self._rows, np.zeros((max(len(words), len(self._rows)), self._rows.shape[1]))))
        self._rows[n : n + len(words)] = rows
        self._at.update(zip(words, range(n, n + len(words)), strict=True))

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text: log-probability by language, and characters."""
        lists = [t.lower().split() for t in texts]
        out = np.zeros((len(texts), len(self.names) + 1))
        for i, words in enumerate(lists):
            for a in range(0, len(words), 100_000):
                part = words[a : a + 100_000]
                try:
                    at = list(map(self._at.__getitem__, part))
                except KeyError:
                    if len(self._at) > self._most or self._chars > CACHE_CHARS:
                        self._forget()
                    ahead = [w for x in lists[i : i + 64] for w in x] if len(part) < 20_000 else part
                    new = list({w for w in ahead if w not in self._at})
                    if len(new) > self._most:
                        new = list({w for w in part if w not in self._at})
                    self._new(new)
                    at = list(map(self._at.__getitem__, part))
                out[i] += self._rows[at].sum(axis=0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        best, margin, chars = judge(self.sums(texts))
        p = 1 / (1 + np.exp(-(signs(margin, chars) @ self.fit)))
        return [self.names[b] if c else "und" for b, c in zip(best, chars, strict=True)], np.where(chars > 0, p, 0.0)


def judge(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, distance of the next one in nats a character, characters."""
    chars = sums[:, -1]
    entropy = -sums[:, :-1] / np.maximum(1, chars)[:, None]
    best = entropy.argmin(1)
    order = np.sort(entropy, axis=1)
    margin = order[:, 1] - order[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return best, margin, chars


def signs(margin: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(margin)), margin, np.log1p(margin * chars), np.log1p(chars)), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly penalised logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _place():
    """A hash of the id between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11).cast("double") / float(1 << 53)


def learn(rows: DataFrame) -> Languages:
    """rows: doc_id, text, lang. Models and calibration from the sample."""
    own = rows.filter("lang is not null and doc_id is not null").filter(~_held_out())
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    names = sorted(counts)
    if not names:
        return Languages([], [], np.zeros(4))
    rate = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, SAMPLE / counts[k]))])
    # one row of equal id and text, so that a row that stands very often cannot swell the sample
    drawn = own.filter(F.coalesce(_place() < F.try_element_at(rate, F.col("lang")), F.lit(False))).withColumn("h", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    single = drawn.dropDuplicates(["lang", "doc_id", "h"])
    sample = materialise(single.select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(10)) == 0).alias("test")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(map(letters, (text or "").lower().split()))
        for lang, c in seen.items():
            c = Counter({w: n for w, n in c.items() if 0 < len(w) <= LEARN_CHARS})
            yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    found: dict[str, dict[str, int]] = {k: {} for k in names}
    words = sample.filter("not test").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for batch in words.withColumn("place", place).filter(F.col("place") <= LEARN_WORDS).drop("place").toArrow().to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found[lang][word] = n
    alphabet = len({c for w in found.values() for x in w for c in x})
    out = Languages(names, [Model(dict(sorted(found[k].items())), alphabet) for k in names], np.zeros(4))
    own_names = {k: i for i, k in enumerate(names)}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, margin, chars = judge(out.sums([t or "" for t in batch.column("text").to_pylist()]))
            right = [own_names[k] == b for k, b in zip(batch.column("lang").to_pylist(), best, strict=True)]
            yield pa.record_batch([pa.array(right), pa.array(margin), pa.array(chars)], names=["right", "margin", "chars"])

    held = sorted((r.chars, r.margin, r.right) for r in sample.filter("test").select("lang", "text").mapInArrow(test, "right boolean, margin double, chars double").collect())
    chars, margin, right = (np.array(x, float) for x in zip(*held, strict=True)) if held else (np.zeros(0),) * 3
    out.fit = _logistic(signs(margin, chars), right) if len(held) else np.array([0.0, 1.0, 1.0, 0.0])
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected (by the calibrated score) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = learn(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language")
        for batch in batches:
            names, p = model.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", (F.col("score") < REJECT).alias("rejected"))
