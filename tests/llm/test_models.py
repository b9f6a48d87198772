"""Mixing, top-k, language, toxicity and personal data: brute force, conservation and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pii_cases
import pytest
from pyspark.sql import functions as F

from quirework.llm import boosting, language, mixing, pii, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.targets([100, 1, 1], [1, 5, 5]) == pytest.approx([149, 2, 2])
    assert mixing.targets([0, 4], [5, 2]) == pytest.approx([0, 6])
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]


def test_permutation_and_tree():
    for n in (1, 2, 7, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 99).tolist()) == list(range(n))
    leaves = mixing.splitting_tree([1000, 0, 37], 7)
    assert leaves[-1].tolist() == [1000, 0, 37] and (np.diff(leaves, axis=0) >= 0).all()
    assert np.ptp(np.diff(leaves, axis=0).sum(axis=1)) <= 1


def check_mix(rows, taken):
    size, got, target, doc = Counter(), Counter(), {}, Counter()
    for i, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    for r, s in taken:
        got[s] += r.taken
        target[s] = r.target
        assert r.taken <= 2 * r.size and r.source_size == size[s]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(got[s] - want[s]) <= 0.5 + 1e-6


def test_mix_on_odd_rows(spark, odd, odd_rows, none):
    source = {(r[0], r[1]): r[3] for r in odd_rows}
    own = mixing.mix(odd)
    rows = own.taken().join(odd.select(F.monotonically_increasing_id().alias("uid"), "source"), "uid").collect()
    assert len(rows) == len(odd_rows)
    check_mix([(r[0], r[1], r[3]) for r in odd_rows], [(r, r.source) for r in rows])
    assert source
    table = own.table().collect()
    assert sorted(Counter((r.shard, r.position) for r in table).values())[-1] == 1
    assert sum(r.n_words for r in table) == sum(r.taken for r in rows)
    assert Counter(own.taken().drop("uid").collect()) == Counter(mixing.mix(odd.repartition(1)).taken().drop("uid").collect())
    assert mixing.mix(none).taken().count() == 0 and mixing.mixed_texts(none).count() == 0


def mixed_pieces(spark, rows):
    """Every piece of the mix of rows (dicts), by walking each source's words, its draws one by one, and the leaves of
    the tree: (place in rows, turn, first word, words, shard, place in the shard)."""
    count = lambda r: len(WORD.findall(r["text"] or ""))
    hashed = spark.createDataFrame([(i, r["doc_id"], r["text"] or "") for i, r in enumerate(rows)], "i int, doc_id long, text string")
    h = {r.i: r.h for r in hashed.select("i", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("h")).collect()}
    of = defaultdict(list)
    for i, r in enumerate(rows):
        of[r["source"]].append(i)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    sizes = [sum(count(rows[i]) for i in of[s]) for s in names]
    plan = mixing.Plan(list(zip(names, sizes, strict=True)), (5, 2, 1), 1.5, 2.0, mixing.SEED)
    targets = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    out = []
    for code, s in enumerate(names):
        stream = [(i, k) for i in sorted(of[s], key=lambda i: h[i]) for k in range(count(rows[i]))]
        blocks = [stream[a : a + plan.block] for a in range(0, len(stream), plan.block)]
        left, turn, draw = round(targets[code]), 0, 0
        while left and blocks:
            rank = mixing.permute(np.arange(len(blocks)), len(blocks), plan.key(code, turn)).tolist()
            for b in sorted(range(len(blocks)), key=rank.__getitem__):
                words, left = blocks[b][:left], left - min(left, len(blocks[b]))
                shard = next(k for k in range(plan.shards) if plan.leaves[k][code] <= draw < plan.leaves[k + 1][code])
                for i in dict.fromkeys(i for i, _ in words):
                    mine = [k for j, k in words if j == i]
                    out.append((i, turn, mine[0], len(mine), shard, s, draw))
                draw += 1
                if not left:
                    break
            turn += 1
    assert [n for n in plan.leaves[-1].tolist()] == [sum(1 for _ in {x[6] for x in out if x[5] == s}) for s in names]
    placed = spark.createDataFrame([(n, x[4], x[5], x[6], rows[x[0]]["doc_id"], x[2]) for n, x in enumerate(out)], "n int, shard long, source string, draw long, doc_id long, first_word long")
    at = {r.n: r.h for r in placed.select("n", F.xxhash64(F.lit(mixing.SEED), "shard", "source", "draw", "doc_id", "first_word").alias("h")).collect()}
    return [(*x[:5], at[n]) for n, x in enumerate(out)]


def mixed_rows(spark, rows):
    """rows as mixed, each with its shard, in the order of their places in it."""
    runs = []
    for i, turn, first, n, shard, at in sorted(mixed_pieces(spark, rows)):
        if runs and runs[-1][:2] == [i, turn] and runs[-1][3] == first and runs[-1][4] == shard:
            runs[-1][3] += n
        else:
            runs.append([i, turn, first, first + n, shard, at])
    out = []
    for i, _, a, b, shard, _ in sorted(runs, key=lambda r: (r[4], r[5])):
        text = rows[i]["text"]
        spans = [m.span() for m in WORD.finditer(text)]
        cut = text if b - a == len(spans) else text[spans[a][0] : spans[b - 1][1]]
        out.append(rows[i] | {"text": cut, "n_chars": len(cut), "shard": shard})
    return out


@pytest.mark.parametrize("block, words", [(7, 60), (50, 10**6)])
def test_mix_is_the_tree_s(spark, tmp_path, monkeypatch, block, words):
    """Every piece, shard and place against draws taken one by one."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    monkeypatch.setattr(mixing, "SHARD_WORDS", words)
    rnd = random.Random(block)
    rows = [{"doc_id": i, "text": " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 5, 30, 90]))), "source": rnd.choice(["x", "x", "x", "y", None])} for i in range(60)]
    spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.mix(docs).table().collect()
    want = mixed_pieces(spark, rows)
    assert Counter((r.doc_id, r.turn, r.first_word, r.n_words, r.shard) for r in got) == Counter((rows[x[0]]["doc_id"], *x[1:5]) for x in want)
    assert (max(r.shard for r in got) > 5) == (block == 7)
    order = [(r.shard, r.doc_id, r.first_word) for r in sorted(got, key=lambda r: (r.shard, r.position))]
    assert order == [(x[4], rows[x[0]]["doc_id"], x[2]) for x in sorted(want, key=lambda x: (x[4], x[5]))]
    mixing.mixed_texts(docs).write.parquet(str(tmp_path / "m"))
    parts = spark.read.parquet(str(tmp_path / "m")).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).orderBy("row").collect()
    assert [(r.shard, r.position, r.doc_id, r.text) for r in sorted(parts, key=lambda r: (r.shard, r.position))] == [(r["shard"], sum(q["shard"] == r["shard"] for q in all_[:k]), r["doc_id"], r["text"]) for all_ in [mixed_rows(spark, rows)] for k, r in enumerate(all_)]
    for shard in {r.shard for r in parts}:  # written in one file, in order
        mine = [r for r in parts if r.shard == shard]
        assert len({r.file for r in mine}) == 1 and [r.position for r in mine] == list(range(len(mine)))


def test_mix_of_many_sources_and_copies(spark, tmp_path):
    """More sources than leaves allow shards for; one id and text for a third of the rows."""
    rows = [(1, "the same words", "a")] * 300 + [(None, "w " * (i % 5), f"s{i % 200}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    first, second = (Counter(mixing.mix(d).taken().drop("uid").collect()) for d in (docs, docs.coalesce(1)))
    assert first == second and sum(first.values()) == len(rows)
    assert mixing.Plan([(str(i), 10**9) for i in range(10_000)], (5, 2, 1), 1.5, 2.0, 1).leaves.size <= 2 * mixing.MAX_LEAVES


def test_mixed_texts_hold_what_is_taken(spark, odd, odd_rows):
    with pytest.raises(ValueError):
        mixing.mixed_texts(odd, shard_col="UID")
    out = mixing.mixed_texts(odd)
    assert out.columns == [*odd.columns, "shard", "position"]
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in odd_rows}
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id]
    taken = defaultdict(int)
    for r in mixing.mix(odd).taken().collect():
        taken[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == dict(words)


VECTORS = "vec_id long, embedding array<float>, uid string, tile int"


def top_model(rows, k=5, every=50):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(fine):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(fine) if a != b and len(v) == len(q))
            for rank, (s, j) in enumerate(best[:k], 1):
                out[i, rank, j, -s] += 1
    return out


@pytest.mark.parametrize("tile", [2048, 4])
def test_top_k(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    if tile == 4:  # tiles and shards bounded by their bytes
        monkeypatch.setattr(topk, "TILE_BYTES", 150)
        monkeypatch.setattr(topk, "SHARD_BYTES", 400)
        monkeypatch.setattr(topk, "GROUP_BYTES", 100)
    monkeypatch.setattr(topk, "FAN", 2)
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-0.5, 0.1, 0.3]) for _ in range(6)], "x", 1) for i in range(120)]
    rows += [(50, [0.3] * 6, "x", 1), (50, [0.3] * 6, "x", 1), (None, [1.0] * 6, "x", 1), (130, None, "x", 1), (131, [None] * 6, "x", 1), (132, [float("nan")] * 6, None, 1), (133, [float("inf")] * 6, "x", 1), (150, [1.0] * 3, "x", 1), (200, [3e30, -1.0], "x", 1), (201, [3e30, 2.0], "x", None)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, VECTORS).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect())
    want = top_model(rows)
    limit = np.iinfo(np.int64)
    assert got == Counter({(q, r, v, max(limit.min, min(limit.max, score))): n for (q, r, v, score), n in want.items()})
    assert [k[2] for k in got if k[0] == 200] == [201]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 150")).count() == 0


def test_exact_products():
    a = np.array([[1 << 40, -3]])
    assert topk.products(a, a).tolist() == [[np.iinfo(np.int64).max]]
    b = np.array([[1 << 30, 5]])
    assert topk.products(b, b).tolist() == [[(1 << 60) + 25]]
    c = np.array([[1e30, -1e30, 7.0]])
    assert topk.products(c, np.array([[1, 1, 1], [3, 2, 1]], np.int16)).tolist() == [[7, np.iinfo(np.int64).max]]
    assert topk.products(np.full((1, 9), 30_000, np.int16), np.full((1, 9), -30_000, np.int16)).tolist() == [[-8_100_000_000]]


def test_boosting_and_isotonic():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.Trees().fit(x, y).raw(x) > 0) == y).mean() > 0.95
    raw = rnd.normal(size=3000)
    at, share = boosting.isotonic(raw, (rnd.random(3000) < 1 / (1 + np.exp(-2 * raw))).astype(float))
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all() and share.min() >= 0 and share.max() <= 1
    assert abs(np.interp(0.0, at, share) - 0.5) < 0.1


def test_toxicity(spark, odd, odd_rows, none, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    for d, n in ((docs, docs.count()), (odd, len(odd_rows)), (none, 0)):
        rows = toxicity.score(d, labels).collect()
        assert len(rows) == n
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    no_labels = toxicity.score(odd, labels.limit(0)).collect()
    assert {r.score for r in no_labels} == {0.0}
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(odd_rows)


def test_toxicity_learns(spark, tmp_path):
    rnd = random.Random(9)
    plain = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1600):
        words = [rnd.choice(plain) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words[rnd.randrange(60)] = rnd.choice(["grobian", "idiot", "you", "FOOL!"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.score(spark.read.parquet(str(tmp_path / "d")), labels).filter("held_out").collect()
    assert len(found) > 300 and np.mean([r.predicted == (r.doc_id % 8 == 0) for r in found]) > 0.97


def test_language(spark, odd, odd_rows, none, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 11)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (7, 8)} == {"de"}
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


class KneserNey:
    """The model of one language with dictionaries, as the docstring and the paper have it."""

    def __init__(self, counts, alphabet, order=5, discount=0.75):
        self.order, self.floor = order, 1 / (alphabet + 2)
        raw = [Counter() for _ in range(order + 2)]
        left = [defaultdict(set) for _ in range(order + 1)]
        for w, c in counts.items():
            marked = language._START + w + language._END
            for end in range(1, len(marked)):
                for n in range(1, order + 1):
                    if end - n + 1 >= 0:
                        g = marked[end - n + 1 : end + 1]
                        raw[n][g] += c
                        if end - n >= 0:
                            left[n][g].add(marked[end - n])
        self.p, self.spare = {}, {}
        for n in range(1, order + 1):
            count = {g: c if n == order or g[0] == language._START else max(1, len(left[n][g])) for g, c in raw[n].items()}
            total, kinds = Counter(), Counter()
            for g, c in count.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.spare |= {h: discount * kinds[h] / total[h] for h in total}
            for g, c in count.items():
                below = self.p[g[1:]] if n > 1 else self.floor
                self.p[g] = (c - discount) / total[g[:-1]] + self.spare[g[:-1]] * below

    def next(self, before, char):
        """Probability of a character after what stands before it in the word."""
        back = 1.0
        for n in range(min(self.order, len(before) + 1), 0, -1):
            g = before[len(before) - n + 1 :] + char
            if g in self.p:
                return back * self.p[g]
            back *= self.spare.get(g[:-1], 1.0)
        return back * self.floor

    def word(self, w):
        marked = language._START + w + language._END
        return sum(np.log(self.next(marked[:i], marked[i])) for i in range(1, len(marked)))


def test_every_gram_is_kneser_ney_s():
    rnd = random.Random(11)
    words = Counter("".join(rnd.choice("aaabbcdéß中") for _ in range(rnd.randint(1, 9))) for _ in range(400))
    alphabet = len({c for w in words for c in w})
    own, want = language.Model(dict(words), alphabet), KneserNey(words, alphabet)
    held = {g for w in words for m in [language._START + w + language._END] for n in range(1, 6) for g in (m[i - n + 1 : i + 1] for i in range(max(1, n - 1), len(m)))}
    assert sum(len(k) for k, _ in own.grams) == len(held) == len(want.p)
    for n in range(1, 6):
        keys, values = own.grams[n - 1]
        mine = [g for g in held if len(g) == n]
        codes = np.frombuffer("".join(mine).encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.searchsorted(keys, list(language._hashes(codes))[n - 1][n - 1 :: n])
        assert np.allclose(values[at], [np.log(want.p[g]) for g in mine], rtol=1e-9)
    asked = list(words)[:50] + ["".join(rnd.choice("abxyzé") for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    codes, place, starts = language._flat(asked)
    assert np.allclose(own.word_scores(list(language._hashes(codes)), place, starts), [want.word(w) for w in asked], rtol=1e-9)
    letters = [*{c for w in words for c in w}, language._END, "☃"]
    for before in (language._START, language._START + "a", language._START + "abba", language._START + "xyz", language._START + "aaab"):
        assert sum(want.next(before, c) for c in letters) == pytest.approx(1.0, abs=1e-9)


def test_language_learns_from_bounded_samples(spark, tmp_path, monkeypatch):
    """A row that stands very often, long junk words, more languages than are learned; words beyond the cache."""
    monkeypatch.setattr(language, "LANGUAGES", 2)
    monkeypatch.setattr(language, "LEARN_WORDS", 30)
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choice(["das", "und", "nicht", "wörter", "straße"]) for _ in range(20)), "de") for i in range(60)]
    rows += [(100 + i, " ".join(rnd.choice(["the", "and", "words", "street", "thought"]) for _ in range(20)), "en") for i in range(60)]
    rows += [(1000, "the and " + "q" * 200_000, "en")] * 300 + [(2000, "rare", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id < 100} == {"de"} and {r.lang_pred for r in got if r.doc_id < 1000 and r.doc_id >= 100} == {"en"}
    assert {r.lang_pred for r in got} == {"de", "en"}
    model = language.learn(docs)
    texts = [r[1] for r in rows[:80]]
    whole = model.sums(texts)
    monkeypatch.setattr(language, "CACHE", 3)
    monkeypatch.setattr(language, "CACHE_CHARS", 10)
    model._forget()
    assert np.allclose(model.sums(texts), whole)


def test_toxicity_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Ids with several texts and with labels that contradict each other."""
    rnd = random.Random(5)
    rows = [(i % 120, " ".join(rnd.choice(["idiot", "you", "tree", "sun", f"w{rnd.randrange(50)}"]) for _ in range(rnd.randint(1, 30)))) for i in range(360)]
    marks = [(i % 120, 1, int(rnd.random() < 0.5)) for i in range(200)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = []
    for k in range(2):
        rnd.shuffle(rows)
        spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 4 * k).write.parquet(str(tmp_path / str(k)))
        found.append(Counter((r.doc_id, r.score) for r in toxicity.score(spark.read.parquet(str(tmp_path / str(k))), labels).collect()))
    assert found[0] == found[1]


def base_model(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rnd = random.Random(10)
    parts = [*"aZ09.@+-_% ()", "1", "22", "@", "a.b", "4111111111111111", "+1 ", "255", "é"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))
        assert pii.base_spans(text) == base_model(text), text
    assert pii.base_spans("1" * 200_000 + "@" * 50_000 + "a@" * 20_000 + "+1" * 20_000) == []


def test_field_on_unseen_zones():
    field, rnd = pii.field(), random.Random(123)
    right = wrong = missed = 0
    for _ in range(400):
        text, gold = pii._example(rnd)
        n, bounds, rows, spans = pii.candidates(text, 0, len(text))
        got = {(spans[c][0], k, spans[c][1]) for c, k in pii.best_segments(n, bounds, rows @ field.weights)} if len(bounds) else set()
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    text = "call +1 (269) 555-3296 4524132264652876 or john [at] mail [dot] example [dot] com, born 1987-06-05"
    assert pii.base_spans(text) == []
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in field.added(text, [])] == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("email", "john [at] mail [dot] example [dot] com")]


def test_field_finds_in_whole_texts():
    """Through the zones: numbers over any white space, and obfuscated addresses of few digits."""
    field, rnd = pii.field(), random.Random(77)

    def found(text):
        return [(pii.KINDS[k], text[a:b]) for a, k, b in field.added(text, pii.base_spans(text))]

    for gap in ("\u00a0", "\u202f", "\u2009", "\t"):
        for kind, value in [("phone", "+1 415 555 2671"), ("phone", "+44 20 7946 0958"), ("card", "4111 1111 1111 1111"), ("card", "3782 822463 10005")]:
            value = value.replace(" ", gap)
            assert found(f"Some words, then {value} and more.") == [(kind, value)]
    for value in ["10[.]0[.]0[.]1", "8[.]8[.]8[.]8", "127[.]0[.]0[.]1", "8(.)8(.)4(.)4", "1 [.] 1 [.] 1 [.] 1", "10.0.0[.]1", "192 [.] 168 [.] 100 [.] 200"]:
        assert found(f"Some words, then {value} and more.") == [("ip", value)]
    for text in ["1. 2. 3. 4. five", "1.) 2.) 3.) 4.)", "1[.]3[.]6[.]1[.]4", "300[.]1[.]2[.]3", "1[.]2[.]3", "2019\n2020\n2021\n2022", "12\t34\t56\t78"]:
        assert found(text) == []
    right = missed = 0
    for _ in range(400):
        made, gold = pii._example(rnd)
        text, base = f"Before it, {made} after it.", pii.base_spans(f"Before it, {made} after it.")
        got = set(field.added(text, base)) | set(base)
        for a, k, b in gold:
            if (a + 11, k, b + 11) in got:
                right += 1
            elif not any(x < b + 11 and a + 11 < y for x, _, y in base):
                missed += 1
    assert right / (right + missed) > 0.97


def marked(line):
    """A hand-labelled line's text and spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(email|ip|card|phone)\|((?:[^{}]|\{[^}]*\})*)\}", line):
        text += line[at : m.start()] + m[2]
        spans.append((len(text) - len(m[2]), pii.KINDS.index(m[1]), len(text)))
        at = m.end()
    return text + line[at:], spans


@pytest.mark.parametrize("lines", [pii_cases.CASES, pii_cases.HELD_OUT])
def test_field_on_hand_labelled_sentences(lines):
    right = wrong = missed = 0
    for line in lines:
        text, gold = marked(line)
        got = set(base := pii.base_spans(text)) | set(pii.field().added(text, base))
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right > 15 and right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


def test_segmentation_marginals():
    """Against all segmentations of a short zone."""
    bounds = np.array([(0, 1), (0, 2), (1, 3), (2, 3)])
    scores = np.random.default_rng(4).normal(size=(4, len(pii.KINDS)))
    weight = defaultdict(float)

    def walk(at, used, total):
        if at == 3:
            for u in used:
                weight[u] += np.exp(total)
            weight["all"] += np.exp(total)
            return
        walk(at + 1, used, total)
        for c, (a, b) in enumerate(bounds.tolist()):
            if a == at:
                for k in range(len(pii.KINDS)):
                    walk(b, [*used, (c, k)], total + scores[c, k])

    walk(0, [], 0.0)
    got = pii.expectations(3, bounds, scores)
    assert all(got[c, k] == pytest.approx(weight[c, k] / weight["all"]) for c in range(4) for k in range(len(pii.KINDS)))


def test_pii_on_odd_rows(spark, odd, odd_rows, none):
    rows = pii.find(odd).collect()
    assert len(rows) == len(odd_rows) and all(r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in rows)
    df = spark.createDataFrame([(1, "é a.b@c.de 1.2.3.4"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[1].spans == "email:2:10,ip:11:18" and (got[1].n_email, got[1].n_ip) == (1, 1)
    assert got[2].spans == ""
    assert pii.find(none).count() == 0
