"""SentencePiece, wavelet files and WARC archives: library results and exact round trips."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quirework.llm import pieces, token_files, warc, wavelet
from quirework.llm.queries import tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


def odd_texts(seed, n=1500):
    rnd = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "▁", "\0", "é", "É", "é", "𝔘", "<s>", "<0x41>", "\t", "ing", ".", ",", "...", "it's", " ", "\x1c", "\x85", "12", "Σ", "İ", "ﬁ", "中", "<|endoftext|>", "<|ENDOFTEXT|>", " \n", "\n "]
    return ["", "\n", " ", "▁"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(n)]


def test_pieces_are_the_library_s():
    own, texts = pieces.Encoder(PIECES), odd_texts(1)
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == own.library.encode(texts, add_bos=True, add_eos=True)


def test_pieces_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    own, texts = pieces.Encoder(PIECES), [" ".join(f"w{i}x" for i in range(k, k + 12)) for k in range(6)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == own.library.encode(texts, add_bos=True, add_eos=True)


def test_a_difference_stops_the_job():
    own = pieces.Encoder(PIECES)
    own.vocabulary.scores = [-s for s in own.vocabulary.scores]
    with pytest.raises(ValueError):
        own.encode(["international understanding"])


@pytest.mark.parametrize("key, piece", [("\nwort", "wort"), ("\0wort", "wort"), ("\0▁wort", "▁wort"), ("\0▁▁▁wort", "▁▁▁wort"), ("\0▁▁", "▁▁"), ("\0▁", "▁"), ("\0\n", "\n"), ("\0\0x", "\0x")])
def test_every_kind_of_piece_is_checked(key, piece):
    own = pieces.Encoder(PIECES)
    own._new([key])
    right = own.vocabulary.encode_piece
    own.vocabulary.encode_piece = lambda text: [5, *right(text)[1:]] if text == piece else right(text)
    with pytest.raises(ValueError):
        own._new([key])


def test_whole_texts_of_any_length_are_checked(monkeypatch):
    own, stopped = pieces.Encoder(PIECES), 0
    texts = [[f"a{i}", f"wort  and some more\nwords {i}" * 9] for i in range(40)]
    for t in texts:
        own.encode(t)
    own.cache["\0▁▁and"] = own.cache["\0▁more"]
    for t in texts:
        try:
            own.encode(t)
        except ValueError:
            stopped += 1
    assert 5 < stopped < 35
    monkeypatch.setattr(pieces, "CACHE", 5)
    own = pieces.Encoder(PIECES)
    own._new([f"w{i}" for i in range(6)])
    right = own.vocabulary.encode_piece
    own.vocabulary.encode_piece = lambda text: right(text) if len(text) < 20 else right(text)[::-1]
    own._new = lambda keys: None
    with pytest.raises(ValueError):
        own.encode(["a", " ".join(f"v{i}" for i in range(20))])


def test_pieces_on_odd_rows(spark, odd, odd_rows, none):
    own = pieces.Encoder(PIECES)
    want = Counter()
    for r in odd_rows:
        ids = own.library.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.library.decode(ids).encode()).hexdigest(), tuple(ids)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in pieces.encode(odd, PIECES).collect())
    assert got == want
    assert pieces.encode(none, PIECES).count() == 0


def test_words_are_the_library_s(monkeypatch):
    own, texts = token_files.WordEncoder(WORDS), odd_texts(2)
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(own.encode(t.encode()), own.kind).tolist() for t in texts] == want
    monkeypatch.setattr(token_files, "CACHE", 7)
    small = token_files.WordEncoder(WORDS)
    assert [np.frombuffer(small.encode(t.encode()), small.kind).tolist() for t in texts[:300]] == want[:300]


@pytest.mark.parametrize("n", [0, 1, 9, 70_000])
def test_wavelet(n):
    rnd = np.random.default_rng(n)
    tokens = (rnd.zipf(1.3, n) % 49_408).astype(np.uint16)
    shard = wavelet.Shard(wavelet.build(tokens, [5, None], [n // 2, n - n // 2], 16))
    assert (shard.tokens() == tokens).all() and shard.n == n
    assert [(i, a, len(t)) for i, a, t in shard.documents()] == [(5, 0, n // 2), (None, n // 2, n - n // 2)]
    assert shard.count(49_407 if n == 0 else 65_000) == 0 and shard.count(1 << 20) == 0
    for i in rnd.integers(0, n, 25).tolist() if n else []:
        c = int(tokens[i])
        places = np.flatnonzero(tokens == c)
        k = int(rnd.integers(0, len(places)))
        assert (shard.token(i), shard.count(c), shard.count(c, i), shard.place(c, k)) == (c, len(places), int((tokens[:i] == c).sum()), places[k])
    with pytest.raises(IndexError):
        shard.token(n)


@pytest.mark.parametrize("tokens", [1 << 25, 1000])
def test_token_files_on_odd_rows(spark, odd, odd_rows, none, monkeypatch, tokens):
    """With a thousand tokens a range there are more ranges than documents."""
    monkeypatch.setattr(token_files, "RANGE_TOKENS", tokens)
    own = token_files.WordEncoder(WORDS)
    got = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in token_files.round_trip(odd, WORDS).collect())
    ids = [(r[0], own.library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in odd_rows]
    assert Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids) == Counter((i, n, c) for _, n, i, c in got)
    assert [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got[:-1])]).tolist()
    order = [g[2] for g in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(none, WORDS).count() == 0


PAGES = "page_id long, url string, html string, uid string, ref_uid int"


def test_warc(spark, tmp_path):
    big, mid = "<p>" + "ü" * 300_000, "m" * 1000
    rows = [(1, "http://x/a b", big), (2, None, big), (3, "u", mid), (9, "u", mid), (9, "u", mid), (4, "u", "s" * 999), (5, "u", "s" * 999), (6, None, None), (7, "u", ""), (None, "u", mid), (8, "http://x\r\nEvil: 1", "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    path = str(tmp_path / "pages")
    df.repartition(3).write.parquet(path)
    pages = spark.read.parquet(path)
    where = f"file://{tmp_path}/warc"
    warc.write(pages, where, chunk=4096)
    assert spark.read.parquet(where).filter("chunk > 0").count() > 100
    got = warc.read(spark, where).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows)
    roles = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert roles == Counter([(1, "revisit", 2), (2, "response", None), (3, "revisit", 9), (9, "response", None), (9, "revisit", 9), (None, "revisit", 9), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)])
    file = str(tmp_path / "all.warc.gz")
    warc.export(spark, where, file)
    text = gzip.open(file).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) and b"\r\nEvil" not in text and big.encode() in text
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [0, 4, 8])
@pytest.mark.parametrize("twice", [False, True])
def test_a_lost_or_repeated_chunk_is_found(spark, tmp_path, chunk, twice):
    pages = spark.createDataFrame([(1, "u", "".join(chr(97 + i % 26) for i in range(9_000))), (2, "u", "short")], "page_id long, url string, html string")
    where = f"file://{tmp_path}/warc"
    warc.write(pages, where, chunk=1000)
    rows = spark.read.parquet(where)
    assert rows.count() == 10 and warc.read(spark, where).count() == 2
    long = rows.filter("chunk > 0 or not last")
    broken = rows.unionByName(long.filter(long.chunk == chunk)) if twice else rows.filter((rows.chunk != chunk) | (rows.last & (rows.chunk == 0)))
    broken.write.parquet(f"{where}-broken")
    with pytest.raises(Exception, match="is missing"):
        warc.read(spark, f"{where}-broken").collect()


def test_an_empty_archive_exports(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/warc")
    warc.export(spark, f"file://{tmp_path}/warc", str(tmp_path / "none.warc.gz"))
    assert (tmp_path / "none.warc.gz").read_bytes() == b"" and warc.read(spark, f"file://{tmp_path}/warc").count() == 0


def test_a_changed_payload_is_found(spark):
    row = {"page_id": 1, "uid": 1, "url": None, "ref_uid": None, "ref_page_id": None}
    import zlib as z

    head = warc._head(row, 3, hashlib.sha1(b"abc").digest())
    press = z.compressobj(1, wbits=31)
    data = press.compress(head + b"abd\r\n\r\n") + press.flush()
    with pytest.raises(ValueError):
        warc.Reader().row(data, True, hashlib.sha1(b"abc").hexdigest())


def test_a_worker_keeps_things_of_one_operator():
    from quirework.llm.common import kept

    first = pieces.encoder(PIECES)
    assert pieces.encoder(PIECES) is first
    kept("mixing")["a"] = 1
    assert kept("mixing") == {"a": 1} and pieces.encoder(PIECES) is not first and kept("mixing") == {}
