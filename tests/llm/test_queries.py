"""The registered queries: SQL where there is some, the pipeline stage by stage."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_dedup import component_model, fingerprint_model, norm
from test_models import mixed_rows

import __spark_entry__ as entry
import corpus_pipeline
from quirework.llm import pieces, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


def test_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        assert docs.columns == columns or i == 4
    assert counts[0] > counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5] > 0
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() == counts[5] and sorted(r.ids_sha256 for r in whole.collect()) == sorted(r.ids_sha256 for r in docs.collect())


def test_pipeline_on_odd_rows(spark, odd, odd_rows, none, tmp_path):
    """Odd rows and clashing names through every stage; labels that are empty, or of no document."""
    for name, marks in (("empty", []), ("strange", [(10**9, 1, 1), (None, 1, 1), (1, 1, None)])):
        folder = tmp_path / name
        odd.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet")).withColumnRenamed("size", "shard").withColumnRenamed("uid", "position")
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, str(folder))
            assert out.columns == docs.columns or i == 4
            out.write.parquet(str(folder / str(i)))
            docs = spark.read.parquet(str(folder / str(i)))
            if stage == "toxicity":
                assert docs.count() == len(odd_rows)
            if stage == "exact dedup":
                assert docs.count() == len({norm(r[1]) for r in odd_rows})
        assert {r.doc_id for r in docs.collect()} <= {r[0] for r in odd_rows if norm(r[1])} and docs.count()
    folder = tmp_path / "none"
    none.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(folder))
    assert out.count() == 0 and out.columns == docs.columns


def test_pipeline_keeps_the_right_rows(spark, small, tmp_path):
    """Each stage's rows, every column, against a brute-force model of the stage on the rows before it."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    as_rows = lambda df: [r.asDict() for r in df.collect()]
    multiset = lambda rows: Counter(tuple(r[c] for c in columns) for r in rows)

    def through(name, docs):
        stages[name](spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, as_rows(out)

    rows = as_rows(docs)
    # scores are learned: the model is fitted once, and every text is decided alone
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet"))
    want = [r for r in rows if model.scores([(r["text"] or "").encode()])[0] < toxicity.THRESHOLD]
    docs, got = through("toxicity", docs)
    assert multiset(got) == multiset(want) and len(got) < len(rows)

    groups = defaultdict(list)
    for r in got:
        groups[norm(r["text"])].append(r)
    want = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    docs, got = through("exact dedup", docs)
    assert multiset(got) == multiset(want)

    groups = defaultdict(list)
    for r, label in zip(got, component_model([fingerprint_model(r["text"]) for r in got]), strict=True):
        groups[label].append(r)
    want = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    docs, got = through("near dedup", docs)
    assert multiset(got) == multiset(want)

    want = [{k: r[k] for k in columns} for r in mixed_rows(spark, got)]
    docs, got = through("mixing", docs)
    assert multiset(got) == multiset(want)

    library, want = pieces.Encoder(queries.tokenizer_file("piece_bpe_32k.model")).library, Counter()
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), tuple(ids)] += 1
    _, got = through("tokens", docs)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want
