"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quirework.llm import bktree, components, exact_dedup, golomb, simhash


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_model(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows, as a multiset."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, t))
    out = Counter()
    for n, members in groups.items():
        order = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha = hashlib.sha256(n.encode()).hexdigest()
        for k, (i, _) in enumerate(order):
            out[i, order[0][0], len(order), k == 0, sha] += 1
    return out


def as_rows(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_golomb_round_trip():
    rnd = np.random.default_rng(1)
    for n, universe in [(0, 10), (1, 1), (5, 5), (1000, 1 << 40), (300, 301)]:
        values = np.sort(rnd.choice(universe, n, replace=False)) if universe < 1 << 20 else np.unique(rnd.integers(0, universe, n))
        k = golomb.parameter(universe, len(values))
        assert (golomb.decode(*golomb.encode(values, k), len(values), k) == values).all()
    dense = np.arange(0, 4000, 4)
    unary, low = golomb.encode(dense, golomb.parameter(4000, 1000))
    assert len(unary) + len(low) < 1000


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_exact_on_odd_rows(spark, odd, odd_rows, none, broadcast_rows):
    assert as_rows(exact_dedup.exact_groups(odd, broadcast_rows=broadcast_rows)) == exact_model([r[:2] for r in odd_rows])
    kept = exact_dedup.drop_copies(odd, broadcast_rows=broadcast_rows)
    assert kept.columns == odd.columns
    assert kept.count() == len({norm(r[1]) for r in odd_rows})
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


@pytest.mark.parametrize("most", [1 << 21, 8])
def test_exact_on_random_rows(spark, tmp_path, monkeypatch, most):
    """With eight rows an owner there are many more owners than partitions."""
    monkeypatch.setattr(exact_dedup, "OWNER_ROWS", most)
    rnd = random.Random(2)
    rows = [(rnd.randrange(60), "".join(rnd.choice("ab \t") for _ in range(rnd.randrange(6)))) for _ in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    assert as_rows(exact_dedup.exact_groups(spark.read.parquet(str(tmp_path / "t")))) == exact_model(rows)


def fingerprint_model(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_model(fps, radius=4):
    """Label (smallest index) of each fingerprint by all pairs."""
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def near_fingerprints(rnd, n):
    """Clusters, chains and strangers."""
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        base = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 4, 5, 6])):
            base ^= 1 << b
        out.append(base)
    return list(dict.fromkeys(out))


def test_forest_finds_all_in_reach():
    fps = near_fingerprints(random.Random(3), 300)
    group = np.sort(np.random.default_rng(0).integers(0, 4, len(fps)))
    values = np.array(fps, np.uint64)
    forest = bktree.Forest(group, values)
    found = set()
    for q, node in forest.within(values, forest.root, 4):
        found |= set(zip(q.tolist(), node.tolist(), strict=True))
    assert found == {(a, b) for a in range(len(fps)) for b in range(len(fps)) if group[a] == group[b] and (fps[a] ^ fps[b]).bit_count() <= 4}


@pytest.mark.parametrize("shard", [1024, 8])
def test_links_connect_all_in_reach(spark, monkeypatch, shard):
    """With shards of eight every group is split into trees that search each other."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    if shard == 8:
        monkeypatch.setattr(simhash.F, "sqrt", lambda c: simhash.F.lit(0.0))
    fps = near_fingerprints(random.Random(4), 250)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = {r.node: r.label for r in components.components(simhash.near_links(df)).collect()}
    want = component_model(fps)
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[want[i]].add(labels.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_on_chains(spark):
    rnd = random.Random(6)
    nodes = rnd.sample(range(10**6), 60)
    edges = [(nodes[i], nodes[i + 1]) for i in range(39)] + [(nodes[0], nodes[0]), (nodes[50], nodes[51]), (nodes[51], nodes[50])]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes[:40]) for n in nodes[:40]} | {n: min(nodes[50:52]) for n in nodes[50:52]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_on_odd_rows(spark, odd, odd_rows, none):
    fps = [fingerprint_model(r[1]) for r in odd_rows]
    label = component_model(fps)
    least = defaultdict(lambda: None)
    for r, of in zip(odd_rows, label, strict=True):
        if r[0] is not None and (least[of] is None or r[0] < least[of]):
            least[of] = r[0]
    want = Counter((r[0], f, least[of]) for r, f, of in zip(odd_rows, fps, label, strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(odd).collect())
    assert got == want
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(label))
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
