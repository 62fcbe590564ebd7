"""Similarity joins against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import jaccard_join, vector_dedup
from siltstone.llm.common import components


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def smallest(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, smallest(ids, links), links


def corpus(seed, n_groups, size, length):
    """Groups of copies with few edits around the threshold, over a small vocabulary, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(12)]
    docs = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*length))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                at, what = rng.randrange(len(w)), rng.random()
                if what < 0.5:
                    w[at] = rng.choice(vocabulary)
                elif what < 0.75:
                    w.insert(at, rng.choice(vocabulary))
                elif len(w) > 1:
                    del w[at]
            if rng.random() < 0.3:
                w += passage
            docs.append((len(docs) + 1, " ".join(w)))
    return docs


@pytest.mark.parametrize(("seed", "length"), [(1, (4, 14)), (2, (8, 40)), (3, (60, 260))])
def test_components_equal_brute_force(spark, seed, length):
    docs = corpus(seed, 14, 12, length)
    sizes, component, links = brute(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(links) > 20
    assert got == {i: (sizes[i], component[i]) for i in sizes}


def test_every_similar_pair_shares_a_bucket():
    """The pigeonhole: no link of any sizes is lost by segments, neighbourhoods and allocation."""
    plan, sh = jaccard_join.Plan(), jaccard_join.Shingler()
    for seed, length in ((5, (4, 12)), (6, (5, 34)), (7, (20, 120))):
        docs = corpus(seed, 25, 10, length)
        sets = {i: sh.shingles(t) for i, t in docs}
        ids = np.array(list(sets), np.int64)
        for common in (np.empty(0, np.uint64), np.concatenate(list(sets.values()))[:50]):
            key, owner, flag = jaccard_join.entries([sets[i] for i in ids], ids, plan, common)
            buckets: dict = {}
            for k, o, f in zip(key.tolist(), owner.tolist(), flag.tolist(), strict=True):
                b = buckets.setdefault(k, {})
                b[o] = b.get(o, 0) | f
            met = {(min(x, y), max(x, y)) for b in buckets.values() for x, fx in b.items() if fx & 2 for y, fy in b.items() if x != y and fy & 1}
            for a, b in brute(docs)[2]:
                assert (a, b) in met or np.array_equal(sets[a], sets[b])


def test_bitmap_bound_never_rules_out():
    rng = np.random.default_rng(0)
    for n in (5, 60, 700):
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 8], rng.integers(0, 1 << 60, n // 8).astype(np.uint64)])
        bits = []
        for s in (x, y):
            flags = np.zeros(1024, np.uint8)
            flags[(jaccard_join.mix(s ^ jaccard_join.MIX_B) & np.uint64(1023)).astype(int)] = 1
            bits.append(np.packbits(flags, bitorder="little").tobytes())
        f = jaccard_join.folded(bits, 32)
        spare = [n - np.bitwise_count(b).sum() for b in f]
        assert jaccard_join.overlaps(f[:1], f[1:])[0, 0] + min(spare) >= len(np.intersect1d(x, y))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"), (7, "é É"), (8, "x y " * 20_000)]
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, id string, n long, component_id long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_components(d).collect())
    assert got == [(-1, 3, 6), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 3, 6), (6, 3, 6), (7, 1, 7), (8, 2, 8)]
    kept = jaccard_join.keep_representatives(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, None), (2, ""), (3, " \n"), (4, "One two"), (6, "a b c d e f g"), (7, "é É"), (8, "x y " * 20_000)], key=lambda x: x[0])
    assert jaccard_join.jaccard_components(d.limit(0)).count() == 0 and jaccard_join.keep_representatives(d.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = smallest(nodes, [e for e in edges if e[0] != e[1]])
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((60, 64))
        for i, v in enumerate(base):
            rows.append((len(rows), v.tolist(), label))
            for _ in range(3 if i % 3 else 12):
                noise = rng.standard_normal(64)
                noise *= np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.02, 0.3)
                rows.append((len(rows), (v + noise).tolist(), label))
    rows += [(9001, rows[0][1], 0), (9002, rows[0][1], 0), (9003, rows[0][1], None), (9004, None, 0), (9005, [0.0] * 64, 0), (9006, [float("nan")] * 64, 0), (9007, [None] * 64, 0), (9008, [1.0, 2.0], 0), (9009, [], 0)]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, class long, v string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if i < 9003]
    x = np.stack([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([y for *_, y in good])
    link = (x @ x.T >= 0.98) & (same[:, None] == same[None])
    np.fill_diagonal(link, False)
    want = link.sum(1)
    found = np.array([got[i].n_links for i, *_ in good])
    assert found.sum() >= 0.97 * want.sum() and (found <= want).all() and want.sum() > 200
    assert got[9001].n_links == got[0].n_links and got[9001].component_id == 0 and not got[9001].kept
    for i in range(9003, 9010):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vector_dedup.near_duplicates(d.limit(0)).count() == 0


def test_calibration():
    for n in (10, 5_000, 10**9):
        t = vector_dedup.calibrate(n, 0.98)
        assert t.least >= 3 and t.count < 3000
    assert Counter([vector_dedup.calibrate(16, 0.98).bits]) == Counter([0])
