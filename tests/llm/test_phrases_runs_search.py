"""Collocations, periodic runs and top-k search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import collocations, queries, topk_search, word_runs

# --- collocations -------------------------------------------------------------------------------------------------


def plain_collocations(docs, least, top):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    held = {(lang, w[i : i + k]) for (lang, w), c in f.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if f[lang, w[i : i + k]] <= c}
    rows = []
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in held:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]], n[lang]))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right, total in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def phrase_rows(found):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def made_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "the", "The", "a\x01", "a", "ß", "日本"]
    lines = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            w = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 9))
            parts.append(rng.choice(lines) if rng.random() < 0.3 else rng.choice([" ", "  ", "\t"]).join(w))
        out.append((rng.choice([". ", "\n", ", ", "\x0b", "?! "]).join(parts), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("least,top", [(3, 2000), (8, 5), (1, 50)])
def test_collocations(spark, least, top):
    docs = [*made_texts(least, 150), (None, "en"), ("", None), ("hot pair " * 400, "en"), *[("hot pair of words", "de")] * 40]
    df = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate(docs)], "doc_id bigint, text string, lang string, at int")
    assert phrase_rows(collocations.collocations(df, least, top)) == plain_collocations(docs, least, top)


def test_collocations_when_prefixes_are_hot(spark, monkeypatch):
    """Hot words, pairs and triples are dealt by more words and their parts summed."""
    monkeypatch.setattr(collocations, "HOT_PARTS", 10)
    rng = random.Random(5)
    docs = [(f"the very same w{rng.randrange(40)} w{rng.randrange(40)}. the x{rng.randrange(9)} y", "en") for _ in range(1500)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(6)
    bits = b"\xff" * (1 << 21)  # nothing is cut
    hot = collocations.hot_prefixes(collocations.suffix_rows(df.selectExpr("lang", "cast(text as binary) text"), bits).where("s <> X''"))
    assert len(hot) > 2 and hot[1]
    assert phrase_rows(collocations.collocations(df, 4, 2000)) == plain_collocations(docs, 4, 2000)


def test_collocations_when_all_buckets_are_full(spark, monkeypatch):
    """The buckets only save work."""
    docs = made_texts(9, 80)
    df = spark.createDataFrame(docs, "text string, lang string")
    monkeypatch.setattr(collocations, "frequent_buckets", lambda rows, least: b"\xff" * (1 << 21))
    assert phrase_rows(collocations.collocations(df, 3)) == plain_collocations(docs, 3, 2000)


def test_bucket_counts_of_large_tasks(spark, monkeypatch):
    """Counts that are gathered in several steps, and full blocks."""
    docs = made_texts(11, 120)
    rows = spark.createDataFrame(docs, "text string, lang string").selectExpr("coalesce(lang, 'und') lang", "cast(text as binary) text").coalesce(1)
    once = collocations.frequent_buckets(rows, 3)
    for name, value in (("GATHERED", 500), ("ROWS", 10)):
        monkeypatch.setattr(collocations, name, value)
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    steps = np.zeros(8 * len(once), np.int64)
    for out in collocations.sketch_rows(iter([batch])):
        for block, at, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            place = np.arange(collocations.BLOCK) if at is None else np.frombuffer(at, np.uint16).astype(np.int64)
            steps[block * collocations.BLOCK + place] += np.frombuffer(n, np.uint8)
    assert np.packbits(steps >= 3).tobytes() == once


def test_collocations_of_nothing(spark):
    for docs in ([], [(None, None)], [("   \t .,", "en")], [("few words", "en")]):
        assert collocations.collocations(spark.createDataFrame(docs, "text string, lang string")).count() == 0


def test_collocation_arithmetic_passes_64_bits(spark):
    big = 10**14
    phrases = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 3)], "lang string, k int, phrase string, f bigint")
    row = collocations.scored(phrases, spark.createDataFrame([("en", 10**16 - 1)], "lang string, n bigint")).first()
    assert row.score == 1000 * (big - 3) * (10**16 - 1) // (big * (big + 7))


# --- periodic runs ------------------------------------------------------------------------------------------------


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            s = w[start : start + length]
            if length >= max(6, 4 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_words(rng):
    kind = rng.randrange(6)
    small = [f"v{i}" for i in range(rng.choice([1, 2, 3, 8]))]
    if kind == 0:
        return rng.choices(small, k=rng.randint(0, 120))
    w = []
    for _ in range(rng.randint(1, 5)):
        unit = rng.choices(small if kind < 3 else [f"u{i}" for i in range(60)], k=rng.randint(1, 12))
        w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))] + rng.choices(small, k=rng.randint(0, 3))
    return w


def test_runs_of_single_texts():
    rng = random.Random(1)
    texts = [[x.encode() for x in made_words(rng)] for _ in range(1500)]
    for k in range(0, len(texts), 100):
        for w, found in zip(texts[k : k + 100], word_runs.find_runs(texts[k : k + 100]), strict=True):
            assert [(r.start, r.length, r.period) for r in found] == plain_runs(w)


def test_lag_counts_of_frequent_and_rare_words():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, rng.integers(1, 400), n) for n in (0, 1, 3, 50, 700, 5000)]
    for w, counts in zip(texts, word_runs.lag_counts([word_runs.numbered([b"%d" % x for x in w]) for w in texts]), strict=True):
        assert counts[1:].tolist() == [int((w[q:] == w[:-q]).sum()) for q in range(1, len(w) // 4 + 1)]


def test_one_word_for_a_long_text():
    w = [b"a"] * 60_000
    assert [(r.start, r.length, r.period) for r in word_runs.find_runs([w])[0]] == [(0, 60_000, 1)]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), math.floor(1000 * top[1] / top[2]) if top else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_a_table(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(made_words(rng))) for i in range(300)] + [(None, "a " * 9), (7, None), (10**12, ""), (5, "x y"), (5, "x y"), (6, "É b " * 12)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, n_runs string")
    found = word_runs.digests(word_runs.periodic_runs(df, plant=True)).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=order) == sorted((plain_row(*d) for d in docs), key=order)
    assert sum(r.n_runs > 0 for r in found) > 100


def test_registered_runs(spark):
    """The query on all given documents of up to 400 words."""
    folder = "/root/testdata/sf0.001"
    wanted = {r.doc_id: plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len((r.text or "").split()) <= 400}
    found = {r.doc_id: tuple(r) for r in queries.op12_word_runs(spark, folder).collect()}
    assert len(wanted) > 50 and all(found[i] == row for i, row in wanted.items())


def test_runs_of_an_empty_table(spark):
    assert word_runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- top-k search -------------------------------------------------------------------------------------------------


def plain_topk(rows, every, k):
    ints = lambda v: [math.floor(256 * x) for x in v]
    good = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in dict(sorted(((i, v) for i, v in good if i % every == 0), key=lambda r: r[1], reverse=True)).items():
        found = sorted((-min(max(sum(a * b for a, b in zip(v, x, strict=True)), -(2**63)), 2**63 - 1), i) for i, x in good if i != q and len(x) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def topk_rows(found):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("kind", ["spread", "grouped", "large"])
def test_topk(spark, kind, monkeypatch):
    monkeypatch.setattr(topk_search, "SAMPLE", 20)
    monkeypatch.setattr(topk_search, "BATCH", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24)) if kind != "grouped" else rng.standard_normal((8, 24))[rng.integers(0, 8, 400)] + 0.02 * rng.standard_normal((400, 24))
    x = x * (1e13 if kind == "large" else 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1010, [None] * 24), (1020, [float("nan")] * 24), (1030, [float("inf")] + [0.0] * 23), (1040, []), (1041, []), (1050, [0.5] * 3), (1051, [1.5] * 3), (None, [0.0] * 24), (1060, [0.0] * 24)]
    rows += [(i, rows[10][1]) for i in range(1100, 1112)]  # more equal vectors than results
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int").repartition(5)
    assert topk_rows(topk_search.exact_topk(df, 10, 5)) == plain_topk(rows, 10, 5)


def test_topk_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((120, 5)).astype(np.float32).astype(float))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk_rows(topk_search.exact_topk(df, 3, 4)) == plain_topk(rows, 3, 4)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = (np.floor(256 * rng.standard_normal((50, 30))) for _ in range(2))
    for n in topk_search.LEVELS:
        assert (topk_search.features(x, n) @ topk_search.features(y, n).T >= x @ y.T - 1e-6).all()


def test_topk_of_few(spark):
    for rows in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, [1.0]), (3, [2.0])]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        assert topk_rows(topk_search.exact_topk(df)) == plain_topk(rows, 50, 5)
