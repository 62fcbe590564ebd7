"""Learned sentence boundaries against a plain version, and on abbreviations, initials and decimals."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from siltstone.operators import chunkers, sentences
from siltstone.operators.sentences import SentenceModel


def plain_counts(texts):
    stopped, bare = Counter(), Counter()
    for t in texts:
        for w in (t or "").lower().split():
            base = w[:-1] if w.endswith(".") else w
            if re.fullmatch(r"[^\W\d_][^\W\d_.]*(?:\.[^\W\d_.]*)*", base):
                (stopped if w.endswith(".") else bare)[base] += 1
    return stopped, bare


def plain_abbreviations(texts):
    stopped, bare = plain_counts(texts)
    n, k = sum(stopped.values()) + sum(bare.values()), sum(stopped.values())
    p, out = k / n, {}
    for w, s in stopped.items():
        if s >= sentences.SEEN:
            b, letters = bare[w], len(w.replace(".", ""))
            ratio = 2 * (s * math.log(0.99) + b * math.log(0.01) - s * math.log(p) - b * math.log(1 - p))
            out[w] = (s, b, ratio * math.exp(-letters) * (w.count(".") + 1) * letters**-b)
    return out


def plain_starters(texts, known):
    after, n = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        for before, x in zip(["", *w], w, strict=False):
            if re.fullmatch(r"[^\W\d_]+", x) and x[0].isupper():
                before = before.lower()
                mark = before[-1:] in {".", "!", "?"} and not (before.endswith(".") and (before[:-1] in known or len(before) == 2))
                n[x.lower()] += 1
                after[x.lower()] += mark
    total, every = sum(n.values()), sum(after.values())
    log = lambda h, m, p: h * math.log(min(max(p, 1e-9), 1 - 1e-9)) + (m - h) * math.log(1 - min(max(p, 1e-9), 1 - 1e-9))
    out = {}
    for w in n:
        if after[w] and total > n[w]:
            own, other = after[w] / n[w], (every - after[w]) / (total - n[w])
            score = 2 * (log(after[w], n[w], own) + log(every - after[w], total - n[w], other) - log(after[w], n[w], every / total) - log(every - after[w], total - n[w], every / total))
            out[w] = (after[w], n[w], score if own > other else 0.0)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    nouns = [f"{a}{b}" for a in ("river", "stone", "market", "letter") for b in ("", "s", "house", "side")]
    out = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 8)):
            body = " ".join(rng.choices([*nouns, "and", "of", "runs", "keeps"], k=rng.randint(3, 9)))
            kind = rng.random()
            if kind < 0.3:
                body += f" with {rng.choice(['Dr.', 'Prof.', 'e.g.', 'approx.', 'St.'])} {rng.choice(['Miller', 'Stone', 'Brown'])} {rng.choice(nouns)}"
            elif kind < 0.4:
                body += f" by J. {rng.choice(['Miller', 'Brown'])} at 3.14 percent"
            parts.append(f"{rng.choice(['The', 'However', 'They', 'Brown'])} {body}{rng.choice('..!?')}")
        out.append(" ".join(parts))
    return [*out, None, ""]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_statistics_equal_a_plain_version(docs, texts):
    found = {r.type: (r.stopped, r.bare, pytest.approx(r.score)) for r in sentences.abbreviations(sentences.type_counts(docs)).collect()}
    assert found == plain_abbreviations(texts) and len(found) > 10
    known = [w for w, x in plain_abbreviations(texts).items() if x[2] >= sentences.ABBREVIATION]
    found = {r.type: (r.after, r.n, pytest.approx(r.score, abs=1e-6)) for r in sentences.starters(docs, known).collect()}
    assert found == plain_starters(texts, set(known)) and len(found) > 3


def test_model(docs):
    model = sentences.fit(docs)
    assert {"dr", "prof", "e.g", "st"} <= model.abbreviations and not {"river", "rivers", "runs"} & model.abbreviations
    assert {"the", "however", "they"} <= model.starters and "miller" not in model.starters


MODEL = SentenceModel(frozenset({"dr", "e.g", "approx", "inc"}), frozenset({"the", "however"}))


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("Dr. Miller came. He left.", ["Dr. Miller came.", "He left."]),
        ("It was J. R. Brown who spoke. Nobody heard.", ["It was J. R. Brown who spoke.", "Nobody heard."]),
        ("It cost 3.50 or approx. 4 coins. Cheap!", ["It cost 3.50 or approx. 4 coins.", "Cheap!"]),
        ("He works at Stone Inc. The firm is old.", ["He works at Stone Inc.", "The firm is old."]),
        ("Use tools, e.g. hammers. Done?  Yes.", ["Use tools, e.g. hammers.", "Done?", "Yes."]),
        ('"Stop!" he said. (See Dr. Wu.) However, no.', ['"Stop!"', "he said.", "(See Dr. Wu.)", "However, no."]),
        ("On the 3. of May. In 1990. Then", ["On the 3. of May.", "In 1990.", "Then"]),
        ("Wait... what", ["Wait...", "what"]),
        ("", []),
        ("  \n ", []),
        ("no mark at all", ["no mark at all"]),
    ],
)
def test_boundaries(text, wanted):
    assert sentences.cut(text, MODEL) == wanted


def test_no_word_is_lost(texts):
    for t in texts:
        assert " ".join(sentences.cut(t or "", MODEL)).split() == (t or "").split()


def test_sentence_windows_by_the_model(spark):
    d = spark.createDataFrame([(1, "Dr. Miller came home late. He left again soon. They slept."), (2, None)], "doc_id long, text string")
    config = chunkers.ChunkConfig(window=0, min_chunk_size=1, sentences=MODEL)
    assert [r.text for r in chunkers.sentence_window(d, config).orderBy("chunk_index").collect()] == ["Dr. Miller came home late.", "He left again soon.", "They slept."]
    assert chunkers.sentence_window(d, chunkers.ChunkConfig(window=0, min_chunk_size=1)).count() == 4


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None)], [(1, "no stop")], [(1, "Only. stops.")]):
        assert sentences.fit(spark.createDataFrame(rows, "doc_id long, text string")) == SentenceModel(frozenset(), frozenset())
