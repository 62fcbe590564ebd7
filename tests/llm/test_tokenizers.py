"""Byte-level BPE, packing and token counts against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from siltstone.llm import byte_bpe, packing, token_counts

RANKS = path("byte_bpe_multi_50k.tiktoken")
MODEL = path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n_tokens string, word string, bucket string"
ODD = [(1, None), (2, ""), (3, " "), (4, "\n\n\n  a\t\x1cb \x85　'sre it's 'LL 12٣ 漢字😀"), (5, "same text here"), (5, "same text here"), (6, "x" * 30_000), (7, "<|endoftext|> a <s> ▁ b</s>"), (None, "no id"), (8, "a b " * 9_000)]


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def odd(spark):
    return spark.createDataFrame([(i, t, None, "clash", "clash", "clash") for i, t in ODD], SCHEMA)


TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("aeiou thns'\n\t .,12é漢😀")), st.characters(codec="utf-8")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_the_librarys(encoder, library, text):
    packed = encoder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


def test_states_may_be_forgotten(library):
    small = byte_bpe.Encoder(RANKS, PATTERN)
    small.transducer.max_states = 5
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(small.encode(t), "<u4").tolist() == library.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_utf8_machine(data, cuts):
    machine, out, at = byte_bpe.Utf8Stream(), [], 0
    for cut in [*sorted(min(c, len(data)) for c in cuts), len(data)]:
        out.append(machine.feed(data[at:cut]))
        at = cut
    assert "".join([*out, machine.close()]) == data.decode("utf-8", "replace")


def test_documents(spark, library):
    got = byte_bpe.encode_digests(odd(spark), RANKS, PATTERN).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got)
    want = sorted((len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in ODD)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(odd(spark), RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in ODD)
    assert byte_bpe.encode_digests(odd(spark).limit(0), RANKS, PATTERN).count() == 0


def test_packing(spark):
    got = packing.pack_documents(odd(spark), path("byte_bpe_50k.json"), capacity=256, groups=2).toPandas()
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = {}
    for i, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            key = (i or -1, s, len(part), zlib.crc32(part.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    found = {}
    for r in got.itertuples():
        key = (-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        found[key] = found.get(key, 0) + 1
    assert found == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all() and seq.length.sum() <= 256
    assert packing.pack_documents(odd(spark).limit(0), path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins: list[int] = []
    want = []
    for s in sorted(sizes, reverse=True):
        b = next((i for i, used in enumerate(bins) if used + s <= 50), len(bins))
        if b == len(bins):
            bins.append(0)
        want.append((s, b, bins[b]))
        bins[b] += s
    got = packing.first_fit_decreasing(sizes, 50)
    assert sorted((s, *p) for s, p in zip(sizes, got, strict=True)) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abc ▁\n\t.é漢<s/>")), st.characters(codec="utf-8")), max_size=60))
def test_counts_are_the_librarys(text):
    counts = token_counts.piece_counts(MODEL)
    assert sum(counts.count(token_counts.words_of(text))) == len(counts.sp.encode(text)) if text else True


def test_token_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(odd(spark), MODEL, limit=100, buckets=3).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in ODD)
    assert token_counts.count_tokens(odd(spark).limit(0), MODEL).count() == 0
