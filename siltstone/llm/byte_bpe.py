"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merges of a rank file are compiled into a finite-state transducer. Its nondeterministic form reads a
word byte by byte and guesses where tokens end: a configuration is (last finished token, node of the token
trie, tokens not yet emitted). A guess may finish token ``t`` after token ``p`` only if merging the bytes of
``p + t`` alone gives exactly ``[p, t]``. A tokenisation whose neighbours all agree in this way is the BPE
result, and it is unique, so exactly one configuration is at a token end after every byte. Sets of
configurations become deterministic states when a text first reaches them; whatever all configurations agree
on is emitted at once, and the others die out within one token's length: the lookahead is bounded.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 machine, so a stream may be cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, in_worker, map_arrow

#: A run of white space and the run of other characters after it. No match of a splitting pattern that keeps
#: white space in front of words crosses the end of such a chunk. (U+001C to U+001F count as no white space.)
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
MEMO_CHARS, MEMO_ENTRIES, STATES = 48, 900_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """The lazily determinised transducer of one rank table; ``encode`` gives the ids of one pattern match."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node << 8 | byte -> node
        self.token = [-1]  # trie: node -> rank
        self.inner = [False]  # trie: node -> has children
        for t, r in ranks.items():
            node = 0
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = len(self.token)
                    self.child[node << 8 | b] = nxt
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = r
        self.agreed: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states found so far; they are found again when needed."""
        start = ((-1, 0, ()),)
        self.states, self.number = [start], {start: 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, word: bytes) -> list[int]:
        """BPE of a short byte string by repeated lowest-rank, leftmost merges; only pairs of tokens go through it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank, none = self.ranks.get, 1 << 40
        costs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def agree(self, before: int, token: int) -> bool:
        """May ``token`` stand after ``before`` (-1: at the start)?"""
        key = before << 32 | token
        known = self.agreed.get(key)
        if known is None:
            if before < 0:
                known = self.merged(self.bytes_of[token]) == [token]
            else:
                both = self.bytes_of[before] + self.bytes_of[token]
                known = both not in self.ranks and self.merged(both) == [before, token]
            if len(self.agreed) > 4 * self.max_states:
                self.agreed.clear()
            self.agreed[key] = known
        return known

    def advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state and the ids that are certain now."""
        live = []
        for before, node, out in self.states[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            if self.inner[node]:
                live.append((before, node, out))
            token = self.token[node]
            if token >= 0 and self.agree(before, token):
                live.append((token, 0, (*out, token)))
        if not live:
            raise ValueError(f"no token covers byte {byte}")
        outs = [c[2] for c in live]
        shared, shortest = 0, min(map(len, outs))
        while shared < shortest and all(o[shared] == outs[0][shared] for o in outs):
            shared += 1
        found = tuple(sorted((before, node, out[shared:]) for before, node, out in live))
        number = self.number.get(found)
        if number is None:
            number = len(self.states)
            self.states.append(found)
            self.number[found] = number
        result = (number, outs[0][:shared])
        self.step[state << 8 | byte] = result
        return result

    def encode(self, word: bytes) -> list[int]:
        """Ids of one match of the splitting pattern; a match that is a token as a whole is that token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        ids: list[int] = []
        state, step = 0, self.step
        for byte in word:
            known = step.get(state << 8 | byte)
            if known is None:
                known = self.advance(state, byte)
                if len(self.states) > 4 * self.max_states:  # within one enormous word
                    here = self.states[known[0]]
                    self.reset()
                    step = self.step
                    if here in self.number:
                        known = (self.number[here], known[1])
                    else:
                        self.states.append(here)
                        self.number[here] = len(self.states) - 1
                        known = (len(self.states) - 1, known[1])
            state = known[0]
            if known[1]:
                ids += known[1]
        ids += next(out for _, node, out in self.states[state] if node == 0)
        return ids


class Encoder:
    """Whole texts to ids: chunks, pattern matches, transducer; results of short chunks are kept in a bounded memo."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.memo: Memo = Memo(MEMO_ENTRIES, MEMO_CHARS)
        size = max(self.transducer.bytes_of, default=-1) + 1
        self.tokens = [self.transducer.bytes_of.get(i, b"") for i in range(size)]

    def compute(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian unsigned 32-bit integers."""
        encode, split, found = self.transducer.encode, self.pattern.findall, []
        for chunk in chunks:
            ids: list[int] = []
            for match in split(chunk):
                ids += encode(match.encode("utf-8", "replace"))
            found.append(array("I", ids).tobytes())
        return found

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, packed; None and empty texts have none."""
        return self.memo.join([CHUNK.findall(t or "") for t in texts], self.compute)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed."""
        return self.encode_batch([text])[0]

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))


class Utf8Stream:
    """Incremental UTF-8 machine: bytes cut anywhere come in, whole characters go out.

    The state is the unfinished character: its bytes so far and how many are missing. Malformed bytes become
    U+FFFD, as in ``bytes.decode("utf-8", "replace")``.
    """

    def __init__(self) -> None:
        self.tail = b""

    @staticmethod
    def missing(tail: bytes) -> int:
        """Bytes that the character begun in ``tail`` still lacks; 0 if it is complete or can't become valid."""
        lead = tail[0]
        need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
        if len(tail) > 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            if not low <= tail[1] <= high or any(not 0x80 <= b <= 0xBF for b in tail[2:]):
                return 0
        return max(0, need - len(tail))

    def feed(self, data: bytes) -> str:
        """The characters that ``data`` completes."""
        data = self.tail + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:  # the last byte that is no continuation
                if self.missing(data[-back:]):
                    cut -= back
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        """What is left at the end of the stream."""
        rest, self.tail = self.tail, b""
        return rest.decode("utf-8", "replace")


def decode_stream(encoder: Encoder, ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, as soon as characters are whole."""
    machine = Utf8Stream()
    for i in ids:
        if text := machine.feed(encoder.tokens[i]):
            yield text
    if text := machine.close():
        yield text


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process: its states and memo serve all its tasks."""
    return in_worker(("byte_bpe", path, pattern), lambda: Encoder(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row: the general form, with the ids themselves.

    A null or empty text has an empty array; repeated rows give repeated results; other columns are ignored.
    """
    schema = f"{id_col} bigint, ids array<int>"

    def make():
        enc = encoder(path, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(packed, "<i4") for packed in enc.encode_batch(batch.column(1).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

        return run

    return map_arrow(docs.selectExpr(f"cast({id_col} as bigint) {id_col}", f"cast({text_col} as string) {text_col}"), make, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids): the inverse of :func:`encode_documents`, through the UTF-8 machine."""

    def make():
        enc = encoder(path, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = ["".join(decode_stream(enc, ids or ())) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

        return run

    return map_arrow(encoded.select(id_col, "ids"), make, f"{id_col} bigint, text string")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every row; ids never leave the worker.

    The decoded bytes come from the ids; ``round_trip`` says that the UTF-8 machine, fed with them in pieces,
    gives the text again. A null text counts as empty: 0 tokens and the digests of nothing.
    """
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def make():
        enc = encoder(path, pattern)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_hash, text_hash, same = [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, packed in zip(texts, enc.encode_batch(texts), strict=True):
                machine, out, whole = Utf8Stream(), [], hashlib.sha256()
                for i in range(0, len(packed), 1 << 16):
                    data = enc.decode(packed[i : i + (1 << 16)])
                    whole.update(data)
                    out.append(machine.feed(data))
                out.append(machine.close())
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(whole.hexdigest())
                same.append("".join(out) == (text or ""))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

        return run

    return map_arrow(docs.selectExpr(f"cast({id_col} as bigint) {id_col}", f"cast({text_col} as string) {text_col}"), make, schema)
