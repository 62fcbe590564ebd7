"""Secret scanning with corpus-wide ownership frequency.

One pass finds candidates: the base patterns' matches and other long mixed tokens of high entropy. Hashes of
their values are counted by distinct repositories and owners over the whole corpus. A value in several repositories
of several owners is an example that was copied from some manual; one that few owners hold, or that never leaves a
repository, is somebody's own. How many owners are several, the corpus' own ownership counts say: as many as no more
than one value in twenty reaches, two at least and EXAMPLE_OWNERS at most. If a value of somebody's own looks random too, it is taken for live, and its value (inside a base match, or on
its own) becomes a span of the kind ``live``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, in_worker, map_arrow, materialize, slices, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NAMES = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "live")
#: Bits a character that a token outside the base patterns must reach, and a base value too unless this share of its
#: length's most is less; distinct owners from which a value is an example in any corpus; the share of all values that
#: fewer owners (two at least) may make examples.
MIN_ENTROPY, ENTROPY_SHARE, EXAMPLE_OWNERS, EXAMPLE_SHARE = 3.3, 0.75, 4, 0.05
CANDIDATE = "array<struct<kind:int,start:bigint,stop:bigint,value_start:bigint,random:boolean,hash:bigint>>"


def entropy(token: str) -> float:
    """Shannon bits a character."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def looks_random(value: str) -> bool:
    """Whether a base value has the entropy of a generated one, as far as its length allows."""
    return entropy(value) >= min(MIN_ENTROPY, ENTROPY_SHARE * math.log2(len(value)))


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, by start and kind; ends are exclusive code points."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def extra_spans(text: str | None, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of letters and digits with high entropy that no base span touches."""
    found = []
    for m in TOKEN.finditer(text or ""):
        t = m[0]
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) and entropy(t) >= MIN_ENTROPY and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            found.append((m.start(), 3, m.end(), t))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of (start, kind number, end), by start and then kind."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def value_hash(value: str) -> int:
    """Signed 64-bit hash of a candidate's value; values themselves are never stored."""
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def scan(docs: DataFrame, owner_col: str, repo_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: base counts and digest, base spans as text, and all candidates with hashes."""
    schema = f"doc_id bigint, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base_text string, candidates {CANDIDATE}"

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digests, texts, candidates = [], [], [], []
            for text in batch.column(3).to_pylist():
                base = base_spans(text)
                kinds = Counter(k for _, k, _, _ in base)
                counts.append([kinds[k] for k in range(3)])
                texts.append(joined([s[:3] for s in base]))
                digests.append(hashlib.sha256(texts[-1].encode()).hexdigest())
                candidates.append([{"kind": k, "start": a, "stop": b, "value_start": b - len(v), "random": k == 3 or looks_random(v), "hash": value_hash(v)} for a, k, b, v in base + extra_spans(text, base)])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value_start", pa.int64()), ("random", pa.bool_()), ("hash", pa.int64())]))
            columns = [batch.column(0), batch.column(1), batch.column(2), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(candidates, kind)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "base_text", "candidates"])

        return run

    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(named, make, schema)


def owners_of_examples(counts: dict[int, int]) -> int:
    """Least number of owners of an example, from the number of values by owners (EXAMPLE_OWNERS stands for more too)."""
    total = sum(counts.values())
    rare = (k for k in range(2, EXAMPLE_OWNERS) if sum(n for o, n in counts.items() if o >= k) <= EXAMPLE_SHARE * total)
    return next(rare, EXAMPLE_OWNERS)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos, n_uses, example) of every candidate value; a null owner or repository is one unknown one.

    An example has as many repositories, too, as it needs owners.
    """
    each = found.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), F.explode("candidates.hash").alias("hash"))
    held = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_hash = materialize(held.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"), F.sum("n").alias("n_uses")))
    counts = by_hash.groupBy(F.least("n_owners", F.lit(EXAMPLE_OWNERS)).alias("k")).count().collect()  # EXAMPLE_OWNERS rows at most
    least = owners_of_examples({k: n for k, n in counts})
    return by_hash.withColumn("example", (F.col("n_owners") >= least) & (F.col("n_repos") >= least))


def judged(found: DataFrame, key: str) -> DataFrame:
    """(key, kind, start, stop, value_start, random, hash, example) of every candidate in a written table of scanned rows."""
    each = found.where(F.size("candidates") > 0).select(key, F.explode("candidates").alias("c")).select(key, "c.*")
    return each.join(ownership(found).select("hash", "example"), "hash")  # that is a written table: a common value's rows can be split


def find_secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every row.

    ``spans`` holds the base spans and a ``live`` span for each live-looking value; of two base matches with one value
    in one place there is one. Null and empty texts have none; null owners or repositories are one unknown one;
    repeated rows are each returned and count once an owner and repository; an empty table gives no rows; whole texts
    are read; other columns never.
    """
    found = materialize(scan(docs, owner_col, repo_col, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    kinds = F.array(*map(F.lit, KINDS))
    span = lambda start, kind: F.struct(start.alias("start"), kind.alias("kind"), F.concat_ws(":", kinds[kind], start, "stop").alias("said"))
    base = F.when(F.col("kind") < 3, span(F.col("start"), F.col("kind")))
    live = F.when(F.col("random") & ~F.col("example"), span(F.col("value_start"), F.lit(3)))
    copied = F.count(F.when(F.col("example") & (F.col("kind") < 3), 1)).alias("n_example")
    by_row = judged(found, "row").groupBy("row").agg(F.collect_set(live).alias("live"), F.collect_list(base).alias("base"), copied)
    by_row = by_row.select("row", F.array_join(F.array_sort(F.concat("base", "live"))["said"], ",").alias("said"), F.size("live").alias("n_live"), "n_example")
    out = found.join(by_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("said", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"))


def redact(text: str, spans: list[tuple[int, int, bool]]) -> str:
    """The text with (start, end, example) spans replaced; overlapping ones become one, live if any of them is."""
    merged: list[list] = []
    for a, b, example in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1] = [merged[-1][0], max(b, merged[-1][1]), merged[-1][2] and example]
        else:
            merged.append([a, b, example])
    out, at = [], 0
    for a, b, example in merged:
        out += [text[at:a], "[EXAMPLE-SECRET]" if example else "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets replaced in the text and the character count renewed.

    Base spans are always replaced, other tokens only if they look live; overlapping ones become one. Only documents
    with candidates are written and joined; the others pass through. Null and empty texts pass; whole texts of any
    length are read; repeated rows are each treated alike; null owners and repositories are one unknown one; an empty
    table gives no rows; further columns may have any names and pass unread.
    """
    columns = docs.columns
    at = columns.index(text_col)

    def split(flagged: bool):
        def run(batches):
            in_worker("secret_scan")
            for part in slices(batches, SLICE):
                mask = []
                for t in part.column(at).to_pylist():
                    base = base_spans(t)
                    mask.append(bool(base or extra_spans(t, base)) == flagged)
                yield part.filter(pa.array(mask, pa.bool_()))

        return docs.mapInArrow(tidy(run), docs.schema)

    # a row is one struct beside the operator's own columns, so no name can clash
    flagged = materialize(split(True).select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("d")).withColumn("row", F.monotonically_increasing_id()))
    field = lambda c: F.col("d").getField(c)
    base = flagged.select(F.col("row").alias("doc_id"), field(owner_col).cast("string").alias("o"), field(repo_col).cast("string").alias("r"), field(text_col).alias("t"))
    found = materialize(scan(base, "o", "r", "doc_id", "t"))
    spans = judged(found, "doc_id").where("kind < 3 or not example").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "example")).alias("s"))
    joined_rows = flagged.join(spans.withColumnRenamed("doc_id", "row"), "row", "left").select("d", "s")

    def clean(batches):
        for part in slices(batches, SLICE):
            fields = part.column(0).flatten()
            new = [redact(t, [(x["start"], x["stop"], x["example"]) for x in s]) if s else t for t, s in zip(fields[at].to_pylist(), part.column(1).to_pylist(), strict=True)]
            fields[at] = pa.array(new, fields[at].type)
            if chars_col in columns:
                k = columns.index(chars_col)
                fields[k] = pc.utf8_length(fields[at]).cast(fields[k].type)
            yield pa.RecordBatch.from_arrays(fields, names=columns)

    return split(False).union(joined_rows.mapInArrow(tidy(clean), docs.schema))
