"""Sentence boundaries learned from the corpus itself: abbreviations and sentence starters by log likelihoods.

A word type that hardly ever stands without its full stop is an abbreviation; short ones and those with stops inside
need less evidence. A type that follows a sentence's end much more often than elsewhere begins sentences, also behind
an abbreviation. Spark counts both over all texts; the model is two small tables, whose sizes are parameters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Least score and occurrences of an abbreviation, least log likelihood of a starter, entries of each table at most.
ABBREVIATION, SEEN, STARTER, ENTRIES = 0.3, 2, 30.0, 1 << 16
#: How often an abbreviation has its full stop, by the hypothesis against which types are tested.
CERTAIN = 0.99
WORD = r"^\p{L}[\p{L}.]*$"
END = re.compile(r"([.!?][\"')\]»”’]*)(\s+)")
OPENING, CLOSING = "\"'([«“‘„¿¡", "\"')]»”’"


@dataclass(frozen=True)
class SentenceModel:
    """Abbreviations (lower case, without the last full stop) and words that begin sentences (lower case)."""

    abbreviations: frozenset[str]
    starters: frozenset[str]


def type_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, stopped, bare) of all word types: occurrences with a full stop at the end, and without."""
    w = docs.select(F.explode_outer(T.tokens(F.col(text))).alias("w")).where("w is not null")
    stop = F.endswith("w", F.lit("."))
    base = F.when(stop, F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w"))
    rows = w.select(base.alias("type"), stop.alias("stop")).where(F.rlike("type", F.lit(WORD)))
    return rows.groupBy("type").agg(F.sum(F.col("stop").cast("bigint")).alias("stopped"), F.sum((~F.col("stop")).cast("bigint")).alias("bare"))


def likelihood(hits: Column, n: Column, p: Column | float) -> Column:
    """Log likelihood of so many hits of n at a probability strictly between 0 and 1."""
    p = F.lit(p) if isinstance(p, float) else p
    return hits * F.log(p) + (n - hits) * F.log(1 - p)


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, stopped, bare, score) of the types that occur with a full stop; abbreviations score at least ABBREVIATION."""
    total = counts.agg((F.sum("stopped") / F.sum(F.col("stopped") + F.col("bare"))).alias("p"))  # one row
    rows = counts.where(F.col("stopped") >= SEEN).crossJoin(F.broadcast(total)).where("p > 0 and p < 1")
    n, letters = F.col("stopped") + F.col("bare"), F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = 2 * (likelihood(F.col("stopped"), n, CERTAIN) - likelihood(F.col("stopped"), n, F.col("p")))
    inside = F.length("type") - letters
    return rows.select("type", "stopped", "bare", (ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -F.col("bare"))).alias("score"))


def starters(docs: DataFrame, known: list[str], text: str = "text") -> DataFrame:
    """(type, after, n, score) of capitalised words by how much more often they follow a sentence's end than not; ``known`` are at most ENTRIES abbreviations."""
    listed = docs.sparkSession.createDataFrame([(k,) for k in known], "known string")
    t = T.words(F.col(text))
    rows = docs.select(t.alias("w")).where(F.size("w") > 0)
    before = F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1))
    pairs = rows.select(F.explode_outer(F.arrays_zip(before.alias("before"), F.col("w").alias("w"))).alias("x")).where("x is not null").select(F.lower("x.before").alias("before"), F.col("x.w").alias("w"))
    pairs = pairs.where(F.rlike("w", F.lit(r"^\p{Lu}\p{L}*$"))).withColumn("base", F.expr("substring(before, 1, length(before) - 1)"))
    pairs = pairs.join(F.broadcast(listed), F.col("base") == F.col("known"), "left")
    ends = F.rlike("before", F.lit(r"[.!?]$")) & ~(F.endswith("before", F.lit(".")) & (F.col("known").isNotNull() | (F.length("base") == 1)))
    named = pairs.select(F.lower("w").alias("type"), ends.alias("ends"))
    counts = named.groupBy("type").agg(F.sum(F.col("ends").cast("bigint")).alias("after"), F.count("*").alias("n"))
    total = counts.agg(F.sum("after").alias("all_after"), F.sum("n").alias("all_n"))  # one row
    x = counts.where("after > 0").crossJoin(F.broadcast(total))
    p, own, other = F.col("all_after") / F.col("all_n"), F.col("after") / F.col("n"), (F.col("all_after") - F.col("after")) / (F.col("all_n") - F.col("n"))
    near = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    rest, hits = F.col("all_n") - F.col("n"), F.col("all_after") - F.col("after")
    score = 2 * (likelihood(F.col("after"), F.col("n"), near(own)) + likelihood(hits, rest, near(other)) - likelihood(F.col("after"), F.col("n"), near(p)) - likelihood(hits, rest, near(p)))
    return x.where("all_n > n").select("type", "after", "n", F.when(own > other, score).otherwise(0.0).alias("score"))


def fit(docs: DataFrame, text: str = "text") -> SentenceModel:
    """Learn from all documents; of more than ENTRIES abbreviations or starters those of the highest scores are kept."""
    best = lambda df, least: [r.type for r in df.where(F.col("score") >= least).orderBy(F.desc("score"), "type").limit(ENTRIES).collect()]
    known = best(abbreviations(type_counts(docs, text)), ABBREVIATION)
    return SentenceModel(frozenset(known), frozenset(best(starters(docs, known, text), STARTER)))


def ends_here(word: str, following: str, model: SentenceModel) -> bool:
    """Does a sentence end between a word with its mark and the next word?"""
    word, following = word.lstrip(OPENING).rstrip(CLOSING), following.lstrip(OPENING)
    if not word.endswith(".") or word.endswith(".."):
        return True
    base, first = word[:-1].lower(), following[:1]
    if base.isdigit() and first.islower():
        return False
    if not (base in model.abbreviations or len(base) == 1 and base.isalpha()):
        return True
    return first.isupper() and re.sub(r"\W+$", "", following).lower() in model.starters


def cut(text: str, model: SentenceModel) -> list[str]:
    """Trimmed sentences of a text."""
    out, at = [], 0
    for m in END.finditer(text):
        head = text[max(at, m.end(1) - 64) : m.end(1)].split()
        tail = text[m.end() : m.end() + 64].split()
        if head and tail and ends_here(head[-1], tail[0], model):
            out.append(text[at : m.end(1)].strip())
            at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def sentences(text: Column, model: SentenceModel) -> Column:
    """Sentences of a text column; null gives null."""

    @F.pandas_udf("array<string>")
    def made(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else cut(x, model))

    return made(text)
