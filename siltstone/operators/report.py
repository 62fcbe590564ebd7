"""Markdown reports of one evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate

# --- fixed values: advice by weakness ---------------------------------------------------------------------------
ADVICE = {
    "ndcg_at_10": "fuse sparse and dense rankings",
    "recall_at_10": "take more candidates or expand queries",
    "precision_at_10": "rerank candidates",
    "mrr": "cut finer chunks",
    "robustness": "correct spelling before retrieval and train on altered queries",
    "faithfulness": "ground answers more strictly",
}
# --- end of fixed values ----------------------------------------------------------------------------------------


def advice(scores: DataFrame) -> DataFrame:
    """(metric, advice) for every metric of a one-row aggregate below its bound; two general rows if none is."""
    have = [m for m in evaluate.WEAK if m in scores.columns]
    weak = scores.select(F.explode(evaluate.weaknesses({m: F.col(m) for m in have})).alias("metric"))
    rows = weak.select("metric", F.element_at(F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv)), F.col("metric")).alias("advice"))
    general = scores.where(F.size(evaluate.weaknesses({m: F.col(m) for m in have})) == 0)
    both = F.array(F.struct(F.lit("none").alias("metric"), F.lit("validate on an outside benchmark").alias("advice")), F.struct(F.lit("none").alias("metric"), F.lit("tune the embedding model on the domain").alias("advice")))
    return rows.unionByName(general.select(F.explode(both).alias("x")).select("x.*"))


def markdown(title: str, scores: DataFrame, robustness: DataFrame | None = None) -> str:
    """A report over one aggregate row and an optional robustness frame."""
    row = scores.first().asDict()
    lines = [f"# {title}", "", "| metric | score |", "|---|---|", *(f"| {k} | {v:.4f} |" for k, v in row.items() if isinstance(v, float))]
    if robustness is not None:
        lines += ["", "| attack | clean | attacked | change | robust |", "|---|---|---|---|---|"]
        lines += [f"| {r.attack} | {r.baseline_ndcg:.4f} | {r.attacked_ndcg:.4f} | {r.degradation_pct:+.1f}% | {r.is_robust} |" for r in robustness.orderBy("attack").collect()]
    return "\n".join([*lines, "", *(f"- {r.metric}: {r.advice}" for r in advice(scores).collect())])
