"""Metrics, leaderboards and robustness over real runs: vectors with equal labels, passages with known items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attacks, dense, evaluate, report
from ..session import forget_at_end, shared_dir
from .indexes import corpus_index, stamp
from .registry import query, table
from .retrieval_queries import BM25_SQL, DENSE_SQL, HASHED_SQL, Q_SQL, corpus, hashed_arm, probes, questions, rounded, vectors
from .text_queries import TOKENS_SQL

METRICS = [*(f"ndcg_at_{k}" for k in evaluate.NDCG_CUTS), "mrr", *(f"precision_at_{k}" for k in evaluate.PRECISION_CUTS), *(f"recall_at_{k}" for k in evaluate.RECALL_CUTS), "map_at_10", "hit_rate_at_10"]


def metrics_sql(run: str, qrels: str, queries: str, by: str = "query_id") -> str:
    """CTEs that end in ``m``: all metrics of every query of ``queries``; run and qrels are relation names."""
    gain = lambda g, r: f"(CASE WHEN {g} > 0 THEN (pow(2, {g}) - 1) / log2({r} + 1) ELSE 0 END)"
    dcg = ", ".join(f"sum(CASE WHEN rank <= {k} THEN {gain('grade', 'rank')} ELSE 0 END) AS dcg_{k}, sum(CASE WHEN rank <= {k} AND grade > 0 THEN 1 ELSE 0 END) AS hits_{k}" for k in (1, 3, 5, 10))
    idcg = ", ".join(f"sum(CASE WHEN i <= {k} THEN {gain('grade', 'i')} ELSE 0 END) AS idcg_{k}" for k in (1, 3, 5, 10))
    ndcg = ", ".join(f"coalesce(CASE WHEN idcg_{k} > 0 THEN dcg_{k} / idcg_{k} END, 0) AS ndcg_at_{k}, coalesce(hits_{k}::DOUBLE / {k}, 0) AS precision_at_{k}" for k in (1, 3, 5, 10))
    recall = ", ".join(f"coalesce(CASE WHEN n_rel > 0 THEN hits_{k}::DOUBLE / n_rel END, 0) AS recall_at_{k}" for k in (5, 10))
    return f"""gr AS (SELECT r.{by}, r.doc_id, r.rank, coalesce(q.grade, 0)::DOUBLE AS grade FROM {run} r LEFT JOIN {qrels} q ON q.query_id = r.query_id AND q.doc_id = r.doc_id),
gh AS (SELECT *, sum((grade > 0)::INT) OVER (PARTITION BY {by} ORDER BY rank, doc_id) AS hits FROM gr),
gs AS (SELECT {by}, {dcg}, min(CASE WHEN grade > 0 AND rank <= 10 THEN rank END) AS first_hit, sum(CASE WHEN grade > 0 AND rank <= 10 THEN hits / rank ELSE 0 END) AS ap FROM gh GROUP BY {by}),
gi AS (SELECT query_id, count(*) AS n_rel, {idcg} FROM (SELECT query_id, grade::DOUBLE AS grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM {qrels}) GROUP BY query_id),
m AS (SELECT x.query_id, {ndcg}, {recall}, coalesce(1.0::DOUBLE / first_hit, 0) AS mrr, coalesce(CASE WHEN n_rel > 0 THEN ap / least(n_rel, 10) END, 0) AS map_at_10, CASE WHEN first_hit IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_at_10 FROM {queries} x LEFT JOIN gs ON gs.query_id = x.query_id LEFT JOIN gi ON gi.query_id = x.query_id)"""


def label_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run, qrels (other vectors of the same label) and queries of vector search."""
    run = dense.exact_topk(vectors(spark, sf_dir), probes(spark, sf_dir), 10, exclude_self=True).select("query_id", "doc_id", "rank")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = q.join(e, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1.0).alias("grade"))
    return run, qrels, q.select("query_id")


LABEL_SQL = f"WITH {DENSE_SQL}, run AS (SELECT * FROM dn WHERE rank <= 10), qs AS (SELECT vec_id AS query_id FROM v WHERE vec_id % 100 = 0), qrels AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1.0 AS grade FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), {metrics_sql('run', 'qrels', 'qs')}"


#: Words of a window, and the share of a passage's windows that a relevant document holds.
WINDOW, SHARE = 8, 0.5


_stored: dict[tuple[str, ...], str] = {}


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded qrels of passages, made at their first use and kept for the session; anew when the tables' files change."""
    stamps = [stamp(spark, f"{sf_dir}/{name}.parquet") for name in ("benchmark", "documents", "labels")]
    key = (spark.sparkContext.applicationId, *stamps)
    if key not in _stored:
        path = f"{shared_dir(spark)}/known-{uuid.uuid4().hex}"
        forget_at_end(spark, path)
        good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        hits = evaluate.window_matches(questions(spark, sf_dir), corpus(spark, sf_dir), WINDOW, SHARE)
        hits.join(good, "doc_id", "left").select("query_id", "doc_id", (1.0 + F.coalesce("quality", F.lit(0))).alias("grade")).write.parquet(path)
        _stored[key] = path
    return spark.read.schema("query_id bigint, doc_id bigint, grade double").parquet(_stored[key])


def _windows_sql(key: str, relation: str) -> str:
    joined = "list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))"
    return f"SELECT {key}, unnest(CASE WHEN len(t) >= 8 THEN list_distinct({joined}) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM (SELECT {key}, {TOKENS_SQL.format('text')} AS t FROM {relation})"


KNOWN_SQL = f"""pw AS MATERIALIZED ({_windows_sql('item_id', 'benchmark')}), pn AS (SELECT item_id, count(*) AS n FROM pw GROUP BY item_id), dw AS ({_windows_sql('doc_id', 'documents')}),
qrels AS MATERIALIZED (SELECT item_id AS query_id, h.doc_id, 1.0 + coalesce(l.quality, 0) AS grade FROM (SELECT item_id, doc_id, count(*) AS k FROM pw JOIN dw USING (g) GROUP BY ALL) h JOIN pn USING (item_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = h.doc_id WHERE k::DOUBLE / n >= 0.5)"""


def _columns(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def picked(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return rounded(evaluate.per_query(*label_run(spark, sf_dir)).select("query_id", *names), *names)


@query(f"{LABEL_SQL} SELECT query_id, {', '.join(f'round(dcg_{k}, 6) AS dcg_{k}, round(idcg_{k}, 6) AS idcg_{k}' for k in (1, 3, 5, 10))} FROM gs JOIN gi USING (query_id)")
def dcg_idcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted gains and their ideals."""
    run, qrels, _ = label_run(spark, sf_dir)
    g = run.join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    d = g.groupBy("query_id").agg(*(F.sum(F.when(F.col("rank") <= k, evaluate.gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}") for k in evaluate.NDCG_CUTS))
    names = [f"{p}dcg_{k}" for k in evaluate.NDCG_CUTS for p in ("", "i")]
    return rounded(d.join(evaluate.ideal(qrels), "query_id").select("query_id", *names), *names)


@query(f"{LABEL_SQL} SELECT query_id, {_columns([f'ndcg_at_{k}' for k in (1, 3, 5, 10)])} FROM m")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised gains of vector search."""
    return picked(spark, sf_dir, [f"ndcg_at_{k}" for k in evaluate.NDCG_CUTS])


@query(f"{LABEL_SQL} SELECT query_id, {_columns(['mrr', 'map_at_10'])} FROM m")
def mrr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank and average precision of vector search."""
    return picked(spark, sf_dir, ["mrr", "map_at_10"])


_PRH = [*(f"precision_at_{k}" for k in (1, 3, 5, 10)), "recall_at_5", "recall_at_10", "hit_rate_at_10"]


@query(f"{LABEL_SQL} SELECT query_id, {_columns(_PRH)} FROM m")
def precision_recall_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and hit rate of vector search."""
    return picked(spark, sf_dir, _PRH)


@query(f"{LABEL_SQL} SELECT query_id, {_columns(METRICS)} FROM m")
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen metrics in one pass."""
    return picked(spark, sf_dir, METRICS)


_AGG_SQL = ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.AGGREGATED)


@query(f"{LABEL_SQL} SELECT {_AGG_SQL}, count(*)::BIGINT AS n_queries FROM m")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all vector queries."""
    return rounded(evaluate.aggregate(evaluate.per_query(*label_run(spark, sf_dir))), *evaluate.AGGREGATED)


_GRADED = f"WITH {Q_SQL}, {BM25_SQL}, run AS (SELECT * FROM bm WHERE rank <= 10), {KNOWN_SQL}, {metrics_sql('run', 'qrels', 'q')}"


def graded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return evaluate.per_query(corpus_index(spark, sf_dir).topk(q, 10).select("query_id", "doc_id", "rank"), known_items(spark, sf_dir), q.select("query_id"))


@query(f"{_GRADED} SELECT query_id, {_columns(METRICS)} FROM m")
def graded_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 against graded known items; queries without any are rows of zeros."""
    return rounded(graded_scores(spark, sf_dir), *METRICS)


_MODES = f"WITH {Q_SQL}, {BM25_SQL}, {HASHED_SQL}, {KNOWN_SQL}, modes AS (SELECT 'sparse' AS mode, query_id, doc_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM hv WHERE rank <= 10), hit AS (SELECT mode, m.query_id, min(rank) AS r FROM modes m JOIN qrels USING (query_id, doc_id) GROUP BY ALL), n AS (SELECT count(*) AS n FROM q)"


def mode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of two modes, one row each."""
    q = questions(spark, sf_dir)
    qrels = known_items(spark, sf_dir)
    out = None
    for mode, run in (("sparse", corpus_index(spark, sf_dir).topk(q, 10)), ("dense", hashed_arm(spark, sf_dir, q, 10))):
        one = evaluate.aggregate(evaluate.per_query(run.select("query_id", "doc_id", "rank"), qrels, q.select("query_id"))).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_MODES} SELECT mode, round(sum(1.0::DOUBLE / r) / max(n), 6) AS mrr, round(count(*)::DOUBLE / max(n), 6) AS hit_rate_at_10 FROM hit, n GROUP BY mode")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank and hit rate of the modes."""
    return rounded(mode_scores(spark, sf_dir).select("mode", "mrr", "hit_rate_at_10"), "mrr", "hit_rate_at_10")


@query("""SELECT 'c' || c_custkey AS experiment_id, 'n' || c_nationkey AS corpus_id, round(c_acctbal, 2) AS score FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, experiment_id LIMIT 20""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of many experiments (customers by balance stand for them)."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("experiment_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("corpus_id"), F.col("c_acctbal").alias("score"))
    return evaluate.leaderboard(c, "score").withColumn("score", F.round("score", 2))


@query("""SELECT dataset, bm25, round(bm25 * (0.9 + 0.1 * k), 6) AS ndcg, round((bm25 * (0.9 + 0.1 * k) - bm25) / bm25 * 100, 6) AS improvement_pct FROM (VALUES ('trec-covid', 0.656::DOUBLE), ('nfcorpus', 0.325), ('fiqa', 0.236), ('scifact', 0.665), ('arguana', 0.472)) t(dataset, bm25), (SELECT r_regionkey::DOUBLE AS k FROM region) r""")
def beir_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improvement over published baselines for five made results a dataset."""
    base = spark.createDataFrame([(k, v) for k, v in evaluate.BM25_BASELINES.items()], "dataset string, bm25 double")
    made = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("double").alias("k"))
    rows = made.crossJoin(F.broadcast(base)).withColumn("ndcg", F.col("bm25") * (0.9 + 0.1 * F.col("k")))  # five constant rows
    return rows.select("dataset", "bm25", F.round("ndcg", 6).alias("ndcg"), F.round(evaluate.improvement(F.col("ndcg"), F.col("bm25")), 6).alias("improvement_pct"))


@query("""SELECT vec_id, CASE WHEN s >= 0.85 THEN 'Excellent' WHEN s >= 0.70 THEN 'Good' WHEN s >= 0.55 THEN 'Moderate' ELSE 'Poor' END AS ndcg_band, CASE WHEN s >= 0.90 THEN 'Excellent' WHEN s >= 0.75 THEN 'Good' WHEN s >= 0.60 THEN 'Moderate' ELSE 'Poor' END AS mrr_band, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.60 THEN 'medium' ELSE 'low' END AS confidence_band FROM (SELECT vec_id, (vec_id % 101) / 100.0::DOUBLE AS s FROM embeddings)""")
def interpret_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of scores from 0 to 1 made from all vector ids."""
    from ..operators import agent

    s = (F.col("vec_id") % 101) / F.lit(100.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", evaluate.band(s, evaluate.NDCG_BANDS).alias("ndcg_band"), evaluate.band(s, evaluate.MRR_BANDS).alias("mrr_band"), agent.bands(s, agent.CONFIDENCE_BANDS, "low").alias("confidence_band"))


@query("""SELECT vec_id, array_to_string(list_filter([CASE WHEN a < 0.70 THEN 'ndcg_at_10' END, CASE WHEN b < 0.60 THEN 'recall_at_10' END, CASE WHEN a < 0.50 THEN 'precision_at_10' END, CASE WHEN b < 0.70 THEN 'mrr' END], lambda x: x IS NOT NULL), ',') AS weak FROM (SELECT vec_id, (vec_id % 101) / 100.0::DOUBLE AS a, (vec_id % 89) / 88.0::DOUBLE AS b FROM embeddings)""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak metrics of scores made from all vector ids."""
    a, b = (F.col("vec_id") % 101) / F.lit(100.0), (F.col("vec_id") % 89) / F.lit(88.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(evaluate.weaknesses({"ndcg_at_10": a, "recall_at_10": b, "precision_at_10": a, "mrr": b}), ",").alias("weak"))


def _advice_sql() -> str:
    weak = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{report.ADVICE[m]}' AS advice FROM g WHERE {m} < {evaluate.WEAK[m]}" for m in evaluate.WEAK if m in evaluate.AGGREGATED)
    return f"g AS (SELECT {', '.join(f'avg({m}) AS {m}' for m in evaluate.AGGREGATED)} FROM m), w AS ({weak}) SELECT * FROM w UNION ALL SELECT 'none', a FROM (VALUES ('validate on an outside benchmark'), ('tune the embedding model on the domain')) t(a) WHERE NOT EXISTS (SELECT * FROM w)"


@query(f"{_GRADED}, {_advice_sql()}")
def evaluation_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for the graded BM25 evaluation."""
    return report.advice(evaluate.aggregate(graded_scores(spark, sf_dir)))


_HEAD = "concat('how to treat and increase the rate, ', text)"


def robust_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages with trigger phrases before them, by id."""
    phrase = F.element_at(F.array(F.lit("how to treat cancer and "), F.lit("increase the Rate of "), F.lit("is it SAFE to use ")), (F.col("query_id") % 3 + 1).cast("int"))
    return questions(spark, sf_dir).select("query_id", F.concat(phrase, "text").alias("text"))


_RQ = "rq AS (SELECT item_id AS query_id, ['how to treat cancer and ', 'increase the Rate of ', 'is it SAFE to use '][1 + item_id % 3] || text AS text FROM benchmark)"


def one_attack(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return robust_questions(spark, sf_dir).select("query_id", attacks.ATTACKS[name](F.col("text"), F.col("query_id")).alias("attacked"))


_W = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TRUNCATED_SQL = f"array_to_string(list_slice({_W}, 1, greatest(1, floor(len({_W}) * 0.5)::INT)), ' ')"


@query(f"WITH {_RQ} SELECT query_id, {TRUNCATED_SQL} AS attacked FROM rq")
def attack_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First halves."""
    return one_attack(spark, sf_dir, "query_truncation")


@query(f"WITH {_RQ} SELECT query_id, '{attacks.DOMAIN_PREFIXES['legal']}' || text AS attacked FROM rq")
def attack_domain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal prefix."""
    return one_attack(spark, sf_dir, "domain_shift")


def _synonym_sql() -> str:
    sql = "text"
    for old, new in attacks.SYNONYMS.items():
        sql = f"regexp_replace({sql}, '{old}', '{new}', 'gi')"
    return sql


@query(f"WITH {_RQ} SELECT query_id, {_synonym_sql()} AS attacked FROM rq")
def attack_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All synonyms."""
    return one_attack(spark, sf_dir, "synonym_substitution")


def _quoted(options: list[str]) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


TRAP_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{old}') THEN regexp_replace(text, '{old}', '{new}', 'gi')" for old, new in attacks.TRAPS) + f" ELSE {_quoted(attacks.CONFOUNDERS)}[1 + query_id % 3] || text END"


@query(f"WITH {_RQ} SELECT query_id, {TRAP_SQL} AS attacked FROM rq")
def attack_semantic_trap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned phrases, or a confounding prefix."""
    return one_attack(spark, sf_dir, "semantic_trap")


INJECT_SQL = f"(CASE (query_id // 6) % 3 WHEN 0 THEN {_quoted(attacks.INJECTIONS)}[1 + query_id % 6] || text WHEN 1 THEN text || ' ' || {_quoted(attacks.INJECTIONS)}[1 + query_id % 6] ELSE array_to_string(list_slice({_W}, 1, len({_W}) // 2), ' ') || ' ' || {_quoted(attacks.INJECTIONS)}[1 + query_id % 6] || array_to_string(list_slice({_W}, len({_W}) // 2 + 1, len({_W})), ' ') END)"


@query(f"WITH {_RQ} SELECT query_id, {INJECT_SQL} AS attacked FROM rq")
def attack_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off-topic sentences before, after and within."""
    return one_attack(spark, sf_dir, "irrelevant_injection")


def _typo_sql() -> str:
    keys = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in attacks.ADJACENT_KEYS.items())
    hexed = lambda at, n: f"('0x' || substring(h, {at}, {n}))::INT"
    return f"""SELECT query_id, string_agg(CASE WHEN s THEN after || c WHEN coalesce(lag_s, false) THEN '' WHEN kind = 1 THEN '' WHEN kind = 2 THEN c || c WHEN kind = 3 AND near IS NOT NULL THEN near[1 + {hexed(7, 2)} % len(near)] ELSE c END, '' ORDER BY i) AS attacked FROM (
SELECT *, lag(s) OVER w AS lag_s FROM (SELECT *, kind = 0 AND coalesce(lag(kind) OVER w, -1) <> 0 AND lead(c) OVER w IS NOT NULL AS s, lead(c) OVER w AS after FROM (
SELECT *, CASE WHEN {hexed(1, 4)} < {attacks.TYPO_RATE} * 65536 THEN {hexed(5, 2)} % 4 ELSE -1 END AS kind, CASE lower(c) {keys} END AS near FROM (
SELECT query_id, i, c, md5('{attacks.SEED}:' || i || ':' || c) AS h FROM (SELECT query_id, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT query_id, string_split(text, '') AS cs FROM rq)))) WINDOW w AS (PARTITION BY query_id ORDER BY i)) WINDOW w AS (PARTITION BY query_id ORDER BY i)) GROUP BY query_id"""


@query(f"WITH {_RQ} {_typo_sql()}")
def attack_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded misspellings."""
    return one_attack(spark, sf_dir, "typo_noise")


NAMES = list(attacks.ATTACKS)


_ROBUST = f"""WITH {_RQ}, vs AS (SELECT query_id, 'clean' AS attack, text FROM rq UNION ALL SELECT query_id, 'query_truncation', {TRUNCATED_SQL} FROM rq UNION ALL SELECT query_id, 'semantic_trap', {TRAP_SQL} FROM rq UNION ALL SELECT query_id, 'irrelevant_injection', {INJECT_SQL} FROM rq UNION ALL SELECT query_id, 'domain_shift', '{attacks.DOMAIN_PREFIXES["legal"]}' || text FROM rq UNION ALL SELECT query_id, 'synonym_substitution', {_synonym_sql()} FROM rq UNION ALL SELECT query_id, 'typo_noise', attacked FROM ({_typo_sql()})),
q AS (SELECT query_id || ':' || attack AS query_id, text FROM vs), {BM25_SQL}, {KNOWN_SQL},
run AS (SELECT split_part(query_id, ':', 1)::BIGINT AS qid, split_part(query_id, ':', 2) AS attack, doc_id, rank FROM bm WHERE rank <= 10),
hit AS (SELECT attack, qid, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM run JOIN qrels ON qrels.query_id = qid AND qrels.doc_id = run.doc_id GROUP BY ALL),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrels) WHERE i <= 10 GROUP BY query_id),
nd AS (SELECT vs.attack, coalesce(dcg / idcg, 0) AS ndcg FROM vs LEFT JOIN hit ON hit.attack = vs.attack AND hit.qid = vs.query_id LEFT JOIN ideal ON ideal.query_id = vs.query_id),
a AS (SELECT attack, avg(ndcg) AS x FROM nd GROUP BY attack), b AS (SELECT x AS base FROM a WHERE attack = 'clean')"""


@query(f"""{_ROBUST}
SELECT attack, round(base, 6) AS baseline_ndcg, round(x, 6) AS attacked_ndcg, round(CASE WHEN base > 0 THEN (x - base) / base * 100 ELSE 0 END, 6) AS degradation_pct, abs(CASE WHEN base > 0 THEN (x - base) / base * 100 ELSE 0 END) < 5 AS is_robust FROM a, b WHERE attack <> 'clean'""")
def robustness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval of all clean and attacked queries in one plan, compared by attack."""
    variants = attacks.attacked(robust_questions(spark, sf_dir), NAMES)
    keyed = variants.select(F.concat_ws(":", F.col("query_id").cast("string"), "attack").alias("query_id"), F.col("query_id").alias("qid"), "attack", "text")
    run = corpus_index(spark, sf_dir).topk(keyed.select("query_id", "text"), 10).select("query_id", "doc_id", "rank")
    named = keyed.select("query_id", "qid", "attack")
    qrels = named.join(known_items(spark, sf_dir).withColumnRenamed("query_id", "qid"), "qid").select("query_id", "doc_id", "grade")
    scores = evaluate.per_query(run, qrels, named.select("query_id")).join(named, "query_id").select("attack", F.col("ndcg_at_10").alias("ndcg"))
    r = attacks.report(scores)
    return rounded(r.select("attack", "baseline_ndcg", "attacked_ndcg", "degradation_pct", "is_robust"), "baseline_ndcg", "attacked_ndcg", "degradation_pct")


@query(f"""{_ROBUST}, o AS (SELECT coalesce(round(avg(x) / max(base) * 100, 4), 0) AS v FROM a, b WHERE attack <> 'clean' AND base > 0) SELECT v AS overall_robustness, CASE WHEN v >= 90 THEN 'robust' WHEN v >= 75 THEN 'moderate' ELSE 'fragile' END AS band FROM o""")
def robustness_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean attacked over clean gain of all six attacks."""
    return rounded(attacks.overall(robustness_report(spark, sf_dir)), "overall_robustness", digits=4)
