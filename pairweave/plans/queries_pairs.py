"""Queries of similarity search, pair scores, rewrites, clustering and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.functions import columns as C
from pairweave.operators import candidates, clusters, evaluate, features, models, scoring
from pairweave.plans import oracle as O
from pairweave.plans import pipeline
from pairweave.plans.catalog import query
from pairweave.plans.scratch import Scratch
from pairweave.sources import items as S

K = O.K
#: Stand-ins for the bands of trained encoders on the driver's vectors.
HIGH, MEDIUM = 0.35, 0.25
#: Euclidean distance of the LSH join: for unit vectors an inner product of 0.395.
LSH_DISTANCE = 1.1


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.candidate_pairs(S.items(spark, sf), pipeline.fixture_settings())


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return features.similarities(pairs(spark, sf), S.items(spark, sf))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return features.pair_features(pairs(spark, sf), S.items(spark, sf), ("a_dept_id", "b_dept_id"))


@query("j1_topk_text", O.statement(O.ITEMS, O.near("tnn", "text_emb", K), body="SELECT i, j, round(sim, 6) AS sim FROM tnn"))
def j1_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(candidates.topk_self(S.items(spark, sf), "text_emb", K), "sim")


@query("j1_topk_image", O.statement(O.ITEMS, O.near("vnn", "img_emb", K), body="SELECT i, j, round(sim, 6) AS sim FROM vnn"))
def j1_image(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(candidates.topk_self(S.items(spark, sf), "img_emb", K), "sim")


@query("j2_topk_cells")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.topk_cells(S.items(spark, sf), "text_emb", K)


@query("j2_lsh_pairs")
def j2_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.lsh_pairs(S.items(spark, sf).select("item_id", "text_emb"), "text_emb", LSH_DISTANCE)


@query("j3_candidate_pairs", O.statement(O.ITEMS, O.PAIRS, body="SELECT i, j FROM pairs"))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


_ANCHORS = """
q AS (SELECT * FROM items WHERE item_id % 2 = 1), t AS (SELECT * FROM items WHERE item_id % 2 = 0),
an AS (
  SELECT i, j, sim FROM (
    SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM (
      SELECT q.item_id AS i, t.item_id AS j, round(list_dot_product(q.text_emb, t.text_emb), 10) AS sim FROM q, t)) WHERE rn <= 10),
anchors AS (
  SELECT item_id, label, max(c) AS sim FROM (
    SELECT q.item_id, t.label, round((sim + list_dot_product(q.img_emb, t.img_emb)) * 0.5, 10) AS c FROM an JOIN q ON q.item_id = i JOIN t ON t.item_id = j)
  WHERE c >= 0.2 GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, item_id) AS rn FROM anchors),
apairs AS (
  SELECT a.item_id AS i, b.item_id AS j, max(least(a.sim, b.sim)) AS score
  FROM best a JOIN best b ON a.label = b.label AND a.item_id < b.item_id AND a.rn <= 30 AND b.rn <= 30 GROUP BY 1, 2)"""


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    return candidates.anchors(items.where("item_id % 2 = 1"), items.where("item_id % 2 = 0"), 10, 0.2)


@query("j4_anchors", O.statement(O.ITEMS, _ANCHORS, body="SELECT item_id, label, round(sim, 6) AS sim FROM anchors"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_anchors(spark, sf), "sim")


@query("j5_anchor_pairs", O.statement(O.ITEMS, _ANCHORS, body="SELECT i, j, round(score, 6) AS score FROM apairs"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(candidates.anchor_pairs(_anchors(spark, sf)), "score")


_MERGED = """merged AS (
  SELECT i, j, max(score) AS score FROM (
    SELECT i, j, combined AS score FROM sims
    UNION ALL
    SELECT p.i, p.j, p.score FROM apairs p JOIN items a ON a.item_id = p.i JOIN items b ON b.item_id = p.j
    WHERE (a.dept_id = b.dept_id OR a.dept_id = 0 OR b.dept_id = 0) AND (a.brand_id = b.brand_id OR a.brand_id = 0 OR b.brand_id = 0))
  GROUP BY 1, 2)"""


@query("j6_anchor_merge", O.statement(O.ITEMS, O.PAIRS, _ANCHORS, _MERGED, body="SELECT i, j, round(score, 6) AS score FROM merged"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    base = scored(spark, sf).select("i", "j", F.col("combined").alias("score"))
    return rounded(candidates.merge_pairs(base, candidates.anchor_pairs(_anchors(spark, sf)), S.items(spark, sf)), "score")


@query("j9_similarity_floor", O.statement(O.ITEMS, O.PAIRS, body=f"SELECT i, j, round(combined, 6) AS combined FROM sims WHERE combined >= {MEDIUM}"))
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(candidates.above(scored(spark, sf), "combined", MEDIUM).select("i", "j", "combined"), "combined")


_TRUE_PAIRS = "lp AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query("j10_pair_sets", O.statement(O.ITEMS, O.PAIRS, _TRUE_PAIRS, body="SELECT i, j, 'tp' AS kind FROM pairs SEMI JOIN lp USING (i, j) UNION ALL SELECT i, j, 'fp' FROM pairs ANTI JOIN lp USING (i, j)"))
def j10(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.marked(pairs(spark, sf), S.items(spark, sf))
    return rows.select("i", "j", F.when(F.col("y") == 1, "tp").otherwise("fp").alias("kind"))


@query("f_pair_features", O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), body=f"SELECT i, j, {O.rounded(features.PAIR_FEATURES)} FROM f"))
def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(featured(spark, sf), *features.PAIR_FEATURES).drop("a_dept_id", "b_dept_id")


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Items with their projections, written once."""
    return Scratch(spark, "projected").table(features.with_projections(S.items(spark, sf)))


@query("f85_pca_features")
def pca_features(spark: SparkSession, sf: str) -> DataFrame:
    """The wide set of 84 features of all candidate pairs, by fitted projections."""
    return features.pair_features(pairs(spark, sf), projected(spark, sf))


_TURN = "list_transform(range(0, 32), lambda d: ({0}_emb[d + 1] + {0}_emb[(d + 1) % 32 + 1]) / 2)"
_WIDE = f"""
turned AS (SELECT item_id, {_TURN.format("text")} AS text_pca, {_TURN.format("img")} AS img_pca FROM items),
wide AS (
  SELECT f.*, list_transform(list_zip(a.text_pca, b.text_pca), lambda z: round(abs(z[1] - z[2]), 6)) AS text_pca_diff,
    list_transform(list_zip(a.img_pca, b.img_pca), lambda z: round(abs(z[1] - z[2]), 6)) AS img_pca_diff
  FROM f JOIN turned a ON a.item_id = f.i JOIN turned b ON b.item_id = f.j)"""


@query("f84_assembly", O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), _WIDE, body=f"SELECT i, j, {O.rounded(features.PAIR_FEATURES)}, text_pca_diff, img_pca_diff FROM wide"))
def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    """The wide set of 84 features with a fixed projection: the mean of each number and the next."""
    items = S.items(spark, sf)
    turn = lambda c: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda d: (F.get(c, d) + F.get(c, (d + 1) % 32)) / 2)
    items = items.withColumns({"text_pca": turn(F.col("text_emb")), "img_pca": turn(F.col("img_emb"))})
    rows = rounded(features.pair_features(pairs(spark, sf), items), *features.PAIR_FEATURES)
    return rows.withColumns({c: F.transform(c, lambda x: F.round(x, 6)) for c in features.PCA_FEATURES})


@query("f87_explained_variance")
def explained(spark: SparkSession, sf: str) -> DataFrame:
    return features.explained_variance(spark, features.fit_pca(S.items(spark, sf), "text_emb"))


@query("c1_weighted", O.statement(O.ITEMS, O.PAIRS, body="SELECT i, j, round(text_sim * 0.7 + img_sim * 0.3, 6) AS score FROM sims"))
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("i", "j", scoring.weighted(0.7).alias("score")), "score")


@query("c2_both_high", O.statement(O.ITEMS, O.PAIRS, body="SELECT i, j, round(least(text_sim, img_sim), 6) AS score FROM sims"))
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("i", "j", scoring.both_high().alias("score")), "score")


@query("c3_logistic", O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), body=f"SELECT i, j, round({O.LOGIT}, 6) AS score FROM f"))
def c3_logistic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(featured(spark, sf).select("i", "j", scoring.logistic().alias("score")), "score")


_BAND = f"CASE WHEN combined_sim >= {HIGH} THEN p WHEN combined_sim >= {MEDIUM} AND p >= 0.3 THEN p ELSE 0 END"
_WITH_P = f"fp AS (SELECT *, {O.LOGIT} AS p FROM f)"


@query("c4_two_band", O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), _WITH_P, body=f"SELECT i, j, round({_BAND}, 6) AS score FROM fp"))
def c4(spark: SparkSession, sf: str) -> DataFrame:
    p = scoring.logistic()
    return rounded(featured(spark, sf).select("i", "j", scoring.two_band(F.col("combined_sim"), p, p, HIGH, MEDIUM, 0.3).alias("score")), "score")


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)'))"
_CE = f"""ce AS (
  SELECT i, j, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END AS ce
  FROM (SELECT s.i, s.j, {_TOK.format("a.title || ' ' || substr(coalesce(a.description, ''), 1, 150)")} AS x, {_TOK.format("b.title || ' ' || substr(coalesce(b.description, ''), 1, 150)")} AS y
    FROM sims s JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j WHERE combined >= {MEDIUM}))"""


def text_scores(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    near = candidates.above(scored(spark, sf), "combined", MEDIUM).select("i", "j", "combined")
    wide = features.with_items(near, items.select("item_id", "title", "description"))
    text = lambda p: F.concat(F.col(f"{p}_title"), F.lit(" "), F.substring(F.coalesce(F.col(f"{p}_description"), F.lit("")), 1, 150))
    return scoring.text_pair_scores(wide, "combined", MEDIUM, scoring.token_jaccard(text("a"), text("b"))).select("i", "j", "ce")


@query("c5_text_pairs", O.statement(O.ITEMS, O.PAIRS, _CE, body="SELECT i, j, round(ce, 6) AS ce FROM ce"))
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text_scores(spark, sf), "ce")


_Q = ", ".join(f"round(quantile_cont(combined, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p995", 0.995)))


@query("c6_distribution", O.statement(O.ITEMS, O.PAIRS, body=f"SELECT round(avg(combined), 6) AS mean, {_Q}, count(*) FILTER (combined >= 0.2) AS n_ge_20, count(*) FILTER (combined >= 0.3) AS n_ge_30 FROM sims"))
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.distribution(scored(spark, sf), "combined", (0.2, 0.3)), "mean", "p50", "p75", "p90", "p95", "p99", "p995")


_R1 = "CASE WHEN a_dept_id <> 0 AND b_dept_id <> 0 AND a_dept_id <> b_dept_id THEN 0 ELSE {0} END"
_R2 = "CASE WHEN {0} >= 0.15 AND {0} < 0.30 AND brand_match = 1 AND dept_match = 1 AND color_match = 1 THEN 0.30 ELSE {0} END"
_R3 = f"CASE WHEN combined_sim >= {MEDIUM} AND combined_sim < {HIGH} AND brand_match = 1 AND dept_match = 1 AND price_ratio >= 0.88 AND img_cosine_sim >= 0.2 AND {{0}} < 0.60 THEN 0.85 ELSE {{0}} END"


def _rewritten(name: str, sql: str, rewrite) -> None:
    @query(name, O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), _WITH_P, body=f"SELECT i, j, round({sql.format('p')}, 6) AS score FROM fp"))
    def rewritten(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(featured(spark, sf).withColumn("p", scoring.logistic()).select("i", "j", rewrite(F.col("p")).alias("score")), "score")


_override = lambda c: scoring.override(c, MEDIUM, HIGH, image=0.2, least=0.60)
_rewritten("r1_dept_filter", _R1, scoring.dept_filter)
_rewritten("r2_boost", _R2, scoring.boost)
_rewritten("r3_override", _R3, _override)
_CHAIN = f"""r1 AS (SELECT *, {_R1.format("p")} AS s1 FROM fp), r2 AS (SELECT *, {_R2.format("s1")} AS s2 FROM r1), r3 AS (SELECT *, {_R3.format("s2")} AS s3 FROM r2),
r4 AS (
  SELECT i, j, max(score) AS score FROM (
    SELECT i, j, s3 AS score FROM r3
    UNION ALL
    SELECT p.i, p.j, p.score FROM apairs p JOIN items a ON a.item_id = p.i JOIN items b ON b.item_id = p.j
    WHERE (a.dept_id = b.dept_id OR a.dept_id = 0 OR b.dept_id = 0) AND (a.brand_id = b.brand_id OR a.brand_id = 0 OR b.brand_id = 0))
  GROUP BY 1, 2),
r5 AS (SELECT r4.i, r4.j, CASE WHEN ce > 0 AND ce < 0.05 THEN 0 ELSE score END AS score FROM r4 LEFT JOIN ce ON ce.i = r4.i AND ce.j = r4.j)"""


@query("r5_full_chain", O.statement(O.ITEMS, O.PAIRS, O.features("f", "pairs"), _WITH_P, _ANCHORS, _CE, _CHAIN, body="SELECT i, j, round(score, 6) AS score FROM r5"))
def r5(spark: SparkSession, sf: str) -> DataFrame:
    rows = featured(spark, sf).withColumn("p", scoring.logistic())
    rows = rows.withColumn("s", scoring.dept_filter(F.col("p"))).withColumn("s", scoring.boost(F.col("s"))).select("i", "j", _override(F.col("s")).alias("score"))
    merged = candidates.merge_pairs(rows, candidates.anchor_pairs(_anchors(spark, sf)), S.items(spark, sf))
    return rounded(scoring.veto(merged, text_scores(spark, sf), 0.05), "score")


_EDGES = f"edges AS (SELECT i, j FROM sims WHERE combined >= {HIGH})"


def edges(spark: SparkSession, sf: str, least: float = HIGH) -> DataFrame:
    """Edges above a similarity, written once for the rounds that read them."""
    found = scored(spark, sf).select("i", "j", F.col("combined").alias("score"))
    return Scratch(spark, "edges").table(clusters.edges_at(found, least))


def found_components(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.components(S.items(spark, sf), edges(spark, sf))


@query("g1_edges", O.statement(O.ITEMS, O.PAIRS, _EDGES, body="SELECT * FROM edges"))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.edges_at(scored(spark, sf).withColumnRenamed("combined", "score"), HIGH).select("i", "j")


_CC = (O.ITEMS, O.PAIRS, _EDGES, O.components("cc", "edges"))


@query("g2_components", O.statement(*_CC, body="SELECT * FROM cc", recursive=True))
def g2(spark: SparkSession, sf: str) -> DataFrame:
    return found_components(spark, sf)


@query("g3_split_oversized")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return clusters.split_oversized(clusters.components(S.items(spark, sf), e), e, 20)


@query("g4_louvain")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.louvain(S.items(spark, sf), edges(spark, sf), 20)


@query("g5_size_histogram", O.statement(*_CC, body="SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM cc GROUP BY cluster_id) GROUP BY size", recursive=True))
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.size_histogram(found_components(spark, sf))


@query("g6_violations", O.statement(*_CC, body="SELECT 'cluster' AS kind, cluster_id AS key, count(*) AS n FROM cc GROUP BY cluster_id HAVING count(*) > 5", recursive=True))
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.violations(found_components(spark, sf), 5)


@query("pipeline_grouping_sizes", O.statement(*_CC, body="SELECT cluster_id, count(*) AS n FROM cc GROUP BY cluster_id", recursive=True))
def grouping_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return found_components(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("pipeline_grouping_full")
def grouping_full(spark: SparkSession, sf: str) -> DataFrame:
    """Every switch of the grouping pipeline on. All items are grouped and all labelled ones are anchors; an item finds itself among them."""
    items = S.items(spark, sf)
    s = pipeline.fixture_settings(model=True, medium_band=True, medium_least=0.3, dept_filter=True, boost=True, rules=True, ce_veto=True, anchors=True, anchor_sim=0.2, threshold=0.3, louvain=True)
    return pipeline.grouping(items, s, items)


@query("pipeline_grouping_models")
def grouping_models(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping by models trained for both bands on the wide features, over the approximate search."""
    scratch = Scratch(spark, "projected")
    plain = scratch.table(S.items(spark, sf).drop("description"))  # no scorer here reads the texts
    items = scratch.table(features.with_projections(plain))
    scratch.drop(plain)
    s = pipeline.fixture_settings(model=True, medium_band=True, medium_least=0.7, threshold=0.3, search="cells")
    found = Scratch(spark, "candidates").table(pipeline.candidate_pairs(items, s))  # one search for training and scoring
    return pipeline.grouping(items, s, None, *pipeline.band_models(items, s, 80_000, 60_000, trees=5, depth=4, found=found), found=found)


@query("pipeline_groups_models")
def groups_models(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates in given groups by a pair model and a group model, both trained on mined rows."""
    items = S.items(spark, sf)
    pair, model = pipeline.group_models(items, 15_000, 45_000, 15_000, trees=5, depth=3)
    return pipeline.group_answers(S.groups(spark, sf), items, pair, model, 0.28)


_F1 = "SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1"


@query("e1_pairwise_f1", O.statement(*_CC, O.f1("cc"), body=_F1, recursive=True))
def e1(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    return rounded(evaluate.pairwise_f1(found_components(spark, sf), items), "precision", "recall", "f1")


_SWEEP = (0.30, 0.35, 0.38, 0.40, 0.42, 0.45, 0.50)
_SWEEP_SQL = O.statement(
    O.ITEMS, O.PAIRS, *[x for n, t in enumerate(_SWEEP) for x in (f"e{n} AS (SELECT i, j FROM sims WHERE combined >= {t})", O.components(f"cc{n}", f"e{n}"))],
    "every AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, item_id, cluster_id FROM cc{n}" for n, t in enumerate(_SWEEP)) + ")",
    "c AS (SELECT threshold, item_id, cluster_id, label FROM every JOIN items USING (item_id))",
    "tp AS (SELECT threshold, sum(k * (k - 1) // 2) AS tp FROM (SELECT threshold, count(*) AS k FROM c GROUP BY threshold, cluster_id, label) GROUP BY 1)",
    "pr AS (SELECT threshold, sum(k * (k - 1) // 2) AS pred, count(*) AS groups FROM (SELECT threshold, count(*) AS k FROM c GROUP BY threshold, cluster_id) GROUP BY 1)",
    "tr AS (SELECT threshold, sum(k * (k - 1) // 2) AS truth FROM (SELECT threshold, count(*) AS k FROM c GROUP BY threshold, label) GROUP BY 1)",
    "m AS (SELECT threshold, groups, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS precision, CASE WHEN truth > 0 THEN tp / truth ELSE 0 END AS recall FROM tp JOIN pr USING (threshold) JOIN tr USING (threshold))",
    body="SELECT threshold, groups, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m",
    recursive=True,
)


@query("e3_threshold_sweep", _SWEEP_SQL)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    every = scored(spark, sf).select("i", "j", F.col("combined").alias("score"))
    return rounded(evaluate.sweep(items, every, items, list(_SWEEP)), "precision", "recall", "f1")


_LABELLED = f"""y AS (SELECT p, CAST(a.label = b.label AS INTEGER) AS y FROM (SELECT i, j, {O.LOGIT} AS p FROM f) JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j)"""
_YS = (O.ITEMS, O.PAIRS, O.features("f", "pairs"), _LABELLED)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """p, y of candidate pairs."""
    rows = features.pair_features(pairs(spark, sf), S.items(spark, sf), ("a_label", "b_label"))
    return rows.select(scoring.logistic().alias("p"), (F.col("a_label") == F.col("b_label")).cast("int").alias("y"))


_GRID = """g AS (
  SELECT t / 100 AS t, count(*) FILTER (p >= t / 100 AND y = 1) AS tp, count(*) FILTER (p >= t / 100 AND y = 0) AS fp, count(*) FILTER (p < t / 100 AND y = 1) AS fn, count(*) AS n
  FROM y, range(10, 96, 2) r(t) GROUP BY t),
h AS (SELECT t, (n - fp - fn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM g)"""


@query("e4_threshold_metrics", O.statement(*_YS, _GRID, body="SELECT t, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM h"))
def e4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.threshold_metrics(labelled(spark, sf), evaluate.threshold_grid(10, 94, 2)), "accuracy", "precision", "recall", "f1")


@query("e4_best_threshold", O.statement(*_YS, _GRID, body="SELECT t, round(accuracy, 6) AS accuracy FROM h ORDER BY h.accuracy DESC, t LIMIT 1"))
def e4_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.best_threshold(evaluate.threshold_metrics(labelled(spark, sf), evaluate.threshold_grid(10, 94, 2)), "accuracy"), "accuracy")


@query("e5_auc", O.statement(*_YS, "r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM y)", body="SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r"))
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.auc(labelled(spark, sf)), "auc")


@query("e6_classification_report", O.statement(*_YS, "z AS (SELECT c AS cls, count(*) FILTER (CAST(p >= 0.3 AS INTEGER) = c AND y = c) AS tp, count(*) FILTER (CAST(p >= 0.3 AS INTEGER) = c) AS nz, count(*) FILTER (y = c) AS support FROM y, (VALUES (0), (1)) v(c) GROUP BY c)", "q AS (SELECT *, CASE WHEN nz > 0 THEN tp / nz ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM z)", body="SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, support FROM q"))
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.classification_report(labelled(spark, sf), 0.3), "precision", "recall", "f1")


@query("e7_retrieval_recall", O.statement(O.ITEMS, O.PAIRS, _TRUE_PAIRS, body="SELECT (SELECT count(*) FROM lp SEMI JOIN pairs USING (i, j)) AS hits, count(*) AS total, round((SELECT count(*) FROM lp SEMI JOIN pairs USING (i, j)) / count(*), 6) AS recall FROM lp"))
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.retrieval_recall(pairs(spark, sf), S.items(spark, sf)), "recall")


@query("e8_recall_at_floors", O.statement(O.ITEMS, O.PAIRS, _TRUE_PAIRS, body="SELECT floor, count(*) FILTER (combined >= floor) AS kept, count(*) FILTER (combined >= floor AND lp.i IS NOT NULL) AS hits, round(count(*) FILTER (combined >= floor AND lp.i IS NOT NULL) / (SELECT count(*) FROM lp), 6) AS recall FROM sims LEFT JOIN lp ON lp.i = sims.i AND lp.j = sims.j, (VALUES (0.4::DOUBLE), (0.3::DOUBLE), (0.2::DOUBLE), (0.1::DOUBLE)) v(floor) GROUP BY floor"))
def e8(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.recall_at_floors(scored(spark, sf), S.items(spark, sf), (0.4, 0.3, 0.2, 0.1)), "recall")


_EDGE_LIST = (0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 1.01)
_BINS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(_EDGE_LIST, _EDGE_LIST[1:], strict=False))


@query("e9_similarity_bins", O.statement(O.ITEMS, O.PAIRS, body=f"SELECT bin_low, bin_high, count(*) AS n, count(*) FILTER (a.label = b.label) AS positives, round(count(*) FILTER (a.label = b.label) / count(*), 6) AS rate FROM sims JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j JOIN (VALUES {_BINS}) v(bin_low, bin_high) ON combined >= bin_low AND combined < bin_high GROUP BY 1, 2"))
def e9(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.similarity_bins(scored(spark, sf), S.items(spark, sf), _EDGE_LIST), "rate")


@query("e10_summary", O.statement(O.ITEMS, O.PAIRS, body="SELECT count(*) AS pairs, round(avg(combined), 6) AS mean_sim, round(max(combined), 6) AS max_sim, count(DISTINCT i) AS items FROM sims"))
def e10(spark: SparkSession, sf: str) -> DataFrame:
    row = scored(spark, sf).agg(F.count(F.lit(1)).alias("pairs"), F.avg("combined").alias("mean_sim"), F.max("combined").alias("max_sim"), F.countDistinct("i").alias("items"))
    return rounded(row, "mean_sim", "max_sim")


@query("b3_cosine_threshold", O.statement(O.ITEMS, O.near("vnn", "img_emb", K), "vp AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM vnn WHERE sim >= 0.45)", O.components("bc", "vp"), O.f1("bc"), body=_F1, recursive=True))
def b3(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    near = candidates.canonical_pairs(candidates.topk_self(items, "img_emb", K).where("sim >= 0.45"))
    return rounded(evaluate.pairwise_f1(clusters.components(items, near), items), "precision", "recall", "f1")


_LOGITS = """
x AS (SELECT vec_id AS r, vec_id // 64 AS batch, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
lg AS (SELECT p.batch, p.r, q.r AS c, list_dot_product(p.a, q.b) / 0.05 AS s FROM x p JOIN x q ON p.batch = q.batch)"""


def _side_loss(key: str) -> str:
    return f"SELECT batch, avg(z - d) AS l FROM (SELECT batch, {key}, ln(sum(exp(s - 100))) + 100 AS z, max(CASE WHEN r = c THEN s END) AS d FROM lg GROUP BY batch, {key}) GROUP BY batch"


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 64 items; the logits of a batch are all its pairs, which is what the loss is defined on."""
    e = S.table(spark, sf, "embeddings").withColumn("batch", F.expr("vec_id div 64"))
    left = e.select("batch", F.col("vec_id").alias("r"), C.as_doubles(F.slice("embedding", 1, 32)).alias("a"))
    right = e.select("batch", F.col("vec_id").alias("c"), C.as_doubles(F.slice("embedding", 33, 32)).alias("b"))
    return left.join(right, "batch").select("batch", "r", "c", (C.dot(F.col("a"), F.col("b")) / 0.05).alias("s"))


@query("t4_info_nce", O.statement(_LOGITS, f"rows_ AS ({_side_loss('r')})", f"cols_ AS ({_side_loss('c')})", body="SELECT round(avg((rows_.l + cols_.l) / 2), 6) AS loss FROM rows_ JOIN cols_ USING (batch)"))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.info_nce(_logits(spark, sf)), "loss")


@query("t5_info_nce_hard", O.statement(_LOGITS, f"rows_ AS ({_side_loss('r')})", body="SELECT round(avg(l), 6) AS loss FROM rows_"))
def t5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.info_nce_hard(_logits(spark, sf).withColumn("is_positive", F.col("r") == F.col("c"))), "loss")
