"""Queries of training-set mining and trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators import candidates, evaluate, features, mining, models
from pairweave.plans import oracle as O
from pairweave.plans import pipeline
from pairweave.plans.catalog import query
from pairweave.plans.queries_pairs import HIGH, MEDIUM, labelled, pairs, projected
from pairweave.plans.scratch import Scratch
from pairweave.sources import items as S


#: The reference's caps: positives of a band, warm-up pairs, and groups (positive, negative, of these within a department).
MAX_HIGH, MAX_MEDIUM, MAX_WARMUP = 80_000, 60_000, 25_000
MAX_GROUPS = (15_000, 45_000, 15_000)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _positives(name: str, per_label: int) -> str:
    """per_label pairs of every label among those of its first items in hash order."""
    return f"""
{name}_first AS (SELECT item_id, label FROM (SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY {O.hashed("item_id")}, item_id) AS rn FROM items WHERE label IS NOT NULL) WHERE rn <= {2 * per_label}),
{name} AS (
  SELECT i, j, label FROM (
    SELECT i, j, label, row_number() OVER (PARTITION BY label ORDER BY {O.hashed("i", "j")}, i, j) AS rn FROM (
      SELECT a.item_id AS i, b.item_id AS j, a.label FROM {name}_first a JOIN {name}_first b ON a.label = b.label AND a.item_id < b.item_id))
  WHERE rn <= {per_label})"""


_POS = _positives("pos", 3)


@query("m1_positives", O.statement(O.ITEMS, _POS, body="SELECT * FROM pos"))
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return mining.positives(S.items(spark, sf))


def half_of_positives(spark: SparkSession, sf: str) -> int:
    """The reference's number of negatives of each kind."""
    return mining.positives(S.items(spark, sf)).count() // 2


def _consecutive(name: str, source: str, key: str) -> str:
    return f"""
{name}_n AS (SELECT item_id, label, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY {O.hashed("item_id")}, item_id) AS rn FROM {source}),
{name}_m AS (
  SELECT least(a.item_id, b.item_id) AS i, greatest(a.item_id, b.item_id) AS j FROM {name}_n a JOIN {name}_n b
  ON a.k = b.k AND a.rn % 2 = 1 AND b.rn = a.rn + 1 AND a.label <> b.label),
{name} AS (SELECT i, j FROM {name}_m ORDER BY {O.hashed("i", "j")}, i, j LIMIT (SELECT count(*) // 2 FROM pos))"""


@query("m2_same_dept_negatives", O.statement(O.ITEMS, _POS, "d AS (SELECT * FROM items WHERE dept_id <> 0)", _consecutive("neg", "d", "dept_id"), body="SELECT * FROM neg"))
def m2(spark: SparkSession, sf: str) -> DataFrame:
    return mining.same_dept_negatives(S.items(spark, sf), half_of_positives(spark, sf))


@query("m3_random_negatives", O.statement(O.ITEMS, _POS, "d AS (SELECT *, 0 AS one FROM items WHERE label IS NOT NULL)", _consecutive("neg", "d", "one"), body="SELECT * FROM neg"))
def m3(spark: SparkSession, sf: str) -> DataFrame:
    return mining.random_negatives(S.items(spark, sf), half_of_positives(spark, sf))


_NEAR = O.near("tnn", "text_emb", O.MINING_K)
_TEXT_SIMS = """,
sims AS (
  SELECT DISTINCT i, j, (t + v) / 2 AS combined FROM (
    SELECT i, j, round(list_dot_product(a.text_emb, b.text_emb), 10) AS t, round(list_dot_product(a.img_emb, b.img_emb), 10) AS v
    FROM (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM tnn) JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j))"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.topk_self(S.items(spark, sf), "text_emb", O.MINING_K)


def near_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs near by text, as mining searches them, with their similarities."""
    return features.similarities(candidates.canonical_pairs(_near(spark, sf)), S.items(spark, sf))


def _banded(low: float, high: float | None, cap: int, ratio: int) -> str:
    top = f" AND combined < {high}" if high is not None else ""
    return f"""
band AS (SELECT s.i, s.j, CAST(a.label = b.label AS INTEGER) AS y FROM sims s JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j WHERE combined >= {low}{top}),
bp AS (SELECT * FROM band WHERE y = 1 ORDER BY {O.hashed("i", "j")}, i, j LIMIT {cap}),
bn AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {O.hashed("i", "j")}, i, j) AS rn FROM band WHERE y = 0) WHERE rn <= {ratio} * (SELECT count(*) FROM bp))"""


_BANDED = "SELECT i, j, y FROM bp UNION ALL SELECT i, j, y FROM bn"


@query("m4_high_band", O.statement(O.ITEMS, _NEAR + _TEXT_SIMS, _banded(HIGH, None, MAX_HIGH, 3), body=_BANDED))
def m4(spark: SparkSession, sf: str) -> DataFrame:
    return mining.banded(near_scored(spark, sf), S.items(spark, sf), HIGH, None, MAX_HIGH, 3)


@query("m5_medium_band", O.statement(O.ITEMS, _NEAR + _TEXT_SIMS, _banded(MEDIUM, HIGH, MAX_MEDIUM, 99), body=_BANDED))
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return mining.banded(near_scored(spark, sf), S.items(spark, sf), MEDIUM, HIGH, MAX_MEDIUM, 99)


def _hard(least: float | None) -> str:
    floor = f" AND sim >= {least}" if least is not None else ""
    return f"""
h AS (
  SELECT i, j, sim FROM (
    SELECT t.*, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM tnn t JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j WHERE a.label <> b.label{floor})
  WHERE rn = 1)"""


_HARD_PAIRS = "SELECT i, j, round(max(sim), 6) AS sim FROM (SELECT least(i, j) AS i, greatest(i, j) AS j, sim FROM h) GROUP BY 1, 2"


@query("m6_hard_negatives", O.statement(O.ITEMS, _NEAR, _hard(None), body=_HARD_PAIRS))
def m6(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.hard_negatives(_near(spark, sf), S.items(spark, sf)), "sim")


@query("m7_hard_negatives_floor", O.statement(O.ITEMS, _NEAR, _hard(0.5), body=_HARD_PAIRS))
def m7(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.hard_negatives(_near(spark, sf), S.items(spark, sf), 0.5), "sim")


_TRIPLETS = "tr AS (SELECT pos.i AS anchor, pos.j AS positive, h.j AS negative FROM pos JOIN h ON h.i = pos.i)"


@query("m8_triplets", O.statement(O.ITEMS, _NEAR, _POS, _hard(0.45), _TRIPLETS, body="SELECT * FROM tr"))
def m8(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    found, _ = mining.triplets_with_fallback(mining.positives(items), _near(spark, sf), items, [0.9, 0.45], 5)
    return found


@query("m8_coverage", O.statement(O.ITEMS, _NEAR, _POS, _hard(0.45), _TRIPLETS, body="SELECT (SELECT count(*) FROM tr) AS triplets, count(*) AS positives, round((SELECT count(*) FROM tr) / count(*), 6) AS coverage FROM pos"))
def m8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    items = S.items(spark, sf)
    pos = mining.positives(items)
    return rounded(mining.coverage(mining.triplets(pos, _near(spark, sf), items, 0.45), pos), "coverage")


@query("m9_mined_groups")
def m9(spark: SparkSession, sf: str) -> DataFrame:
    return mining.mined_groups(S.items(spark, sf), *MAX_GROUPS)


@query("m10_warmup_pairs", O.statement(O.ITEMS, _positives("p1", 1), body=f"SELECT i, j FROM p1 ORDER BY {O.hashed('i', 'j')}, i, j LIMIT {MAX_WARMUP}"))
def m10(spark: SparkSession, sf: str) -> DataFrame:
    return mining.warmup_pairs(S.items(spark, sf), MAX_WARMUP)


@query("m11_stratified_split", O.statement(O.ITEMS, body=f"SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY {O.hashed('item_id')}, item_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_val FROM items"))
def m11(spark: SparkSession, sf: str) -> DataFrame:
    return mining.stratified(S.items(spark, sf).select("item_id", "label"), "label", 0.2, "item_id")


@query("m12_class_weight", O.statement(O.ITEMS, O.PAIRS, "y AS (SELECT CAST(a.label = b.label AS INTEGER) AS y FROM pairs JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j)", body="SELECT count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 6) AS weight FROM y"))
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mining.class_weight(labelled(spark, sf)), "weight")


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs with the wide set of 84 features and whether their labels agree."""
    rows = features.pair_features(pairs(spark, sf), projected(spark, sf), ("a_label", "b_label"))
    return Scratch(spark, "training").table(rows.withColumn("y", (F.col("a_label") == F.col("b_label")).cast("int")).drop("a_label", "b_label"))


@query("t1_pair_model")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    """c3 as well: a trained pair model and its probabilities."""
    rows = _training_rows(spark, sf)
    return models.predict(rows, models.fit_trees(rows, features.WIDE_FEATURES, trees=5, depth=3), features.WIDE_FEATURES).select("i", "j", "y", "p")


@query("t2_group_model")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    groups, items = S.groups(spark, sf), S.items(spark, sf)
    rows = features.group_features(groups, pipeline.scored_group_pairs(groups, items), items)
    truth = evaluate.group_truth(groups, items).withColumnRenamed("z_true", "y")
    rows = Scratch(spark, "training").table(rows.join(truth, "group_id"))
    return models.predict(rows, models.fit_trees(rows, features.GROUP_FEATURES, trees=3, depth=2), features.GROUP_FEATURES).select("group_id", "y", "p")


@query("t3_importance")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    model = models.fit_trees(_training_rows(spark, sf), features.WIDE_FEATURES, trees=3, depth=3)
    return models.importance(spark, model, features.WIDE_FEATURES)


@query("s11_model_round_trip")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.classification import GBTClassificationModel

    rows = _training_rows(spark, sf)
    path = Scratch(spark, "model").folder()
    models.fit_trees(rows, features.WIDE_FEATURES, trees=2, depth=2).write().overwrite().save(path)
    return models.predict(rows, GBTClassificationModel.load(path), features.WIDE_FEATURES).select("i", "j", "p")
