"""The two task pipelines as configured plans: grouping of all items, and duplicates in given groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairweave.operators import candidates, clusters, evaluate, features, mining, models, scoring
from pairweave.plans.scratch import Scratch

#: What scores pairs: a column over their features, or a function that adds one of the given name.
Scorer = Column | Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Every switch of the grouping pipeline; thresholds fit unit-vector similarities of the data at hand."""

    top_k: int = 50
    search: str = "exact"
    cells: int | None = None
    probes: int | None = None
    threshold: float = 0.95
    text_weight: float = 0.5
    and_sim: bool = False
    model: bool = False
    medium_band: bool = False
    text_pairs: bool = False
    dept_filter: bool = False
    boost: bool = False
    rules: bool = False
    ce_veto: bool = False
    anchors: bool = False
    anchor_sim: float = 0.92
    louvain: bool = False
    high: float = scoring.HIGH
    medium: float = scoring.MEDIUM
    medium_least: float = scoring.MEDIUM_LEAST
    min_sim: float | None = None
    max_size: int = clusters.MAX_SIZE

    def scorer(self) -> str:
        """The scorer that counts where several are switched on."""
        if self.text_pairs:
            return "text_pairs"
        if self.model:
            return "two_band" if self.medium_band else "model"
        return "and_sim" if self.and_sim else "weighted"


def neighbours(items: DataFrame, vector: str, s: Settings) -> DataFrame:
    """The nearest items of every item, by the search that the settings name."""
    if s.search == "cells":
        return candidates.topk_cells(items, vector, s.top_k, s.cells, s.probes)
    if s.search != "exact":
        raise ValueError(f"no search is named {s.search}")
    return candidates.topk_self(items, vector, s.top_k)


def candidate_pairs(items: DataFrame, s: Settings) -> DataFrame:
    """Pairs that are near by text or by image."""
    return candidates.canonical_pairs(neighbours(items, "text_emb", s), neighbours(items, "img_emb", s))


def _scored_by(pairs: DataFrame, scorer: Scorer, out: str) -> DataFrame:
    return pairs.withColumn(out, scorer) if isinstance(scorer, Column) else scorer(pairs, out)


def _score(s: Settings) -> Column:
    sim = F.col("combined_sim")
    t, v = F.col("text_cosine_sim"), F.col("img_cosine_sim")
    return {
        "weighted": lambda: t * s.text_weight + v * (1 - s.text_weight),
        "and_sim": lambda: F.least(t, v),
        "model": lambda: F.col("_high"),
        "two_band": lambda: scoring.two_band(sim, F.col("_high"), F.col("_medium"), s.high, s.medium, s.medium_least),
        "text_pairs": lambda: F.when(sim >= s.high, F.col("ce")).otherwise(0.0),
    }[s.scorer()]()


def scored_pairs(
    items: DataFrame, s: Settings, labelled: DataFrame | None = None, high: Scorer | None = None, medium: Scorer | None = None, found: DataFrame | None = None
) -> DataFrame:
    """i, j, score after the scorer and the rewrites, in their fixed order, of the candidates in ``found`` or else of a search.

    ``high`` and ``medium`` score the pairs of their band; without them the fixed logistic
    scorer does, and without ``medium`` both bands share ``high``. A trained model scores
    once for each band that is switched on. The raw score is computed once; filters and
    rewrites are columns over it. Anchor pairs join after the column rewrites and are
    subject to the veto only.
    """
    needs_text = s.text_pairs or s.ce_veto
    keep = ("a_dept_id", "b_dept_id") + (("a_title", "a_description", "b_title", "b_description") if needs_text else ())
    pairs = features.pair_features(candidate_pairs(items, s) if found is None else found, items, keep, s.search == "cells")
    if s.min_sim is not None:
        pairs = candidates.above(pairs, "combined_sim", s.min_sim)
    if needs_text:
        text = lambda p: F.concat_ws(" ", f"{p}_title", F.substring(F.coalesce(F.col(f"{p}_description"), F.lit("")), 1, 150))
        pairs = scoring.text_pair_scores(pairs, "combined_sim", s.high, scoring.token_jaccard(text("a"), text("b")))
    first = high if high is not None else scoring.logistic()
    if s.scorer() in ("model", "two_band"):
        pairs = _scored_by(pairs, first, "_high")
    if s.scorer() == "two_band":
        pairs = _scored_by(pairs, medium, "_medium") if medium is not None else pairs.withColumn("_medium", F.col("_high"))
    pairs = pairs.withColumn("score", _score(s))
    rewrites = [(s.dept_filter, scoring.dept_filter), (s.boost, scoring.boost), (s.rules, lambda c: scoring.override(c, s.medium, s.high))]
    for on, rewrite in rewrites:
        if on:
            pairs = pairs.withColumn("score", rewrite(F.col("score")))
    out = pairs.select("i", "j", "score")
    if s.anchors and labelled is not None:
        found = candidates.anchors(items, labelled, 10, s.anchor_sim)
        out = candidates.merge_pairs(out, candidates.anchor_pairs(found), items)
    return scoring.veto(out, pairs.select("i", "j", "ce")) if s.ce_veto else out


def grouping(
    items: DataFrame, s: Settings, labelled: DataFrame | None = None, high: Scorer | None = None, medium: Scorer | None = None, found: DataFrame | None = None
) -> DataFrame:
    """item_id, cluster_id for all items."""
    pairs = Scratch(items.sparkSession, "pairs").table(scored_pairs(items, s, labelled, high, medium, found))
    return clustered(items, pairs, s, s.threshold)


def clustered(items: DataFrame, pairs: DataFrame, s: Settings, threshold: float) -> DataFrame:
    """item_id, cluster_id of scored pairs at a threshold."""
    return clusters.cluster(items, pairs, threshold, s.max_size, s.louvain)


def swept(items: DataFrame, s: Settings, thresholds: list[float], truth: DataFrame, labelled: DataFrame | None = None, high: Scorer | None = None, medium: Scorer | None = None) -> DataFrame:
    """threshold, groups, precision, recall, f1 of the grouping at every threshold; pairs are scored once."""
    pairs = Scratch(items.sparkSession, "pairs").table(scored_pairs(items, s, labelled, high, medium))
    if s.louvain:
        finish = lambda c, e, t: clusters.louvain(items, clusters.edges_at(e, t), s.max_size)
    else:
        finish = lambda c, e, t: clusters.split_oversized(c, clusters.edges_at(e, t), s.max_size)
    return evaluate.sweep(items, pairs, truth, thresholds, finish)


def band_models(items: DataFrame, s: Settings, high_cap: int, medium_cap: int, trees: int = 20, depth: int = 4, found: DataFrame | None = None) -> tuple[Scorer, Scorer]:
    """Trained scorers for the high and the medium band, each from pairs mined in its band among ``found`` or else among those of a search.

    They read the wide features where items have projections. A band without pairs of both
    labels keeps the fixed logistic scorer.
    """
    names = features.WIDE_FEATURES if "text_pca" in items.columns else features.PAIR_FEATURES
    scratch = Scratch(items.sparkSession, "bands")
    scored = scratch.table(features.similarities(candidate_pairs(items, s) if found is None else found, items, s.search == "cells"))
    out = []
    for low, top, cap, ratio in ((s.high, None, high_cap, 3), (s.medium, s.high, medium_cap, 99)):
        rows = scratch.table(features.pair_features(mining.banded(scored, items, low, top, cap, ratio), items, by_block=s.search == "cells"))
        both = rows.select("y").distinct().count() == 2
        out.append(models.scorer(models.fit_trees(rows, names, trees=trees, depth=depth), names) if both else scoring.logistic())
    return out[0], out[1]


def scored_group_pairs(groups: DataFrame, items: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """All pairs within groups with their features and probability p, by the fixed logistic scorer unless another is given."""
    return _scored_by(features.pair_features(candidates.group_pairs(groups), items), scorer if scorer is not None else scoring.logistic(), "p")


def group_models(items: DataFrame, n_pos: int, n_neg: int, n_dept: int, trees: int = 20, depth: int = 4) -> tuple[Scorer, GBTClassificationModel]:
    """A pair model and on top of it a group model, both from mined rows of labelled items.

    Pairs: positives, and negatives within departments and at random, half as many of
    each. Groups: mined ones, described by the pair model's probabilities.
    """
    scratch = Scratch(items.sparkSession, "groups")
    pos = scratch.table(mining.positives(items).select("i", "j"))
    half = max(1, pos.count() // 2)
    negatives = mining.same_dept_negatives(items, half).unionByName(mining.random_negatives(items, half)).distinct()
    mined = pos.withColumn("y", F.lit(1)).unionByName(negatives.withColumn("y", F.lit(0)))
    rows = scratch.table(features.pair_features(mined, items))
    pair = models.scorer(models.fit_trees(rows, features.PAIR_FEATURES, trees=trees, depth=depth), features.PAIR_FEATURES)
    found = scratch.table(mining.mined_groups(items, n_pos, n_neg, n_dept))
    groups = found.withColumn("pos", F.row_number().over(W.partitionBy("group_id").orderBy("item_id")) - 1).select("group_id", "pos", "item_id")  # five rows a group
    known = found.select("group_id", F.col("z").alias("y")).distinct()
    described = features.group_features(groups, scored_group_pairs(groups, items, pair), items).join(known, "group_id")
    return pair, models.fit_trees(scratch.table(described), features.GROUP_FEATURES, trees=trees, depth=depth)


def group_answers(groups: DataFrame, items: DataFrame, pair: Scorer, model: GBTClassificationModel, threshold: float) -> DataFrame:
    """group_id, p, z: whether the group model finds a duplicate in a group."""
    rows = features.group_features(groups, scored_group_pairs(groups, items, pair), items)
    return models.predict(rows, model, features.GROUP_FEATURES).select("group_id", "p", (F.col("p") >= threshold).cast("int").alias("z"))


def duplicates_in_groups(groups: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """group_id, z: 1 where the best pair of a group reaches the threshold; groups without pairs get 0."""
    best = scored_group_pairs(groups, items).groupBy("group_id").agg(F.max("p").alias("best"))
    return groups.select("group_id").distinct().join(best, "group_id", "left").select("group_id", F.coalesce((F.col("best") >= threshold).cast("int"), F.lit(0)).alias("z"))


def fixture_settings(**changes) -> Settings:
    """Settings for the driver's vectors, whose similarities are far lower than trained ones."""
    return replace(Settings(threshold=0.35, high=0.35, medium=0.25), **changes)
