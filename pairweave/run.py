"""Command line of the grouping pipeline: ``python -m pairweave.run --root DATA --out FOLDER [switches]``.

``--root`` holds ``items_train.csv`` and ``items_<split>.csv`` and the embedding sets of
`sources.items.EMBEDDING_SETS` (item_id, text_emb, img_emb). Clusters are written below
``--out``, one folder for each threshold; with ``--validate`` the labels whose number is
divisible by five are grouped and the metrics are written instead.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.functions.columns import l2_normalize, as_doubles, to_euro
from pairweave.operators import features
from pairweave.plans import pipeline
from pairweave.plans.scratch import Scratch
from pairweave.sources import items as S
from pairweave.sources import sinks

# The thresholds of a sweep by scorer.
SWEEP_TEXT_PAIRS = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
SWEEP_MODEL = [0.01, 0.05, 0.10, 0.15, 0.20, 0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34, 0.36, 0.38, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99]
SWEEP_SIMILARITY = [0.88, 0.90, 0.92, 0.93, 0.94, 0.95, 0.97]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairweave.run", description="Groups items that are the same product.")
    p.add_argument("--root", required=True, help="folder of item lists and embedding sets")
    p.add_argument("--out", required=True, help="folder for results")
    p.add_argument("--phase1", action="store_true", help="group the items of phase_1 instead of phase_2")
    p.add_argument("--validate", action="store_true", help="group labelled items held out of training and measure")
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--sweep", action="store_true", help="every threshold of the scorer's grid")
    p.add_argument("--top_k", type=int, default=50)
    p.add_argument("--search", choices=["exact", "cells"], default="exact")
    p.add_argument("--text_weight", type=float, default=0.5)
    p.add_argument("--and_sim", action="store_true", help="score by the smaller similarity")
    p.add_argument("--use_model", action="store_true", help="score by models trained on the labelled items")
    p.add_argument("--medmatch", action="store_true", help="a second model for the medium band")
    p.add_argument("--crossencoder", action="store_true", help="score by text pairs")
    p.add_argument("--ce_filter", action="store_true", help="veto by text pairs")
    p.add_argument("--dept_filter", action="store_true")
    p.add_argument("--boost", action="store_true")
    p.add_argument("--rules", action="store_true")
    p.add_argument("--anchor", action="store_true", help="pairs bridged by labelled items")
    p.add_argument("--anchor_sim", type=float, default=0.92)
    p.add_argument("--louvain", action="store_true")
    p.add_argument("--emb", choices=sorted(S.EMBEDDING_SETS), default="base")
    p.add_argument("--high", type=float, default=pipeline.Settings.high, help="where the high band starts")
    p.add_argument("--medium", type=float, default=pipeline.Settings.medium, help="where the medium band starts")
    return p


def settings(a: argparse.Namespace) -> pipeline.Settings:
    return pipeline.Settings(
        top_k=a.top_k, search=a.search, threshold=a.threshold, text_weight=a.text_weight, and_sim=a.and_sim, model=a.use_model, medium_band=a.medmatch and a.use_model,
        text_pairs=a.crossencoder, ce_veto=a.ce_filter, dept_filter=a.dept_filter, boost=a.boost, rules=a.rules, anchors=a.anchor, anchor_sim=a.anchor_sim,
        louvain=a.louvain, high=a.high, medium=a.medium,
    )


def grid(s: pipeline.Settings) -> list[float]:
    return {"text_pairs": SWEEP_TEXT_PAIRS, "model": SWEEP_MODEL, "two_band": SWEEP_MODEL}.get(s.scorer(), SWEEP_SIMILARITY)


def codes(listed: DataFrame) -> dict[str, DataFrame]:
    """The dictionaries of the listed items' category columns."""
    return {out: S.dictionary(listed, c) for c, out in (("departmentIds", "dept_id"), ("colorTagIdsString", "color_id"), ("brandEditionTagId", "brand_id"))}


def canonical(listed: DataFrame, vectors: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The canonical item rows of listed items that have vectors."""
    rows = listed.withColumnRenamed("itemId", "item_id").withColumn("price", to_euro(F.col("price"), F.col("geo")))
    for c, out in (("departmentIds", "dept_id"), ("colorTagIdsString", "color_id"), ("brandEditionTagId", "brand_id")):
        rows = S.encode_with(rows, c, dictionaries[out], out)
    unit = lambda c: l2_normalize(as_doubles(F.col(c))).alias(c)
    kept = rows.select("item_id", "title", "description", "geo", "price", "dept_id", "color_id", "brand_id", "label")
    return kept.join(vectors.select("item_id", unit("text_emb"), unit("img_emb")), "item_id")


def main(spark: SparkSession, arguments: list[str] | None = None) -> DataFrame:
    """Runs the pipeline; returns the metrics, or the clusters of the last threshold."""
    a = parser().parse_args(arguments)
    s, scratch = settings(a), Scratch(spark, "run")
    listed = S.read_items(spark, f"{a.root}/items_train.csv")
    known = scratch.table(codes(listed)["dept_id"]), scratch.table(codes(listed)["color_id"]), scratch.table(codes(listed)["brand_id"])
    dictionaries = dict(zip(("dept_id", "color_id", "brand_id"), known, strict=True))
    labelled = scratch.table(canonical(listed, S.read_embeddings(spark, a.root, a.emb, "train"), dictionaries))
    if a.validate:
        held = F.pmod("label", F.lit(5)) == 0
        items, labelled = labelled.where(held), labelled.where(~held)
    else:
        split = "phase_1" if a.phase1 else "phase_2"
        items = canonical(S.read_items(spark, f"{a.root}/items_{split}.csv"), S.read_embeddings(spark, a.root, a.emb, split), dictionaries)
    models = (None, None)
    if a.use_model:
        both = features.with_projections(labelled.withColumn("_part", F.lit(0)).unionByName(items.withColumn("_part", F.lit(1))))
        both = scratch.table(both)
        labelled, items = both.where("_part = 0").drop("_part"), both.where("_part = 1").drop("_part")
        models = pipeline.band_models(labelled, s, 80_000, 60_000)
    else:
        items = scratch.table(items)
    thresholds = grid(s) if a.sweep else [s.threshold]
    if a.validate:
        found = scratch.table(pipeline.swept(items, s, thresholds, items, labelled, *models))
        found.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.out}/metrics")
        return found
    pairs = scratch.table(pipeline.scored_pairs(items, s, labelled, *models))
    for t in thresholds:
        clusters = scratch.table(pipeline.clustered(items, pairs, s, t))
        sinks.write_clusters(clusters, f"{a.out}/clusters_t{t}")
    return clusters


if __name__ == "__main__":
    main(SparkSession.builder.appName("pairweave").getOrCreate())
