"""Search, ranks, splits and sweeps against plain versions; trained models, the pipelines over them, and the command line."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairweave import run
from pairweave.functions.columns import in_hash_order
from pairweave.operators import candidates, clusters, evaluate, features, mining, models
from pairweave.plans import oracle as O
from pairweave.plans import pipeline, scratch
from pairweave.plans.queries_pairs import LSH_DISTANCE
from pairweave.sources import items as S
from pairweave.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(spark, n, seed=1, dims=6):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(dims)]
        size = math.sqrt(sum(x * x for x in v))
        data.append((i, [x / size for x in v]))
    return data, spark.createDataFrame(data, "item_id long, v array<double>")


def plain_topk(data, k):
    out = set()
    for i, v in data:
        best = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 10), j) for j, w in data)[: k + 1]
        out |= {(i, j) for _, j in best if j != i}
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_self_search_multiplies_each_pair_of_blocks_once(spark, block):
    data, df = vectors(spark, 90)
    got = candidates.topk_self(df, "v", 4, block=block).collect()
    assert {(r.i, r.j) for r in got} == plain_topk(data, 4) and len(got) == len({(r.i, r.j) for r in got})


def test_cells_with_all_probes_are_exact(spark):
    data, df = vectors(spark, 120, 2)
    got = candidates.topk_cells(df, "v", 4, cells=5, probes=5, block=9).collect()
    assert {(r.i, r.j) for r in got} == plain_topk(data, 4) and len(got) == len({(r.i, r.j) for r in got})
    assert candidates.topk_cells(df.where("false"), "v", 4).count() == 0
    assert candidates.topk_cells(df.limit(1), "v", 4).count() == 0


def test_recall_of_the_registered_searches(spark):
    """Cells at the query's settings, and LSH against all pairs within its distance."""
    sf = "/root/testdata/sf0.1"
    items = S.items(spark, sf).select("item_id", "text_emb").persist()
    exact = candidates.topk_self(items, "text_emb", O.K).persist()
    near = candidates.topk_cells(items, "text_emb", O.K).select("i", "j")
    assert exact.join(near, ["i", "j"], "left_semi").count() >= 0.9 * exact.count()
    every = candidates.topk_self(items, "text_emb", items.count())
    close = every.where((F.col("i") < F.col("j")) & (F.col("sim") > 1 - LSH_DISTANCE**2 / 2)).select("i", "j").persist()
    found = candidates.lsh_pairs(items, "text_emb", LSH_DISTANCE).select("i", "j").persist()
    assert close.join(found, ["i", "j"], "left_semi").count() >= 0.9 * close.count()
    assert found.join(close, ["i", "j"], "left_anti").count() <= 1e-3 * found.count()


@pytest.mark.parametrize("kind", ["string", "long"])
def test_dense_index_of_any_id(spark, kind):
    ids = spark.range(3000).select(F.col("id").cast(kind).alias("item_id"))
    want = sorted(r.item_id for r in ids.collect())
    assert [r.item_id for r in candidates.dense_index(ids).orderBy("idx").collect()] == want
    assert [r.idx for r in candidates.dense_index(ids).orderBy("idx").collect()] == list(range(3000))


def test_hash_ranks_equal_one_window(spark):
    df = spark.range(4000).selectExpr("id as item_id", "if(id % 10 < 7, 0, id % 3) as part")
    got = mining.hash_ranked(df, "item_id", within=("part",)).collect()
    order = {}
    for r in df.withColumn("h", in_hash_order("item_id")).collect():
        order.setdefault(r.part, []).append((r.h, r.item_id))
    want = {i: (n + 1, len(v)) for v in order.values() for n, (_, i) in enumerate(sorted(v))}
    assert {r.item_id: (r._rank, r._size) for r in got} == want
    assert {r.item_id for r in mining.capped(df, 100, "item_id").collect()} == {i for _, i in sorted(x for v in order.values() for x in v)[:100]}


def fewest_cuts(nodes, edges, most, keep):
    """Cut one more of the lightest tree edges until all parts fit."""
    up = {n: n for n in nodes}

    def find(u, x):
        while u[x] != x:
            x = u[x]
        return x

    tree = []
    for a, b, w in sorted(edges, key=lambda e: (e[2] if keep == "min" else -e[2], e[0], e[1])):
        x, y = find(up, a), find(up, b)
        if x != y:
            up[max(x, y)] = min(x, y)
            tree.append((w, a, b))
    tree.sort()
    for k in range(len(tree) + 1):
        u = {n: n for n in nodes}
        for _, a, b in tree[k:]:
            x, y = find(u, a), find(u, b)
            u[max(x, y)] = min(x, y)
        parts = {}
        for n in nodes:
            parts.setdefault(find(u, n), []).append(n)
        if all(len(p) <= most for p in parts.values()):
            return sorted(parts.values())


@pytest.mark.parametrize("keep", ["min", "max"])
def test_split_cuts_as_few_as_suffice(keep):
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(2, 25)
        edges = [(*sorted(rng.sample(range(n), 2)), round(rng.random(), 1)) for _ in range(rng.randrange(3 * n))]
        most = rng.randrange(1, 9)
        assert sorted(clusters.split_by_tree(list(range(n)), edges, most, keep)) == fewest_cuts(range(n), edges, most, keep)


def test_giant_components_are_split_alike(spark):
    rng = random.Random(7)
    edges = [(*sorted(rng.sample(range(8), 2)), round(rng.random(), 1)) for _ in range(11)] + [(20 + i, 21 + i, 0.5) for i in range(5)]
    df = scratch.Scratch(spark, "test").table(spark.createDataFrame(edges, "i long, j long, score double").coalesce(1))
    found = scratch.Scratch(spark, "test").table(clusters.components(spark.range(30).withColumnRenamed("id", "item_id"), df))
    assert rows(clusters.split_oversized(found, df, 3, one_task=4)) == rows(clusters.split_oversized(found, df, 3))
    tree = {(r.i, r.j) for r in clusters.spanning_tree(df, "max").collect()}
    assert len(tree) == 30 - found.select("cluster_id").distinct().count()


def test_auc_of_crowded_scores(spark):
    rng = random.Random(2)
    data = [(rng.random() * 1e-9 if rng.random() < 0.95 else rng.random(), int(rng.random() < 0.3)) for _ in range(600)] + [(0.0, 1)] * 20 + [(0.0, 0)] * 30
    pos, neg = ([p for p, y in data if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(data, "p double, y int")).first().auc == pytest.approx(want)


def test_counts_need_no_pairs(spark, sf):
    items = S.items(spark, sf)
    truth = candidates.label_pairs(items)
    pairs = spark.createDataFrame([(i, i + d) for i in range(300) for d in (1, 7, 50)], "i long, j long")
    r = evaluate.retrieval_recall(pairs, items).first()
    assert (r.hits, r.total) == (truth.join(pairs, ["i", "j"], "left_semi").count(), truth.count())
    marked = evaluate.marked(pairs, items)
    assert rows(marked.where("y = 1").select("i", "j")) == rows(pairs.join(truth, ["i", "j"], "left_semi").select("i", "j"))


def test_sweep_equals_clustering_anew(spark, sf):
    items = S.items(spark, sf)
    rng = random.Random(5)
    edges = spark.createDataFrame([(*sorted(rng.sample(range(500), 2)), rng.random()) for _ in range(700)], "i long, j long, score double")
    at = [0.9, 0.7]
    got = {r.threshold: (r.groups, r.f1) for r in evaluate.sweep(items, edges, items, at).collect()}
    for t in at:
        c = clusters.components(items, clusters.edges_at(edges, t))
        assert got[t] == (c.select("cluster_id").distinct().count(), pytest.approx(evaluate.pairwise_f1(c, items).first().f1))
    split = lambda c, e, t: clusters.split_oversized(c, clusters.edges_at(e, t), 5)
    assert {r.threshold for r in evaluate.sweep(items, edges, items, [0.9], split).collect()} == {0.9}


# models


@pytest.fixture(scope="module")
def wide(spark, sf):
    items = scratch.Scratch(spark, "test").table(features.with_projections(S.items(spark, sf)))
    pairs = spark.createDataFrame([(i, j) for i in range(0, 120) for j in range(i + 1, i + 6)], "i long, j long")
    out = features.pair_features(pairs, items, ("a_label", "b_label")).withColumn("y", (F.col("a_label") == F.col("b_label")).cast("int"))
    return items, scratch.Scratch(spark, "test").table(out)


def test_projections(spark, wide, sf):
    items, out = wide
    model = features.fit_pca(S.items(spark, sf), "text_emb", 8)
    shares = features.explained_variance(spark, model).orderBy("component").collect()
    assert [r.component for r in shares] == list(range(1, 9)) and all(a.explained >= b.explained > 0 for a, b in zip(shares, shares[1:], strict=False))
    assert shares[-1].total == pytest.approx(sum(r.explained for r in shares))
    axes = model.pc.toArray()
    for r in features.project(S.items(spark, sf), model, "text_emb", "p").limit(5).collect():
        assert r.p == pytest.approx(list(axes.T @ r.text_emb))
    r = out.first()
    pca = {x.item_id: x for x in items.where(F.col("item_id").isin(r.i, r.j)).collect()}
    assert r.text_pca_diff == pytest.approx([abs(a - b) for a, b in zip(pca[r.i].text_pca, pca[r.j].text_pca, strict=True)])
    assert len(features.PAIR_FEATURES) + len(r.text_pca_diff) + len(r.img_pca_diff) == 84


def test_trees_learn_round_trip_and_say_what_counts(spark, wide, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    rule = wide[1].withColumn("y", (F.col("text_pca_diff")[3] > 0.2).cast("int"))
    model = models.fit_trees(rule, features.WIDE_FEATURES, trees=4, depth=3)
    got = models.predict(rule, model, features.WIDE_FEATURES).collect()
    assert sum((r.p >= 0.5) == bool(r.y) for r in got) > 0.95 * len(got) and all(0 <= r.p <= 1 for r in got)
    top = models.importance(spark, model, features.WIDE_FEATURES)
    assert top.first().feature == "text_pca_diff_3" and top.count() == 86 and top.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = models.predict(rule, GBTClassificationModel.load(str(tmp_path / "m")), features.WIDE_FEATURES).collect()
    assert {(r.i, r.j, r.p) for r in again} == {(r.i, r.j, r.p) for r in got}
    price = rule.withColumn("price_ratio", F.lit(None).cast("double"))
    assert models.predict(price, model, features.WIDE_FEATURES).where("p is null").count() == 0


def test_bands_are_scored_by_their_models(spark, sf):
    items = S.items(spark, sf).where("item_id < 120")
    s = pipeline.fixture_settings(top_k=10, model=True, medium_band=True, medium_least=0.5, high=0.3, medium=0.1)
    pairs = pipeline.scored_pairs(items, s, None, F.lit(0.9), lambda df, out: df.withColumn(out, F.when(F.col("price_ratio") > 0.5, 0.6).otherwise(0.4)))
    wide = features.pair_features(pairs, items)
    for r in wide.collect():
        want = 0.9 if r.combined_sim >= 0.3 else (0.6 if r.price_ratio > 0.5 else 0.0) if r.combined_sim >= 0.1 else 0.0
        assert r.score == want
    one = pipeline.scored_pairs(items, pipeline.fixture_settings(top_k=10, model=True), None, F.lit(0.7))
    assert {r.score for r in one.collect()} == {0.7}
    with pytest.raises(ValueError):
        pipeline.candidate_pairs(items, pipeline.fixture_settings(search="other"))


def test_model_pipelines_partition_all_items(spark, sf, wide):
    items = wide[0].where("item_id < 150")
    s = pipeline.fixture_settings(top_k=10, model=True, medium_band=True, medium_least=0.3, threshold=0.3, high=0.3, medium=0.2)
    got = pipeline.grouping(items, s, None, *pipeline.band_models(items, s, 100, 100, trees=2, depth=2))
    assert sorted(r.item_id for r in got.collect()) == list(range(150))
    got = entry.queries()["pipeline_grouping_full"](spark, sf)
    assert sorted(r.item_id for r in got.collect()) == sorted(r.item_id for r in S.items(spark, sf).select("item_id").collect())


def test_group_models_answer_all_groups(spark, sf):
    items = S.items(spark, sf)
    got = pipeline.group_answers(S.groups(spark, sf), items, *pipeline.group_models(items, 200, 200, 100, trees=2, depth=2), 0.28).collect()
    assert sorted(r.group_id for r in got) == sorted({r.group_id for r in S.groups(spark, sf).collect()})
    assert all(r.z == int(r.p >= 0.28) for r in got)


# entry points


@pytest.fixture(scope="module")
def listing(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("listing")
    items = S.items(spark, sf).where("item_id < 160")
    listed = items.select(
        F.concat(F.lit("x"), "item_id").alias("itemId"), "title", F.substring("description", 1, 80).alias("description"), "geo", "price",
        F.format_string("[%d]", "dept_id").alias("departmentIds"), F.col("color_id").cast("string").alias("colorTagIdsString"), F.col("brand_id").cast("string").alias("brandEditionTagId"), "label",
    )
    for split, of in (("train", "label % 2 = 0 or label = 5"), ("phase_2", "label % 2 = 1")):
        pdf = listed.where(of).toPandas()
        pdf.to_csv(root / f"items_{split}.csv", index=False)
        items.select(F.concat(F.lit("x"), "item_id").alias("item_id"), "text_emb", "img_emb").write.parquet(f"{root}/base/{split}.parquet")
    return str(root)


@pytest.mark.parametrize("switches", [["--and_sim", "--dept_filter", "--boost", "--rules", "--threshold", "0.3"], ["--use_model", "--medmatch", "--search", "cells", "--threshold", "0.5", "--anchor", "--anchor_sim", "0.2", "--louvain"], ["--crossencoder", "--ce_filter", "--sweep"]])
def test_command_line(spark, listing, tmp_path, switches):
    got = run.main(spark, ["--root", listing, "--out", str(tmp_path), "--top_k", "8", "--high", "0.3", "--medium", "0.2", *switches])
    written = sorted(f for f in os.listdir(tmp_path) if f.startswith("clusters_t"))
    assert len(written) == (7 if "--sweep" in switches else 1)
    n = got.count()
    assert n == got.select("item_id").distinct().count() > 0
    for f in written:
        assert sum(len(r.value.split(",")) for r in spark.read.text(f"{tmp_path}/{f}").collect()) == n


def test_command_line_validates(spark, listing, tmp_path):
    got = run.main(spark, ["--root", listing, "--out", str(tmp_path), "--validate", "--sweep", "--top_k", "8"])
    assert sorted(r.threshold for r in got.collect()) == run.SWEEP_SIMILARITY and os.path.exists(tmp_path / "metrics" / "_SUCCESS")


def test_other_queries_survive_a_missing_library():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'j1_topk_text' in q and 'op1_minhash_neardup' not in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_scratch_folders_are_removed(spark):
    s = scratch.Scratch(spark, "gone")
    spark.range(3).write.parquet(s.folder("x"))
    t = s.table(spark.range(3))
    path = s.root.removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(path + "/x") and os.path.isdir(path + "/0")
    left = [x for x in scratch._LEFT if x[1].startswith(s.root)]
    assert len(left) == 2
    for spark_, p in left:
        scratch._remove(spark_, p)
        scratch._LEFT.remove((spark_, p))
    assert not os.path.isdir(path + "/x") and not os.path.isdir(path + "/0")


def test_embedding_sets_are_found(spark, tmp_path):
    for name, splits in S.EMBEDDING_SETS.items():
        spark.range(2).selectExpr("id as item_id").write.parquet(f"{tmp_path}/{splits['train']}")
        assert S.read_embeddings(spark, str(tmp_path), name, "train").count() == 2


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "item_id long, text string")
    got = models.encode_items(df, "text", lambda s: s.map(lambda t: [float(len(t)), 1.0])).collect()
    assert sorted((r.item_id, r.embedding) for r in got) == [(1, [2.0, 1.0]), (2, [3.0, 1.0])]


def test_a_stage_is_built_anew_when_its_input_changes(spark, tmp_path):
    path, calls = f"{tmp_path}/in", []
    build = lambda: calls.append(1) or spark.read.parquet(path)
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        for _ in range(2):
            assert sinks.cached(spark, f"{tmp_path}/s", "x", {}, build, (path,)).count() == n
    assert len(calls) == 2
