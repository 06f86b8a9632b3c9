"""Goldens, bounds and properties of the entity-resolution operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairweave.functions import columns as C
from pairweave.operators import candidates, clusters, evaluate, features, graph, mining, scoring
from pairweave.plans import pipeline
from pairweave.sources import items as S
from pairweave.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_toy_pairwise_f1(spark):
    truth = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("D", 2), ("E", 2)], "item_id string, label long")
    pred = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2), ("D", 2), ("E", 2)], "item_id string, cluster_id long")
    r = evaluate.pairwise_f1(pred, truth).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (2, 2, 2, 0.5, 0.5, 0.5)


def test_empty_f1_is_zero(spark):
    none = spark.createDataFrame([], "item_id long, cluster_id long"), spark.createDataFrame([], "item_id long, label long")
    r = evaluate.pairwise_f1(*none).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (0, 0, 0, 0.0)


def test_code_predicates(spark):
    d = spark.createDataFrame([(0, 0), (1, 2), (1, 0), (3, 3)], "a int, b int")
    got = d.select(C.match(F.col("a"), F.col("b")), C.compatible(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, True), (0.0, False), (0.0, True), (1.0, True)]
    d = spark.createDataFrame([(0, 0, 0.5), (1, 2, 0.5), (1, 0, 0.5)], "a_dept_id int, b_dept_id int, s double")
    assert [r[0] for r in d.select(scoring.dept_filter(F.col("s"))).collect()] == [0.5, 0.0, 0.5]


def test_dirty_ids(spark):
    cells = spark.createDataFrame([("[11, 42]",), ("11,42",), ("",), ("abc",), (None,), ("007",)], "c string")
    assert [r[0] for r in cells.select(C.numbers(F.col("c"))).collect()] == [["11", "42"], ["11", "42"], [], [], [], ["007"]]
    codes = S.dictionary(cells, "c")
    assert rows(codes) == [("11", 2), ("42", 3), ("7", 1)]
    coded = S.encode_with(cells.withColumn("n", F.monotonically_increasing_id()), "c", codes.where("raw_id <> '42'"), "code")
    assert sorted((r["c"] if r["c"] is not None else "-", r["code"]) for r in coded.collect()) == [("", 0), ("-", 0), ("007", 1), ("11,42", 2), ("[11, 42]", 2), ("abc", 0)]


def test_prices(spark):
    d = spark.createDataFrame([(100.0, "CZ"), (100.0, "xx"), (None, "cz"), (100.0, None)], "p double, g string")
    assert [r[0] for r in d.select(C.to_euro(F.col("p"), F.col("g"))).collect()] == [4.0, 100.0, None, 100.0]


def test_zero_vectors_and_masks(spark):
    d = spark.createDataFrame([([0.0, 0.0], [[1.0, 2.0], [3.0, 4.0]], [0, 0]), ([3.0, 4.0], [[1.0, 2.0], [3.0, 4.0]], [1, 1])], "v array<double>, vs array<array<double>>, m array<int>")
    got = d.select(C.l2_normalize(F.col("v")), C.masked_mean(F.col("vs"), F.col("m"), 2)).collect()
    assert [list(r) for r in got] == [[[0.0, 0.0], [0.0, 0.0]], [[0.6, 0.8], [2.0, 3.0]]]


def test_item_text(spark):
    d = spark.createDataFrame([(None, None), ("a", None), ("a", "bcdef")], "t string, d string")
    assert [r[0] for r in d.select(C.item_text(F.col("t"), F.col("d"), 3)).collect()] == ["", "a", "a bcd"]


def test_score_bounds(spark):
    cols = "combined_sim double, score double, brand_match double, dept_match double, color_match double, price_ratio double, img_cosine_sim double"
    same = (1.0, 1.0, 1.0, 0.9, 0.9)
    d = spark.createDataFrame([(0.7, 0.15, *same), (0.88, 0.30, *same), (0.6999, 0.1499, *same)], cols)
    assert [r[0] for r in d.select(scoring.boost(F.col("score"))).collect()] == [0.30, 0.30, 0.1499]
    assert [r[0] for r in d.select(scoring.override(F.col("score"))).collect()] == [0.85, 0.30, 0.1499]
    band = scoring.two_band(F.col("combined_sim"), F.lit(0.4), F.col("score") * 0 + 0.7)
    assert [r[0] for r in d.select(band).collect()] == [0.7, 0.4, 0.0]
    for f in (scoring.boost, scoring.override):
        once = d.withColumn("score", f(F.col("score")))
        assert rows(once) == rows(once.withColumn("score", f(F.col("score"))))


def test_veto_keeps_unscored(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9), (1, 5, 0.9)], "i long, j long, score double")
    ce = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.29), (1, 4, 0.3)], "i long, j long, ce double")
    assert rows(scoring.veto(pairs, ce)) == [(1, 2, 0.9), (1, 3, 0.0), (1, 4, 0.9), (1, 5, 0.9)]


def test_groups_with_gaps(spark, sf):
    items = S.items(spark, sf)
    g = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 999999), (2, 0, 999998), (2, 1, 999997), (3, 0, 5), (3, 1, 5)], "group_id long, pos int, item_id long")
    got = {r.group_id: r for r in features.group_features(g, pipeline.scored_group_pairs(g, items), items).collect()}
    assert set(got) == {1, 2, 3}
    assert got[2].prob_max == 0.0 and got[1].prob_2nd == 0.0 and got[1].prob_max > 0
    assert got[3].text_sim_max == pytest.approx(1.0)
    answers = {r.group_id: r.z for r in pipeline.duplicates_in_groups(g, items, 0.99).collect()}
    assert answers == {1: 0, 2: 0, 3: 1}


def test_topk_against_brute_force(spark):
    rng = random.Random(4)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, [1.0, 0.0, 0.0, 0.0]), (101, [1.0, 0.0, 0.0, 0.0]), (102, [1.0, 0.0, 0.0, 0.0]), (103, None)]
    df = spark.createDataFrame(data, "item_id long, v array<double>")
    got = {}
    for r in candidates.topk_exact(df, df, "v", 3, block=16).collect():
        got.setdefault(r.i, []).append((r.rank, r.j))
    for i, v in data:
        if v is not None:
            want = sorted(((-round(sum(a * b for a, b in zip(v, w)), 10), j) for j, w in data if w is not None))[:3]
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert 103 not in got


def test_more_duplicates_than_k(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "item_id long, v array<double>")
    n = candidates.topk_self(df, "v", 2).groupBy("i").count().collect()
    assert {r["i"]: r["count"] for r in n} == {0: 2, 1: 2, 2: 2, 3: 3, 4: 3}  # itself may be displaced


def test_cells_recall(spark, sf):
    items = S.items(spark, sf)
    exact = candidates.topk_self(items, "text_emb", 5).select("i", "j")
    near = candidates.topk_cells(items, "text_emb", 5, cells=8, probes=6).select("i", "j")
    assert exact.join(near, ["i", "j"], "left_semi").count() >= 0.9 * exact.count()


def test_pairs_are_canonical(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, -1), (5, None)], "i long, j long")
    assert rows(candidates.canonical_pairs(a, a)) == [(1, 2)]


def test_dense_index_and_subset(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(50)], "item_id long")
    assert rows(candidates.dense_index(ids)) == [(i * 7, i) for i in range(50)]
    some = spark.createDataFrame([(14,), (0,), (49,)], "item_id long")
    assert rows(candidates.subset(ids, some)) == [(0, 0), (14, 1), (49, 2)]
    assert candidates.dense_index(ids.where("false")).count() == 0


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, 3), (3, 7), (5, 6), (6, 5), (8, 8)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert dict(rows(graph.connected_components(df))) == brute(edges)


def test_components_random(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    assert dict(rows(graph.connected_components(spark.createDataFrame(edges, "src long, dst long")))) == brute(edges)


def test_no_edges_are_singletons(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    pairs = spark.createDataFrame([(1, 2, 0.1)], "i long, j long, score double")
    assert rows(clusters.cluster(items, pairs, 0.5)) == [(1, 1), (2, 2)]
    assert rows(clusters.cluster(items, pairs, 0.5, communities=True)) == [(1, 1), (2, 2)]


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 40), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from(["min", "max"]))
def test_split_sizes(n, most, seed, keep):
    rng = random.Random(seed)
    edges = [(rng.randrange(i), i, round(rng.random(), 2)) for i in range(1, n)]
    parts = clusters.split_by_tree(list(range(n)), edges, most, keep)
    assert sorted(x for p in parts for x in p) == list(range(n)) and max(map(len, parts)) <= most


def test_split_cuts_the_weakest_link():
    edges = [(0, 1, 0.9), (1, 2, 0.1), (2, 3, 0.9)]
    assert sorted(clusters.split_by_tree([0, 1, 2, 3], edges, 2)) == [[0, 1], [2, 3]]


def test_louvain_finds_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    assert sorted(clusters.louvain_parts([*range(5), *range(10, 15)], edges)) == [list(range(5)), list(range(10, 15))]
    items = spark.createDataFrame([(i,) for i in range(16)], "item_id long")
    found = clusters.louvain(items, spark.createDataFrame(edges, "i long, j long, score double"), 3)
    assert found.count() == 16 and clusters.violations(found, 3).count() == 0


def test_similarity_bins_leave_out_negatives(spark):
    s = spark.createDataFrame([(1, 2, -0.1), (1, 3, 0.0), (2, 3, 0.95), (1, 4, 1.0)], "i long, j long, combined double")
    items = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "item_id long, label long")
    assert [(r.bin_low, r.n, r.positives) for r in evaluate.similarity_bins(s, items).orderBy("bin_low").collect()] == [(0.0, 1, 1), (0.95, 2, 1)]


def test_auc_with_ties(spark):
    rng = random.Random(2)
    data = [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(200)]
    pos, neg = ([p for p, y in data if y == k] for k in (1, 0))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(data, "p double, y int")).first().auc == pytest.approx(want)


def test_positives_are_capped(spark):
    items = spark.createDataFrame([(1, 1)] + [(i, 2) for i in (2, 3)] + [(i, 3) for i in range(4, 9)] + [(9, None)], "item_id long, label long")
    n = {r["label"]: r["count"] for r in mining.positives(items).groupBy("label").count().collect()}
    assert n == {2: 1, 3: 3}


def test_mined_groups(spark, sf):
    items = S.items(spark, sf)
    got = mining.mined_groups(items, 20, 20).join(items.select("item_id", "label"), "item_id").collect()
    groups = {}
    for r in got:
        groups.setdefault((r.group_id, r.z), []).append(r.label)
    assert all(len(v) == 5 for v in groups.values())
    assert all((len(set(v)) == 5) == (z == 0) for (_, z), v in groups.items())


def test_csv_sinks_and_cache(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('itemId,title,description,geo,price,departmentIds,colorTagIdsString,brandEditionTagId,label\n007,"a, ""b""",,cz,x,"[1, 2]",,5,3\n')
    r = S.read_items(spark, str(path)).first()
    assert (r.itemId, r.title, r.description, r.price, r.departmentIds) == ("007", 'a, "b"', None, None, "[1, 2]")
    clusters_ = spark.createDataFrame([(1, 1), (3, 1), (2, 2)], "item_id long, cluster_id long")
    sinks.write_clusters(clusters_, str(tmp_path / "c"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["1,3", "2"]
    sinks.write_answers(spark.createDataFrame([(2, 1), (1, 0)], "group_id long, z int"), str(tmp_path / "a"))
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == ["0", "1"]
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "s"), "x", {"k": 1}, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "12.jpg").write_bytes(b"\xff\xd8\xff\xd9")
    (tmp_path / "img" / "13.jpg").write_bytes(b"no")
    assert {r.item_id: r.content is not None for r in S.read_images(spark, str(tmp_path / "img")).collect()} == {"12": True, "13": False}


def test_scorer_precedence():
    s = pipeline.Settings
    assert s().scorer() == "weighted" and s(and_sim=True).scorer() == "and_sim"
    assert s(and_sim=True, model=True).scorer() == "model" and s(model=True, medium_band=True).scorer() == "two_band"
    assert s(text_pairs=True, model=True, medium_band=True).scorer() == "text_pairs"


def test_losses(spark):
    from pairweave.operators import models

    logits = [(r, c, 2.0 if r == c else 0.0) for r in range(3) for c in range(3)]
    want = math.log(math.exp(2) + 2) - 2
    assert models.info_nce(spark.createDataFrame(logits, "r int, c int, s double")).first().loss == pytest.approx(want)
