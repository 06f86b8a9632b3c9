"""Queries against brute force over whole tables: nothing is left out as tables grow."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairweave.operators import candidates, features, mining, models
from pairweave.plans import pipeline
from pairweave.plans import queries_training as Q
from pairweave.sources import items as S


def tfidf_brute(texts, least):
    """{(i, j): sim} over all pairs of {id: text}."""
    counts = {d: Counter(int(hashlib.md5(w.encode()).hexdigest()[:3], 16) for w in re.findall(r"[^\W_]+", t.lower())) for d, t in texts.items()}
    df = Counter(b for c in counts.values() for b in c)
    w = {d: {b: n * (math.log((len(texts) + 1) / (df[b] + 1)) + 1) for b, n in c.items()} for d, c in counts.items() if c}
    size = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in w.items()}
    sims = {(i, j): sum(x * w[j].get(b, 0.0) for b, x in w[i].items()) / size[i] / size[j] for i in w for j in w if i < j}
    return {k: s for k, s in sims.items() if round(s, 8) >= least}


def test_tfidf_pairs_of_common_words_only(spark):
    words = [f"w{i}" for i in range(12)]
    texts = {d: " ".join(words[(d * k) % 12] for k in range(1, 2 + d % 7)) for d in range(210)} | {210: "", 211: "w1 w1 w2", 212: "w2 w1 w1"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = tfidf_brute(texts, 0.5)
    for block in (2048, 16):
        got = models.tfidf_pairs(docs, "text", "doc_id", 0.5, block=block).collect()
        assert len(got) == len({(r.i, r.j) for r in got}) and {(r.i, r.j) for r in got} == set(want)
        assert all(abs(r.sim - want[r.i, r.j]) < 1e-7 for r in got)
    assert (211, 212) in want and min(Counter(w for t in texts.values() for w in set(t.split())).values()) > 20


def test_miners_return_all_rows_below_the_reference_caps(spark, sf):
    q = {n: entry.queries()[n](spark, sf) for n in ("m2_same_dept_negatives", "m3_random_negatives", "m4_high_band", "m5_medium_band", "m10_warmup_pairs")}
    label = {r.item_id: r.label for r in S.items(spark, sf).collect()}
    scored = [(r.combined, r.i, r.j, int(label[r.i] == label[r.j])) for r in Q.near_scored(spark, sf).collect()]
    high = {x[1:] for x in scored if x[0] >= Q.HIGH}
    medium = {x[1:] for x in scored if Q.MEDIUM <= x[0] < Q.HIGH}
    for name, band, ratio in (("m4_high_band", high, 3), ("m5_medium_band", medium, 99)):
        got = {(r.i, r.j, r.y) for r in q[name].collect()}
        pos = {x for x in band if x[2]}
        assert got <= band and {x for x in got if x[2]} == pos and len(got) == len(pos) + min(len(band) - len(pos), ratio * len(pos))
    assert {label[r.i] for r in q["m10_warmup_pairs"].collect()} == set(label.values())
    half = mining.positives(S.items(spark, sf)).count() // 2
    assert q["m2_same_dept_negatives"].count() == q["m3_random_negatives"].count() == half
    groups = entry.queries()["m9_mined_groups"](spark, sf).groupBy("kind").agg({"group_id": "count"}).collect()
    assert sum(r[1] for r in groups if r[0] == "pos") > 40 * 5


def test_losses_average_over_all_batches(spark, sf):
    rows = sorted((r.vec_id, [float(x) for x in r.embedding]) for r in S.table(spark, sf, "embeddings").select("vec_id", "embedding").collect())
    batches = {}
    for i, v in rows:
        batches.setdefault(i // 64, []).append(v)
    assert len(batches) > 1

    def loss(s):
        return sum(max(x) + math.log(sum(math.exp(y - max(x)) for y in x)) - x[k] for k, x in enumerate(s)) / len(s)

    both, hard = [], []
    for vs in batches.values():
        s = [[sum(x * y for x, y in zip(a[:32], b[32:64])) / 0.05 for b in vs] for a in vs]
        hard.append(loss(s))
        both.append((loss(s) + loss(list(zip(*s)))) / 2)
    for name, want in (("t4_info_nce", both), ("t5_info_nce_hard", hard)):
        assert abs(entry.queries()[name](spark, sf).first().loss - sum(want) / len(want)) < 1e-5


def shuffled(spark, df):
    """Rows of df and the bytes that its plan wrote to shuffles."""

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    rows = df().collect()
    return rows, so_far() - before


def unit_vectors(spark, n, dims, seed=5):
    rng = random.Random(seed)
    data = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(n)]
    data = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(data, "item_id long, v array<double>")


def test_search_by_cells_shuffles_no_copies(spark):
    _, df = unit_vectors(spark, 3000, 32)
    got, size = shuffled(spark, lambda: candidates.topk_cells(df, "v", 20, cells=50, probes=40, block=256))
    assert len(got) == len({(r.i, r.j) for r in got}) == 3000 * 20
    assert size < 10 * 3000 * 32 * 8  # fitting the cells included; with every vector once a cell it was 51 times the input


def test_search_by_cells_in_several_shares(spark, monkeypatch):
    _, df = unit_vectors(spark, 400, 8)
    rows = lambda: sorted(map(tuple, candidates.topk_cells(df, "v", 5, cells=9, probes=4, block=32).collect()))
    whole = rows()
    monkeypatch.setattr(candidates, "SHARE", 400 * 8 * 8 // 3)
    assert rows() == whole


def test_lsh_pairs_shuffle_no_pairs(spark):
    """Every pair that shares a bucket in any of the tables, from blocks, without shuffling candidates with their vectors."""
    data, df = unit_vectors(spark, 700, 8)
    df = df.union(spark.createDataFrame([(1000 + i, data[0][1]) for i in range(40)] + [(2000, None)], df.schema)).persist()
    x = df.where("v is not null").select("item_id", array_to_vector("v").alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=1.0, numHashTables=4, seed=42).fit(x)
    want = model.approxSimilarityJoin(x, x, 0.8, "d").where("datasetA.item_id < datasetB.item_id")
    want = {(r.i, r.j) for r in want.select(F.col("datasetA.item_id").alias("i"), F.col("datasetB.item_id").alias("j")).collect()}
    for block in (64, 8192):
        got, size = shuffled(spark, lambda: candidates.lsh_pairs(df, "v", 0.8, block=block))  # noqa: B023
        assert len(got) == len({(r.i, r.j) for r in got}) and {(r.i, r.j) for r in got} == want
    assert size < 20 * 740 * 8 * 8


def test_tfidf_pairs_shuffle_no_pairs(spark, monkeypatch):
    """Pairs, those of copies too, come out of the blocks that find them."""
    texts = {d: "the cat sat on a mat " * 4 + f"w{d % 300}" for d in range(900)} | {900 + d: f"w{d} x{d}" for d in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).persist()
    want = tfidf_brute(texts, 0.5)
    monkeypatch.setattr(models, "_PAIRS", 1000, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got, size = shuffled(spark, lambda: models.tfidf_pairs(docs, "text", "doc_id", 0.5, block=128))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(got) == len({(r.i, r.j) for r in got}) and {(r.i, r.j) for r in got} == set(want)
    assert len(got) > 300_000 and size < len(got)


def test_pair_features_by_block_shuffle_no_vectors(spark, sf, monkeypatch):
    """The same rows as by joins, where pairs are many more than items."""
    items = S.items(spark, sf).persist()
    pairs = items.select(F.col("item_id").alias("i")).crossJoin(items.select(F.col("item_id").alias("j"))).where("i < j and j < i + 100").persist()
    pairs = pairs.union(spark.createDataFrame([(0, 10**6), (10**6, 0)], pairs.schema))
    monkeypatch.setattr(features, "BLOCK", 130)
    want = features.pair_features(pairs, items, ("a_label",)).collect()
    got, size = shuffled(spark, lambda: features.pair_features(pairs, items, ("a_label",), by_block=True))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 40_000
    assert size < 60 * len(got)  # a pair's vectors are 512 bytes a side


def test_vectors_are_compared_where_their_blocks_meet(spark, sf, monkeypatch):
    """The wide features by blocks are those by joins, of null vectors too, and no vector leaves the function over blocks."""
    known = S.items(spark, sf).where("item_id < 150")
    turned = lambda c: F.transform(F.slice(c, 1, 5), lambda x: x * 3 - 1)
    items = known.withColumn("text_emb", F.when(F.col("item_id") != 7, F.col("text_emb"))).withColumn("img_pca", F.when(F.col("item_id") != 8, turned("img_emb")))
    items = items.withColumn("text_pca", turned("text_emb")).persist()
    pairs = items.select(F.col("item_id").alias("i")).crossJoin(items.select(F.col("item_id").alias("j"))).where("i < j").withColumn("more", F.lit("x")).persist()
    monkeypatch.setattr(features, "BLOCK", 40)
    rows = lambda df: sorted((tuple(map(repr, r)) for r in df.collect()))
    want = features.pair_features(pairs, items, ("a_label",))
    assert rows(features.pair_features(pairs, items, ("a_label",), by_block=True)) == rows(want) and want.count() == 150 * 149 // 2
    assert rows(features.similarities(pairs, items, True)) == rows(features.similarities(pairs, items))
    out = features.with_items_by_block(pairs, items)
    assert not {p + c for p in ("a_", "b_") for c in ("text_emb", "img_emb", "text_pca", "img_pca")} & set(out.columns)


def test_models_are_trained_and_used_on_one_search(spark, sf, monkeypatch):
    calls = []
    search = pipeline.candidate_pairs
    monkeypatch.setattr(pipeline, "candidate_pairs", lambda *a: calls.append(a) or search(*a))
    rows = entry.queries()["pipeline_grouping_models"](spark, sf).collect()
    assert len(calls) == 1 and sorted(r.item_id for r in rows) == sorted(r.item_id for r in S.items(spark, sf).collect())
