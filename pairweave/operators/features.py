"""Features of pairs and groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pairweave.functions.columns import abs_difference, array_mean, array_std, dot, match
from pairweave.operators.candidates import SIM_DIGITS
from pairweave.plans.scratch import Scratch

# Names and order of the base pair features and of the group features.
PAIR_FEATURES = [
    "text_cosine_sim", "img_cosine_sim", "text_l2_dist", "img_l2_dist", "text_diff_mean", "text_diff_std", "text_diff_max",
    "img_diff_mean", "img_diff_std", "img_diff_max", "text_prod_mean", "img_prod_mean", "combined_sim", "sim_diff",
    "price_ratio", "price_diff", "dept_match", "color_match", "brand_match", "total_matches",
]
GROUP_FEATURES = [
    "prob_max", "prob_2nd", "prob_3rd", "prob_mean", "prob_std", "prob_median", "prob_gap_1_2",
    "count_above_50", "count_above_70", "count_above_90", "text_sim_max", "text_sim_mean", "text_sim_std",
    "price_ratio_mean", "price_ratio_max", "dept_match_count", "color_match_count", "brand_match_count", "total_meta_matches",
    "n_unique_depts", "n_unique_colors", "prob_x_text_max", "prob_x_img_max", "prob_x_price_max", "prob_x_meta",
]
#: Columns of projected differences, PCA_DIMS numbers each: with the base features the wide set of 84.
PCA_DIMS, PCA_FEATURES = 32, ["text_pca_diff", "img_pca_diff"]
WIDE_FEATURES = [*PAIR_FEATURES, *PCA_FEATURES]
PRICE_EPSILON = 1e-5
#: Items in a block of `with_items_by_block`, blocks that one task meets, pairs that it gives at once, and lists of a block's pairs at most.
BLOCK, MET, AT_ONCE, LISTS = 4096, 32, 4096, 8


_SIDE = ("text_emb", "img_emb", "text_pca", "img_pca", "price", "dept_id", "color_id", "brand_id", "label", "title", "description")


def with_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with the items' columns under the prefixes a_ and b_; pairs of missing items are dropped."""
    cols = [c for c in _SIDE if c in items.columns]
    side = lambda key, p: items.select(F.col("item_id").alias(key), *[F.col(c).alias(p + c) for c in cols])
    return pairs.join(side("i", "a_"), "i").join(side("j", "b_"), "j")


def _columns(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as the columns of a matrix; a null vector has NaN."""
    known = np.asarray(vectors.is_valid())
    if len(pc.unique(pc.list_value_length(vectors.drop_null()))) > 1:
        raise ValueError("vectors differ in length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.full((max(1, len(flat) // max(1, known.sum())), len(vectors)), np.nan)
    out[:, known] = flat.reshape(known.sum(), -1).T if known.any() else np.nan
    return out


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, from left to right as in `dot`."""
    total = np.zeros(x.shape[1])
    for row in x:
        total += row
    return total


def _compared(m: str, a: np.ndarray, b: np.ndarray, every: bool) -> dict[str, np.ndarray]:
    """The features of pairs of vectors, columns of a and b, as `pair_features` has them; without every, the first alone."""
    cosine = _summed(a * b)
    if not every:
        return {f"{m}_cosine_sim": cosine}
    x = np.abs(a - b)
    mean = _summed(x) / len(x)
    std = np.sqrt(_summed((x - mean) * (x - mean)) / len(x))
    values = (cosine, np.sqrt(_summed(x * x)), mean, std, x.max(axis=0), cosine / len(x))
    return dict(zip((f"{m}_{c}" for c in ("cosine_sim", "l2_dist", "diff_mean", "diff_std", "diff_max", "prod_mean")), values, strict=True))


def with_items_by_block(pairs: DataFrame, items: DataFrame, every: bool = True) -> DataFrame:
    """The rows of `with_items` for many pairs of wide items, with the features of their vectors instead of the vectors.

    Items are packed in blocks, pairs in lists by the block of i. Every block with its
    pairs meets all blocks by a Cartesian product, which shuffles nothing, and a task looks
    up both sides of the pairs and compares their vectors; no vector comes out of it. Few
    blocks get several lists each, so all cores have work. Item ids are unique.
    """
    session, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "met")
    vectors = [c for c in ("text_emb", "img_emb", "text_pca", "img_pca") if c in items.columns and (every or c.endswith("_emb"))]
    plain = [c for c in _SIDE if c in items.columns and c not in ("text_emb", "img_emb", "text_pca", "img_pca")]
    cols = [*vectors, *plain]
    held = scratch.table(items.select("item_id", *cols))
    n, cores = max(1, -(-held.count() // BLOCK)), session.sparkContext.defaultParallelism
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    part = F.pmod(F.xxhash64("j", "i"), F.lit(min(LISTS, -(-2 * cores // n))))
    packed = scratch.table(held.groupBy(of("item_id").alias("b")).agg(F.collect_list(F.struct("item_id", *cols)).alias("x")))
    scratch.drop(held)
    lists = pairs.groupBy(of("i").alias("b"), part.alias("part")).agg(F.collect_list(F.struct(of("j").alias("to"), F.struct(*pairs.columns).alias("pair"))).alias("p"))
    left = scratch.table(packed.join(lists, "b").select(F.col("x").alias("a"), "p"))
    left = left.repartition(4 * cores)
    met = left.hint("shuffle_replicate_nl").crossJoin(packed.coalesce(-(-n // MET)))
    sides = [StructField(p + c, items.schema[c].dataType) for p in ("a_", "b_") for c in plain]
    probe = [k for c in vectors if c.endswith("_emb") for k in _compared(c[:-4], np.zeros((1, 0)), np.zeros((1, 0)), every)]
    found = [*[StructField(k, DoubleType()) for k in probe], *[StructField(f"{c}_diff", ArrayType(DoubleType())) for c in vectors if c.endswith("_pca")]]
    schema = StructType([*pairs.schema.fields, *sides, *found])
    shape, at_i, at_j = to_arrow_schema(schema), pairs.columns.index("i"), pairs.columns.index("j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, p, b, x = (batch.column(c)[row] for c in ("a", "p", "b", "x"))
                to, pair = p.values.flatten()
                pair = pair.filter(pc.equal(to, b)).flatten()
                (ai, *av), (bi, *bv) = a.values.flatten(), x.values.flatten()
                i, j = pc.index_in(pair[at_i], ai), pc.index_in(pair[at_j], bi)
                known = pc.and_(i.is_valid(), j.is_valid())
                pair, i, j = [z.filter(known) for z in pair], i.filter(known), j.filter(known)
                if not len(i):
                    continue
                at_a, at_b = ([_columns(v) for v in side[: len(vectors)]] for side in (av, bv))
                for at in range(0, len(i), AT_ONCE):
                    ki, kj = i.slice(at, AT_ONCE), j.slice(at, AT_ONCE)
                    here = [z.slice(at, AT_ONCE) for z in pair]
                    here += [v.take(k) for side, k in ((av, ki), (bv, kj)) for v in side[len(vectors) :]]
                    numbers, lists = [], []
                    ki, kj = ki.to_numpy(), kj.to_numpy()
                    for c, va, vb, xa, xb in zip(vectors, av, bv, at_a, at_b, strict=False):  # the plain columns follow
                        missing = ~(np.asarray(va.is_valid())[ki] & np.asarray(vb.is_valid())[kj])
                        xa, xb = xa[:, ki], xb[:, kj]
                        if c.endswith("_emb"):
                            numbers += [pa.array(z, mask=missing) for z in _compared(c[:-4], xa, xb, every).values()]
                        else:
                            x_ = np.abs(xa - xb)
                            ends = pa.array(np.arange(len(ki) + 1) * len(x_), pa.int32())
                            lists.append(pa.ListArray.from_arrays(ends, pa.array(x_.T.ravel()), mask=pa.array(missing)))
                    here += numbers + lists
                    yield pa.RecordBatch.from_arrays([z.cast(f.type) for z, f in zip(here, shape, strict=True)], schema=shape)

    return met.select("a", "p", "b", "x").mapInArrow(run, schema)


def similarities(pairs: DataFrame, items: DataFrame, by_block: bool = False) -> DataFrame:
    """pairs with text_sim, img_sim and combined; only the vectors are read."""
    read = items.select("item_id", "text_emb", "img_emb")
    if by_block:
        wide = with_items_by_block(pairs, read, every=False)
        t, v = (F.round(f"{m}_cosine_sim", SIM_DIGITS) for m in ("text", "img"))
    else:
        wide = with_items(pairs, read)
        t, v = (F.round(dot(F.col(f"a_{m}_emb"), F.col(f"b_{m}_emb")), SIM_DIGITS) for m in ("text", "img"))
    return wide.select(*pairs.columns, t.alias("text_sim"), v.alias("img_sim")).withColumn("combined", (F.col("text_sim") + F.col("img_sim")) / 2)


def pair_features(pairs: DataFrame, items: DataFrame, keep: tuple[str, ...] = (), by_block: bool = False) -> DataFrame:
    """pairs with the 20 base features. Vectors are taken as unit vectors; a null price gives null price features.

    Where items have the projections text_pca and img_pca, the 64 differences follow in
    two arrays: the wide set of 84.
    """
    if by_block:  # a function over rows hides from the planner which columns are read
        read = {"text_emb", "img_emb", "text_pca", "img_pca", "price", "dept_id", "color_id", "brand_id", *[c[2:] for c in keep]}
        w = with_items_by_block(pairs, items.select("item_id", *[c for c in items.columns if c in read]))
    else:
        w = with_items(pairs, items)
    for m in () if by_block else ("text", "img"):  # those of blocks come with their features
        a, b = F.col(f"a_{m}_emb"), F.col(f"b_{m}_emb")
        w = w.withColumn(f"{m}_cosine_sim", dot(a, b)).withColumn(f"_{m}_diff", abs_difference(a, b))
        w = w.withColumns({
            f"{m}_l2_dist": F.sqrt(dot(F.col(f"_{m}_diff"), F.col(f"_{m}_diff"))), f"{m}_diff_mean": array_mean(F.col(f"_{m}_diff")),
            f"{m}_diff_std": array_std(F.col(f"_{m}_diff")), f"{m}_diff_max": F.array_max(f"_{m}_diff"), f"{m}_prod_mean": F.col(f"{m}_cosine_sim") / F.size(a),
        })
    pa, pb = F.col("a_price"), F.col("b_price")
    both = pa.isNotNull() & pb.isNotNull()
    w = w.withColumns({
        "combined_sim": (F.col("text_cosine_sim") + F.col("img_cosine_sim")) / 2, "sim_diff": F.abs(F.col("text_cosine_sim") - F.col("img_cosine_sim")),
        "price_ratio": F.when(both, F.least(pa, pb) / (F.greatest(pa, pb) + PRICE_EPSILON)), "price_diff": F.abs(pa - pb),
        **{f"{c}_match": match(F.col(f"a_{c}_id"), F.col(f"b_{c}_id")) for c in ("dept", "color", "brand")},
    })
    w = w.withColumn("total_matches", F.col("dept_match") + F.col("color_match") + F.col("brand_match"))
    apart = lambda m: F.col(f"{m}_pca_diff") if by_block else abs_difference(F.col(f"a_{m}_pca"), F.col(f"b_{m}_pca")).alias(f"{m}_pca_diff")
    wide = [apart(m) for m in ("text", "img") if f"{m}_pca" in items.columns]
    return w.select(*pairs.columns, *PAIR_FEATURES, *wide, *keep)


def fit_pca(items: DataFrame, vector: str, dims: int = PCA_DIMS, fit_rows: int = 100_000) -> PCAModel:
    """PCA of a vector column fitted on at most fit_rows rows in hash order; persist the model and use one for all."""
    rows = items.orderBy(F.xxhash64("item_id", F.lit(42))).limit(fit_rows).select(array_to_vector(vector).alias("x"))
    return PCA(k=dims, inputCol="x", outputCol="y").fit(rows)


def explained_variance(spark: SparkSession, model: PCAModel) -> DataFrame:
    """component (from 1), share of the variance that it explains, and the running sum of the shares."""
    shares = [float(x) for x in model.explainedVariance.toArray()]
    rows = [(n + 1, x, sum(shares[: n + 1])) for n, x in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, explained double, total double")


def project(items: DataFrame, model: PCAModel, vector: str, out: str) -> DataFrame:
    """items with their projection; it is not centred, which cancels in differences."""
    done = model.transform(items.withColumn("x", array_to_vector(vector)))
    return done.withColumn(out, vector_to_array("y")).drop("x", "y")


def with_projections(items: DataFrame, dims: int = PCA_DIMS) -> DataFrame:
    """items with text_pca and img_pca by a PCA of each."""
    for vector, out in (("text_emb", "text_pca"), ("img_emb", "img_pca")):
        items = project(items, fit_pca(items, vector, dims), vector, out)
    return items


def group_features(groups: DataFrame, scored: DataFrame, items: DataFrame) -> DataFrame:
    """The 25 features of every group from its scored pairs (group_id, p and pair features).

    Groups without a pair have zeros in all of them. Unique departments and colours are
    counted over the group's items, so they are aggregated apart and joined back.
    """
    p = F.sort_array(F.collect_list("p"), asc=False)
    total = F.col("dept_match_count") + F.col("color_match_count") + F.col("brand_match_count")
    agg = scored.groupBy("group_id").agg(
        p.alias("ps"), F.avg("p").alias("prob_mean"), F.stddev_pop("p").alias("prob_std"), F.percentile("p", F.lit(0.5)).alias("prob_median"),
        *[F.count_if(F.col("p") >= t / 100).cast("double").alias(f"count_above_{t}") for t in (50, 70, 90)],
        F.max("text_cosine_sim").alias("text_sim_max"), F.avg("text_cosine_sim").alias("text_sim_mean"), F.stddev_pop("text_cosine_sim").alias("text_sim_std"),
        F.max("img_cosine_sim").alias("img_sim_max"), F.avg("price_ratio").alias("price_ratio_mean"), F.max("price_ratio").alias("price_ratio_max"),
        *[F.sum(f"{c}_match").alias(f"{c}_match_count") for c in ("dept", "color", "brand")],
    ).withColumns({f"prob_{n}": F.coalesce(F.get("ps", F.lit(i)), F.lit(0.0)) for i, n in enumerate(("max", "2nd", "3rd"))}).withColumn("total_meta_matches", total)
    members = groups.join(items.select("item_id", "dept_id", "color_id"), "item_id")
    unique = members.groupBy("group_id").agg(*[F.countDistinct(F.nullif(F.col(f"{c}_id"), F.lit(0))).cast("double").alias(f"n_unique_{c}s") for c in ("dept", "color")])
    agg = agg.join(unique, "group_id").withColumns({
        "prob_gap_1_2": F.col("prob_max") - F.col("prob_2nd"), "prob_x_text_max": F.col("prob_max") * F.col("text_sim_max"),
        "prob_x_img_max": F.col("prob_max") * F.col("img_sim_max"), "prob_x_price_max": F.col("prob_max") * F.col("price_ratio_max"),
        "prob_x_meta": F.col("prob_max") * F.col("total_meta_matches"),
    })
    every = groups.select("group_id").distinct()
    return every.join(agg, "group_id", "left").select("group_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in GROUP_FEATURES])
