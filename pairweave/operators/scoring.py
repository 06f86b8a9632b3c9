"""Pair scorers, score reports, and the rewrites that follow them in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands, floors and rewrites of the scoring chain; all are parameters too.
HIGH, MEDIUM, MEDIUM_LEAST = 0.88, 0.70, 0.70
BOOST_LOW, BOOST_HIGH = 0.15, 0.30
RULE_PRICE, RULE_IMAGE, RULE_SCORE, RULE_RESULT = 0.88, 0.82, 0.30, 0.85
VETO = 0.30

# A fixed-coefficient logistic scorer over base features: a stand-in for a trained model that SQL can express.
LOGISTIC = {"text_cosine_sim": 4.0, "img_cosine_sim": 3.0, "price_ratio": 1.0, "dept_match": 0.5, "color_match": 0.25, "brand_match": 0.75}
LOGISTIC_BIAS = -2.5


def weighted(text_weight: float = 0.5) -> Column:
    return F.col("text_sim") * text_weight + F.col("img_sim") * (1 - text_weight)


def both_high() -> Column:
    """The smaller of the two similarities."""
    return F.least("text_sim", "img_sim")


def logistic(coefficients: dict[str, float] | None = None, bias: float = LOGISTIC_BIAS) -> Column:
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in (coefficients or LOGISTIC).items()]
    z = sum(terms[1:], terms[0]) + bias
    return 1 / (1 + F.exp(-z))


def two_band(sim: Column, high_score: Column, medium_score: Column, high: float = HIGH, medium: float = MEDIUM, least: float = MEDIUM_LEAST) -> Column:
    """high_score from the high band on, medium_score in the medium band if it is at least ``least``, else 0."""
    return F.when(sim >= high, high_score).when((sim >= medium) & (medium_score >= least), medium_score).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Word-set similarity of two texts, 0 where both are empty: the default text-pair scorer."""
    x, y = tokens(a), tokens(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def text_pair_scores(pairs: DataFrame, sim: str, floor: float, score: Column) -> DataFrame:
    """pairs with ce: the text-pair score from the floor on, 0 (not scored) below. The floor is applied before the scorer."""
    return pairs.withColumn("ce", F.when(F.col(sim) >= floor, score).otherwise(0.0))


def distribution(pairs: DataFrame, score: str, thresholds: tuple[float, ...]) -> DataFrame:
    """One row: mean, percentiles and counts at thresholds of a score."""
    names = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}
    q = F.percentile(score, F.array(*map(F.lit, names.values())))
    row = pairs.agg(F.avg(score).alias("mean"), q.alias("q"), *[F.count_if(F.col(score) >= t).alias(f"n_ge_{round(t * 100)}") for t in thresholds])
    return row.select("mean", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], *[f"n_ge_{round(t * 100)}" for t in thresholds])


# rewrites of the column score; features of the pair are at hand


def dept_filter(score: Column) -> Column:
    """0 where both departments are known and differ."""
    a, b = F.col("a_dept_id"), F.col("b_dept_id")
    return F.when((a != 0) & (b != 0) & (a != b), 0.0).otherwise(score)


def boost(score: Column, low: float = BOOST_LOW, high: float = BOOST_HIGH) -> Column:
    """Borderline scores of pairs that agree in brand, department and colour are lifted to the upper bound."""
    agree = (F.col("brand_match") == 1) & (F.col("dept_match") == 1) & (F.col("color_match") == 1)
    return F.when((score >= low) & (score < high) & agree, high).otherwise(score)


def override(score: Column, low: float = MEDIUM, high: float = HIGH, price: float = RULE_PRICE, image: float = RULE_IMAGE, least: float = RULE_SCORE, result: float = RULE_RESULT) -> Column:
    """Rejected medium-band pairs of one brand, department, price and look are promoted."""
    s = F.col("combined_sim")
    fits = (s >= low) & (s < high) & (F.col("brand_match") == 1) & (F.col("dept_match") == 1) & (F.col("price_ratio") >= price) & (F.col("img_cosine_sim") >= image)
    return F.when(fits & (score < least), result).otherwise(score)


def veto(pairs: DataFrame, text_scores: DataFrame, least: float = VETO) -> DataFrame:
    """pairs whose text score is above 0 and below ``least`` get score 0; joined by pair, 0 and missing mean not scored."""
    ce = text_scores.select("i", "j", F.col("ce").alias("_ce"))
    done = pairs.join(ce, ["i", "j"], "left")
    return done.withColumn("score", F.when((F.col("_ce") > 0) & (F.col("_ce") < least), 0.0).otherwise(F.col("score"))).drop("_ce")


def blend(first: DataFrame, second: DataFrame, weights: list[float]) -> DataFrame:
    """group_id, w, p: w parts of the first model's p and the rest of the second's, for a grid of weights."""
    both = first.select("group_id", F.col("p").alias("p1")).join(second.select("group_id", F.col("p").alias("p2")), "group_id")
    grid = both.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    return grid.select("group_id", "w", (F.col("w") * F.col("p1") + (1 - F.col("w")) * F.col("p2")).alias("p"))


def disagreements(first: DataFrame, second: DataFrame, t1: float, t2: float, most: int = 30) -> DataFrame:
    """The first groups on which two thresholded models differ; the limit is the report's."""
    both = first.select("group_id", F.col("p").alias("p1")).join(second.select("group_id", F.col("p").alias("p2")), "group_id")
    return both.where((F.col("p1") >= t1) != (F.col("p2") >= t2)).orderBy("group_id").limit(most)
