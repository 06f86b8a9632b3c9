"""Common table expressions in DuckDB SQL that mirror the item adapter and the first pipeline stages."""

from __future__ import annotations

from pairweave.functions.columns import EURO_RATES
from pairweave.operators.scoring import LOGISTIC, LOGISTIC_BIAS

#: Neighbours of an item in the searches, and in mining.
K, MINING_K = 50, 100
_RATES = ", ".join(f"('{g}', {r}::DOUBLE)" for g, r in EURO_RATES.items())
_GEOS = ", ".join(f"'{g}'" for g in EURO_RATES)
_UNIT = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"

ITEMS = rf"""
rates(geo, rate) AS (VALUES {_RATES}),
cat AS (
  SELECT p_partkey, p_name AS title, p_retailprice, dense_rank() OVER (ORDER BY p_type) AS dept_code,
    dense_rank() OVER (ORDER BY split_part(p_name, ' ', 1)) AS color_code, CAST(regexp_extract(p_brand, '\d+') AS INTEGER) AS brand_code
  FROM part),
raw AS (
  SELECT vec_id, label, [{_GEOS}][vec_id % 13 + 1] AS geo,
    list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS t, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings),
items AS (
  SELECT vec_id AS item_id, title, d.text AS description, raw.geo, p_retailprice * rate AS price,
    CAST(CASE WHEN vec_id % 11 = 0 THEN 0 ELSE dept_code END AS INTEGER) AS dept_id,
    CAST(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE color_code END AS INTEGER) AS color_id,
    CAST(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE brand_code END AS INTEGER) AS brand_id,
    {_UNIT.format("t")} AS text_emb, {_UNIT.format("v")} AS img_emb, CAST(label AS BIGINT) AS label
  FROM raw JOIN cat ON p_partkey = vec_id % (SELECT count(*) FROM part) LEFT JOIN documents d ON d.doc_id = vec_id % (SELECT count(*) FROM documents) JOIN rates ON rates.geo = raw.geo)"""


def near(name: str, vector: str, k: int) -> str:
    """i, j, sim of the k nearest others of every item."""
    return f"""
{name} AS (
  SELECT i, j, sim FROM (
    SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM (
      SELECT a.item_id AS i, b.item_id AS j, round(list_dot_product(a.{vector}, b.{vector}), 10) AS sim FROM items a, items b))
  WHERE rn <= {k + 1} AND i <> j)"""


PAIRS = (
    near("tnn", "text_emb", K) + "," + near("vnn", "img_emb", K) + """,
pairs AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT i, j FROM tnn UNION ALL SELECT i, j FROM vnn)),
sims AS (
  SELECT i, j, t AS text_sim, v AS img_sim, (t + v) / 2 AS combined FROM (
    SELECT i, j, round(list_dot_product(a.text_emb, b.text_emb), 10) AS t, round(list_dot_product(a.img_emb, b.img_emb), 10) AS v
    FROM pairs JOIN items a ON a.item_id = i JOIN items b ON b.item_id = j))"""
)
_DIFF = "list_transform(list_zip(a.{0}_emb, b.{0}_emb), lambda z: abs(z[1] - z[2]))"


def features(name: str, pairs: str, extra: str = "") -> str:
    """The 20 base features of a table of pairs, with extra columns of it."""
    side = lambda m: f"""list_dot_product(a.{m}_emb, b.{m}_emb) AS {m}_cosine_sim, {_DIFF.format(m)} AS {m}_d"""
    stats = lambda m: f"""sqrt(list_dot_product({m}_d, {m}_d)) AS {m}_l2_dist, list_avg({m}_d) AS {m}_diff_mean, list_stddev_pop({m}_d) AS {m}_diff_std,
      list_max({m}_d) AS {m}_diff_max, {m}_cosine_sim / 32 AS {m}_prod_mean"""  # noqa: E731
    match = lambda c: f"CAST(a.{c}_id = b.{c}_id AND a.{c}_id <> 0 AS INTEGER)::DOUBLE AS {c}_match"
    return f"""
{name} AS (
  SELECT *, {stats("text")}, {stats("img")}, (text_cosine_sim + img_cosine_sim) / 2 AS combined_sim, abs(text_cosine_sim - img_cosine_sim) AS sim_diff,
    dept_match + color_match + brand_match AS total_matches
  FROM (
    SELECT p.i, p.j, {extra} {side("text")}, {side("img")}, least(a.price, b.price) / (greatest(a.price, b.price) + 1e-5::DOUBLE) AS price_ratio, abs(a.price - b.price) AS price_diff,
      {match("dept")}, {match("color")}, {match("brand")}, a.dept_id AS a_dept_id, b.dept_id AS b_dept_id
    FROM {pairs} p JOIN items a ON a.item_id = p.i JOIN items b ON b.item_id = p.j))"""


LOGIT = "1 / (1 + exp(-(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in LOGISTIC.items()) + f" + ({LOGISTIC_BIAS}::DOUBLE))))"
GROUPS = "\ngroups AS (SELECT vec_id // 5 AS group_id, CAST(vec_id % 5 AS INTEGER) AS pos, vec_id AS item_id FROM embeddings)"
GROUP_PAIRS = GROUPS + """,
gpairs AS (SELECT a.group_id, a.item_id AS i, b.item_id AS j FROM groups a JOIN groups b ON a.group_id = b.group_id AND a.pos < b.pos)"""


def components(name: str, edges: str) -> str:
    """item_id, cluster_id by a recursive closure over a table of edges (i, j)."""
    return f"""
{name}_both AS (SELECT i AS u, j AS w FROM {edges} UNION ALL SELECT j, i FROM {edges}),
{name}_reach(n, r) AS (
  SELECT item_id, item_id FROM items
  UNION
  SELECT w, r FROM {name}_reach JOIN {name}_both ON u = n WHERE r < w),
{name} AS (SELECT n AS item_id, min(r) AS cluster_id FROM {name}_reach GROUP BY n)"""


def f1(clusters: str) -> str:
    """tp, fp, fn, precision, recall, f1 of clusters against the items' labels."""
    return f"""
c AS (SELECT item_id, cluster_id, label FROM {clusters} JOIN items USING (item_id) WHERE label IS NOT NULL),
n AS (SELECT
  CAST((SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM (SELECT count(*) AS k FROM c GROUP BY cluster_id, label)) AS BIGINT) AS tp,
  CAST((SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM (SELECT count(*) AS k FROM c GROUP BY cluster_id)) AS BIGINT) AS pred,
  CAST((SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM (SELECT count(*) AS k FROM c GROUP BY label)) AS BIGINT) AS truth),
m AS (SELECT tp, pred - tp AS fp, truth - tp AS fn, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS precision, CASE WHEN truth > 0 THEN tp / truth ELSE 0 END AS recall FROM n),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


def statement(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n" + body


def rounded(columns: list[str] | tuple[str, ...]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def hashed(*keys: str, seed: str = "42") -> str:
    """The md5 order key of `functions.columns.in_hash_order`."""
    return "md5(" + " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + ")"
