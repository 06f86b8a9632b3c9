"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Method. Each document is the set of its distinct k-word shingles. The sketch has t
coordinates filled by rounds of hashed bin placement (fast similarity sketching): in
round i < t every element falls into one hashed bin with the value i plus a hash; in
round t + b every element falls into bin b, so every coordinate is filled for any
non-empty set, while large sets stop after one or two rounds. Two coordinates agree with
probability equal to the Jaccard similarity. Bands of ``rows`` coordinates become bucket
keys.

Work per bucket stays linear. Documents with equal sets are one class, represented by
the smallest id. In every bucket all members are checked against the smallest and the
largest member only; what that connects is contracted. The members of
buckets which still hold several components are compared across components by what sets
them apart from the head of the bucket's largest component, which leaves out no link between them and,
unlike the bucket, does not pair what merely resembles. Copies are never expanded into pairs. Every link is confirmed
on the full sets with exact integers.

At similarity 0.8 the chance that a pair shares none of 40 bands of 6 rows is 5e-6.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.arrow import map_rows
from pairweave.llm.hashing import U64, mix, salts, shingles
from pairweave.operators.graph import connected_components
from pairweave.plans.scratch import Scratch

BANDS, ROWS, SEED = 40, 6, 7
#: Bits of the bitmap of candidate ids for each of them, at least for each, and in all at
#: most. Its rows hold 64 bits each: 1,048,576 rows (12 MB) at most are broadcast. More ids
#: than the largest bitmap serves are joined with the documents instead.
BITS_PER_ID, LEAST_BITS_PER_ID, MOST_BITS = 64, 8, 1 << 26
#: Groups that hold more than one in so many rows are broadcast: there are fewer than that.
HOT_GROUPS = 1000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_similarity_sketch(elements: np.ndarray, t: int, seed: int = SEED) -> np.ndarray:
    """t coordinates of a set of distinct uint64 hashes; all filled unless the set is empty."""
    out = np.full(t, _EMPTY)
    n = len(elements)
    if not n:
        return out
    salt = salts(2 * t, seed)
    low = U64((1 << 40) - 1)
    block = max(1, min(t, 4096 // n))
    for first in range(0, t, block):
        rounds = np.arange(first, min(first + block, t))
        h = mix(elements[None, :] ^ salt[rounds][:, None])
        bins = ((h >> U64(40)) * U64(t)) >> U64(24)
        values = (rounds.astype(U64) << U64(40))[:, None] | (h & low)
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        if out.max() != _EMPTY:
            return out
    for b in np.flatnonzero(out == _EMPTY):
        h = mix(elements ^ salt[t + b])
        out[b] = (U64(t + b) << U64(40)) | (h & low).min()
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 bucket key for each band; the band's number is part of the key."""
    parts = sketch.reshape(bands, rows)
    key = salts(bands, 3)
    for j in range(rows):
        key = mix(key * U64(0xD6E8FEB86659FD93) + parts[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (hex digest of the set, null if empty), bands (bucket keys)."""

    def make():
        def run(texts):
            n, keys, found = [], [], []
            for text in texts:
                s = shingles(text, k)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                found.append(band_keys(fast_similarity_sketch(s, bands * rows), bands, rows) if len(s) else None)
            return [n, keys, found]

        return run

    return map_rows(docs.select("doc_id", "text"), make, "n_shingles long, set_key string, bands array<long>", keep=1)


def _bit(key: str, bits: int) -> tuple:
    h = f"pmod(xxhash64({key}), {bits})"
    return F.expr(f"cast(shiftright({h}, 6) as int)"), F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingle sets of (at least) the documents named in the table ids.

    A bitmap in proportion to their number leaves the texts where they are and lets few of
    the other documents through (at its bound one in eight); beyond it ids and documents
    meet in a join. What is not asked for falls out of the joins that follow.
    """
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    n = ids.count()
    if n * LEAST_BITS_PER_ID <= MOST_BITS:
        bits = min(MOST_BITS, max(1 << 12, 1 << (n * BITS_PER_ID).bit_length()))
        word, bit = _bit("id", bits)
        bitmap = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))
        word, bit = _bit("doc_id", bits)
        hit = known.withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("mask").bitwiseAND(bit) != 0).select("doc_id", "text")
    else:
        hit = known.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")

    def make():
        return lambda texts: [[shingles(x, k).view(np.int64) for x in texts]]

    return map_rows(hit, make, "items array<long>", keep=1)


def _apart_pairs(docs: DataFrame, open_: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Every pair (a, b) of different parts that shares a pivot in open_ (rep, pivot, part) and can be a link.

    Each set x is seen as its pivot p without D = p - x and with A = x - p. For a link the
    symmetric difference |Ax| + |Dx| + |Ay| + |Dy| - 2 c, where c counts the elements that
    both A and both D share, is at most (100 - percent) / (100 + percent) * (|x| + |y|).
    If that needs a larger c than the smaller D gives, the pair shares an element of A and
    is found by it; else if it needs more than the smaller A gives, by an element of D; only
    pairs that fulfil neither are found by the pivot itself. This leaves out no link.
    """
    ids = scratch.table(open_.select(F.explode(F.array("rep", "pivot")).alias("id")).distinct())
    sets = scratch.table(_sets(docs, ids, k))
    scratch.drop(ids)
    deltas = scratch.table(
        open_.join(sets.select(F.col("doc_id").alias("rep"), F.col("items").alias("x")), "rep")
        .join(sets.select(F.col("doc_id").alias("pivot"), F.col("items").alias("p")), "pivot")
        .select("pivot", "rep", "part", F.size("x").alias("n"), F.array_except("x", "p").alias("plus"), F.array_except("p", "x").alias("minus"))
        .withColumns({"na": F.size("plus"), "nd": F.size("minus")})
    )
    scratch.drop(sets)
    fits = f"l.part < r.part and 100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
    needs = f"{100 + percent}L * (l.na + l.nd + r.na + r.nd) - {100 - percent}L * (l.n + r.n)"
    by_plus = f"{needs} > {2 * (100 + percent)}L * least(l.nd, r.nd)"
    by_minus = f"{needs} > {2 * (100 + percent)}L * least(l.na, r.na)"

    def met(rows: DataFrame, keys: list[str], when: str) -> DataFrame:
        on = " and ".join(f"l.{c} = r.{c}" for c in keys)
        found = rows.alias("l").join(rows.alias("r"), F.expr(f"{on} and {fits} and {when}"))
        return found.select(F.expr("least(l.rep, r.rep)").alias("a"), F.expr("greatest(l.rep, r.rep)").alias("b"))

    sizes = ["pivot", "rep", "part", "n", "na", "nd"]
    plus, minus = (deltas.select(*sizes, F.explode(c).alias("e")) for c in ("plus", "minus"))
    found = scratch.table(
        met(plus, ["pivot", "e"], by_plus)
        .union(met(minus, ["pivot", "e"], f"not ({by_plus}) and {by_minus}"))
        .union(met(deltas.select(*sizes), ["pivot"], f"not ({by_plus}) and not ({by_minus})"))
        .distinct()
    )
    scratch.drop(deltas)
    return found


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union on the full sets.

    Both joins are sort-merge joins on a document id; a popular partner repeats on one
    side only, which adaptive execution splits.
    """
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = scratch.table(_sets(docs, ids, k))
    scratch.drop(ids)
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
        .where(F.size("x") > 0)
        .join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        .where((100 * F.least(F.size("x"), F.size("y")) >= percent * F.greatest(F.size("x"), F.size("y"))) & (F.size("y") > 0))
        .select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    )
    links = scratch.table(both.where(100 * F.col("c") >= percent * (F.col("m") + F.col("n") - F.col("c"))).select("a", "b").distinct())
    scratch.drop(sets)
    return links


def _with_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups, one row a key with the number n of its rows; total: all rows.

    Groups with more than a thousandth of all rows are fewer than HOT_GROUPS, so they are
    broadcast and their rows stay where they are; the others meet in a shuffle in which no
    key has more than that share.
    """
    hot = F.broadcast(groups.where(F.col("n") * HOT_GROUPS > total).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col("n") * HOT_GROUPS <= total).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of docs.

    component_id is the smallest doc_id that links reach, itself included; kept marks it.

    Nulls and edges. A null or empty text, or one without words, has no shingles and links
    with nothing. A row with a null doc_id is never linked: its component_id is null and
    it is kept. Rows that repeat an id get the class of their own text; a repeated row
    links with its twin. Texts are read whole, whatever their length. An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    found = scratch.table(sketches(docs, k, bands, rows))
    full = found.where(F.col("n_shingles") > 0).where(F.col("doc_id").isNotNull())
    classes = scratch.table(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    n_rows, n_classes = full.count(), classes.count()
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = scratch.table(_with_groups(members, hubs, "bucket", n_classes * bands))
    near = (
        shared.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("hi").alias("b")))).alias("p"))
        .select("p.*").where("a < b").distinct()
    )
    near = scratch.table(near)
    links = _confirmed(docs, near, k, percent, scratch)
    parts = scratch.table(connected_components(links, "a", "b"))

    named = shared.select("bucket", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
    sizes = named.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.expr("max_by(part, struct(n, -part))").alias("pivot"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).where("parts > 1").drop("parts")
    open_ = scratch.table(_with_groups(named, mixed, "bucket", n_classes * bands).select("rep", "pivot", "part").distinct())
    apart = _apart_pairs(docs, open_, k, percent, scratch)
    across = scratch.table(apart.join(near, ["a", "b"], "left_anti"))
    more = _confirmed(docs, across, k, percent, scratch)
    if not more.isEmpty():
        first, parts = parts, scratch.table(connected_components(links.union(more), "a", "b"))
        scratch.drop(first)
    scratch.drop(shared, near, links, open_, apart, across, more)

    # a class joins its many rows by the digest; its component comes with it
    head = classes.select("set_key", "rep", "n").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), "n")
    head = scratch.table(head)
    scratch.drop(classes)
    linked = _with_groups(full.select("set_key", "doc_id", "n_shingles"), head, "set_key", n_rows).select("doc_id", "n_shingles", "component_id")
    alone = found.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs which are the first of their group, each once, with all columns.

    Rows that repeat an id and its text are reduced to one; rows with a null id all stay,
    and so does every other row without words. Other columns may have any names.
    """
    d = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # by number, so no name clashes
    rows, (i, t) = docs.toDF(*names), (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    kept = rows.where(F.col(i).isNotNull()).join(d, F.col(i) == F.col("_kept"), "left_semi")
    return kept.dropDuplicates([i, t]).union(rows.where(F.col(i).isNull())).toDF(*docs.columns)
