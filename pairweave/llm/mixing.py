"""Mixing sources to target weights along a time-varying curriculum, without Python on the rows.

Sizes are word counts. Sources share a total (a percentage of all words) by weight; a
target stops at a multiple of its source's size and the excess is reshared by weight
until none is above, which is solved in closed form by one pass over the sources in the
order of size over weight.

Every source is read in one seeded order of its documents, again and again until its
target is reached. Where a document stands in that order needs a running sum of sizes
within its source; it is taken over the digits of the hashed order key, level by level,
so that a source with a third of all rows never meets in one task.

The curriculum gives source i the weight density r_i(t) = target_i * (1 + s_i * (2t - 1))
at training time t in [0, 1]: s_i runs from -SLOPE for the first source to +SLOPE for the
last. Its integral D_i(t) = target_i * ((1 - s_i) * t + s_i * t^2) is the demand met by
time t; inverting it at the words of its source that come before a document gives the
document's training position. The result is range-sorted by position.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairweave.plans.scratch import Scratch

# Fixed values of the task: weights in the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST_TIMES = 150, 2
SLOPE = 0.5
SEED = "mix"
_WORD = r"[^\\x20\\x09-\\x0D]+"
#: Hexadecimal digits of the order key in each level of the running sum.
_DIGITS = (3, 3)


def word_count(text: str = "text") -> Column:
    return F.expr(f"cast(coalesce(regexp_count({text}, '{_WORD}'), 0) as bigint)")


def targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rank from (source, source_size), one row a source.

    Sources stand in the order of their code points, null last; the windows run over this
    one-row-a-source table only.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    every = W.partitionBy()
    # sources fill up in the order of limit over weight; the first k are full iff the level of the rest lifts them over
    filled = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    p = (
        ranked.withColumn("_total", F.sum("source_size").over(every)).withColumn("_w", F.sum("weight").over(every))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("_wfull", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    level = F.expr(f"(({share_percent}D / 100D) * _total - {most}D * _full) / (_w - _wfull)")
    p = p.withColumn("_level", level).withColumn("_under", F.expr(f"{most}D * source_size > weight * _level"))
    first = F.min(F.when(F.col("_under"), F.struct(F.expr("source_size / weight"), "rank", "_level"))).over(every)
    return p.withColumn("_at", first).select(
        "source", "source_size", "rank",
        F.expr(f"case when _at is null then {most}D * source_size else least({most}D * source_size, weight * _at._level) end").alias("target"),
    )


def mixed(docs: DataFrame, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row of docs, sorted by position.

    taken counts the words that the mix takes of the document: its size for every whole
    reading of the source, and what the last reading reaches; at most ``most`` times its
    size. Each source's taken words add up to its target, rounded.

    A null text has size 0; a null source is a source of its own, the last. A null doc_id
    orders as an empty id. Rows that repeat an id are ordered by their size, and rows
    equal in both share the words of their place evenly in turn. Documents without words
    and documents that nothing is taken of have a null position and come last. An empty
    table gives an empty result. Texts are counted whole, whatever their length. Other
    columns, whatever their names, are not read.
    """
    # the texts are read once; all else goes by ids, sources and sizes
    sized = Scratch(docs.sparkSession, "mixing").table(docs.select("doc_id", "source", word_count().alias("size")))
    placed = _placed(sized, share_percent, most, weights, seed)
    return _in_order(placed.withColumn("position", _position("_start"))).select("doc_id", "size", "source_size", "target", "taken", "position")


def _placed(sized: DataFrame, share_percent: int, most: int, weights: tuple[int, ...], seed: str) -> DataFrame:
    """The columns of sized (doc_id, source, size, ...) with the mix's decision for each row."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sized.withColumn("_key", key)
    cut, levels = 1, []
    for i, n in enumerate(_DIGITS):
        rows = rows.withColumn(f"_l{i}", F.substring("_key", cut, n))
        levels.append(f"_l{i}")
        cut += n
    rows = rows.withColumn("_src", F.struct("source"))  # a struct compares null sources as equal
    # words of each cell, and of all cells before it among those that share its prefix
    cells = rows.groupBy("_src", *levels).agg(F.sum("size").alias("_n"))
    table, upto = cells, None
    parts = []
    for i in range(len(levels), 0, -1):
        prefix = ["_src", *levels[: i - 1]]
        window = W.partitionBy(*prefix).orderBy(levels[i - 1]).rowsBetween(W.unboundedPreceding, -1)
        parts.append(table.withColumn(f"_b{i}", F.coalesce(F.sum("_n").over(window), F.lit(0))).drop("_n"))
        table = table.groupBy(*prefix).agg(F.sum("_n").alias("_n"))
    aims = targets(table.select("_src.source", F.col("_n").alias("source_size")), share_percent, most, weights)
    last = F.max("rank").over(W.partitionBy())
    slope = F.when(last > 1, SLOPE * (2 * (F.col("rank") - 1) / (last - 1) - 1)).otherwise(F.lit(0.0))
    aims = aims.select(F.struct("source").alias("_src"), "source_size", "target", slope.alias("_s"))
    for p in reversed(parts):
        on = [c for c in p.columns if c == "_src" or c in levels]
        upto = p if upto is None else upto.join(p, [c for c in on if c in upto.columns])
    upto = upto.join(aims, "_src")
    total = sum((F.col(f"_b{i}") for i in range(2, len(levels) + 1)), F.col("_b1"))
    within = W.partitionBy("_src", *levels).orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(upto.withColumn("_before", total), ["_src", *levels])
    start = placed.withColumn("_start", F.col("_before") + F.col("_own")).withColumn("_goal", F.round("target").cast("bigint"))
    start = start.withColumn("_rounds", F.expr("case when source_size > 0 then _goal div source_size else 0L end"))
    start = start.withColumn("taken", F.expr("size * _rounds + greatest(0L, least(size, _goal - _rounds * source_size - _start))"))
    return start


def _position(words_before: str) -> Column:
    """The time t at which the demand of a source reaches the words before: s t^2 + (1 - s) t = words / target."""
    u = f"(({words_before}) / target)"
    t = f"case when _s = 0 then {u} else (sqrt((1 - _s) * (1 - _s) + 4 * _s * {u}) - (1 - _s)) / (2 * _s) end"
    return F.expr(f"case when taken > 0 then least(1D, greatest(0D, {t})) end")


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mix_documents(docs: DataFrame, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs in training order, with the columns of docs.

    A document comes once for every whole time it is taken. The one document of a source
    at which its last reading ends comes once more with the words that are taken, joined
    by spaces, and their length in n_chars, if docs has that column. Written as Parquet,
    the names of the files and the rows in each keep the order (`training_order`). Edges
    as in `mixed`; rows equal in doc_id, source and size share their words evenly, rounded
    down.
    """
    sized = Scratch(docs.sparkSession, "mixing").table(docs.select("doc_id", "source", word_count().alias("size")))
    name = {c: f"_pw_{c}" for c in ("doc_id", "source", "size")}
    plan = (
        _placed(sized, share_percent, most, weights, seed).groupBy("doc_id", "source", "size")
        .agg(F.expr("sum(taken) div count(1)").alias("taken"), *(F.min(c).alias(c) for c in ("_start", "source_size", "target", "_s")))
        .where("taken > 0").withColumnsRenamed(name)
    )
    # the columns of docs go by number meanwhile, so none can clash with the plan's
    names = docs.columns
    own = {c: f"_pw_c{i}" for i, c in enumerate(names)}
    rows = docs.toDF(*own.values())
    rows = rows.withColumn("_pw_words", word_count(own["text"]))
    same = rows[own["doc_id"]].eqNullSafe(plan["_pw_doc_id"]) & rows[own["source"]].eqNullSafe(plan["_pw_source"]) & (rows["_pw_words"] == plan["_pw_size"])
    copies = rows.join(plan, same).withColumn("_pw_copy", F.explode(F.expr("sequence(0L, (taken - 1) div _pw_size)")))
    copies = copies.withColumn("_pw_part", F.expr("least(_pw_size, taken - _pw_copy * _pw_size)")).withColumn("position", _position("_pw_copy * source_size + _start"))
    out = _in_order(copies.withColumn("doc_id", F.col(own["doc_id"])))
    cut = F.expr("_pw_part < _pw_size")
    part = F.expr(f"array_join(slice(regexp_extract_all({own['text']}, '{_WORD}', 0), 1, cast(_pw_part as int)), ' ')")
    out = out.withColumn(own["text"], F.when(cut, part).otherwise(F.col(own["text"])))
    if "n_chars" in own:
        n = own["n_chars"]
        out = out.withColumn(n, F.when(cut, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*own.values()).toDF(*names)


def training_order(mix: DataFrame) -> DataFrame:
    """doc_id, text, file and row of the written mix; the order of file and row is the training order.

    Spark packs files into tasks by size, so the order of rows that are read back says
    nothing; names of files and places in them do. For rows that were not read from
    Parquet, file is null and row their number in the order of partitions.
    """
    try:
        out = mix.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        out.schema  # noqa: B018
    except AnalysisException:
        out = mix.select("doc_id", "text", F.lit(None).cast("string").alias("file"), F.monotonically_increasing_id().alias("row"))
    return out
