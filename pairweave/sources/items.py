"""Item sources: listings, group tasks, category dictionaries, embedding stores, images, and an adapter.

The canonical item row is ``item_id, title, description, geo, price, dept_id, color_id,
brand_id, text_emb, img_emb, label``; codes are 0 where unknown, vectors have length one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairweave.functions.columns import EURO_RATES, as_doubles, first_number, l2_normalize, numbers, to_euro

ITEM_SCHEMA = T.StructType([
    T.StructField("itemId", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("geo", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("departmentIds", T.StringType()),
    T.StructField("colorTagIdsString", T.StringType()), T.StructField("brandEditionTagId", T.StringType()), T.StructField("label", T.LongType()),
])
GROUP_SCHEMA = T.StructType([T.StructField(f"item{i}", T.StringType()) for i in range(1, 6)])

#: Embedding sets by name and split, as paths below a root folder.
EMBEDDING_SETS = {
    name: {split: f"{name}/{split}.parquet" for split in ("train", "phase_1", "phase_2")}
    for name in ("base", "contrastive", "ance", "e5dino")
}


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item listings from CSV with a header; ids are always strings, malformed numbers become null."""
    return spark.read.csv(path, header=True, schema=ITEM_SCHEMA, multiLine=True, escape='"', enforceSchema=False)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Group tasks ``item1 .. item5`` from CSV in long form: group_id (row order), pos, item_id."""
    wide = spark.read.csv(path, header=True, schema=GROUP_SCHEMA, enforceSchema=False)
    return groups_long(wide.withColumn("group_id", F.monotonically_increasing_id()))


def groups_long(wide: DataFrame) -> DataFrame:
    """group_id, pos (from 0), item_id of wide rows group_id, item1 .. item5."""
    return wide.select("group_id", F.posexplode(F.array(*[f"item{i}" for i in range(1, 6)])).alias("pos", "item_id"))


def read_embeddings(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """An embedding set of the catalogue; columns are read lazily, so unused vectors are never loaded."""
    return spark.read.parquet(f"{root}/{EMBEDDING_SETS[name][split]}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """item_id and bytes of images named ``{item_id}.jpg``; an unreadable image has null content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.jpg$", 1)
    good = F.hex(F.substring(F.col("content"), 1, 2)) == "FFD8"
    return files.select(name.alias("item_id"), F.when(good, F.col("content")).alias("content"))


def dictionary(cells: DataFrame, column: str) -> DataFrame:
    """raw_id, code: all numbers in a column of dirty cells in numeric order, from 1; 0 stays free for unknown.

    The window runs over the distinct ids only, a small dimension.
    """
    ids = cells.select(F.explode(numbers(F.col(column))).alias("n")).select(F.col("n").cast("decimal(38,0)").alias("n")).distinct()
    return ids.select(F.col("n").cast("string").alias("raw_id"), F.row_number().over(W.orderBy("n")).alias("code"))


def encode_with(rows: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    """rows with the code of the first number in a column, 0 where there is none or it is not in the dictionary."""
    coded = codes.select(F.col("raw_id").alias("_raw"), F.col("code").alias("_code"))
    key = F.col("_first").cast("decimal(38,0)").cast("string")
    return (
        rows.withColumn("_first", first_number(F.col(column))).withColumn("_raw", key).join(coded, "_raw", "left")
        .withColumn(out, F.coalesce("_code", F.lit(0))).drop("_raw", "_code", "_first")
    )


def write_dictionary(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("raw_id string, code int").json(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, title, raw price and codes of all parts. The windows see one row a type and one a first word."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    types = part.select("p_type").distinct().select("p_type", F.row_number().over(W.orderBy("p_type")).alias("dept_code"))
    word = F.split("p_name", " ")[0]
    words = part.select(word.alias("word")).distinct().select("word", F.row_number().over(W.orderBy("word")).alias("color_code"))
    part = part.withColumn("word", word).withColumn("brand_code", first_number(F.col("p_brand")).cast("int"))
    return part.join(types, "p_type").join(words, "word")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical item table over the driver's tables: each vector with a part and a document, by their numbers in turn.

    Ids of parts and documents count from 0, so the number of rows, which Parquet keeps in
    its footers, says which one comes in turn.
    """
    part, docs = catalogue(spark, sf_dir), table(spark, sf_dir, "documents")
    n_part, n_docs = (table(spark, sf_dir, t).count() for t in ("part", "documents"))
    e = table(spark, sf_dir, "embeddings").withColumn("p_partkey", F.col("vec_id") % n_part).withColumn("_doc", F.col("vec_id") % n_docs)
    docs = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("description"))
    geo = F.element_at(F.array(*map(F.lit, EURO_RATES)), (F.col("vec_id") % 13 + 1).cast("int"))
    half = lambda start: l2_normalize(as_doubles(F.slice("embedding", start, 32)))
    known = lambda code, every: F.when(F.col("vec_id") % every == 0, 0).otherwise(F.col(code)).cast("int")
    return (
        e.join(part, "p_partkey").join(docs, "_doc", "left").withColumn("geo", geo)
        .select(
            F.col("vec_id").alias("item_id"), F.col("p_name").alias("title"), "description", "geo", to_euro(F.col("p_retailprice"), F.col("geo")).alias("price"),
            known("dept_code", 11).alias("dept_id"), known("color_code", 5).alias("color_id"), known("brand_code", 7).alias("brand_id"),
            half(1).alias("text_emb"), half(33).alias("img_emb"), F.col("label").cast("long").alias("label"),
        )
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, pos, item_id: five items in a row form a group."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("group_id"), (F.col("vec_id") % 5).cast("int").alias("pos"), F.col("vec_id").alias("item_id"))
