from pyspark.sql import functions as F

from pairweave.operators import candidates
from pairweave.sources import items as S
from pairweave.streaming import incremental


def test_batches_find_what_one_search_finds(spark, sf, tmp_path):
    items = S.items(spark, sf).where("item_id < 120").select("item_id", "text_emb")
    for part in range(3):
        items.where(F.col("item_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.match_stream(stream, str(tmp_path / "out"), "text_emb", 119, 0.3, str(tmp_path / "cp")).awaitTermination()
    got = {(r.i, r.j) for r in incremental.pairs(spark, str(tmp_path / "out")).collect()}
    near = candidates.topk_self(items, "text_emb", 119).where("sim >= 0.3")
    assert got == {(r.i, r.j) for r in candidates.canonical_pairs(near).collect()} and got
