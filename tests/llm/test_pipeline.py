import corpus_pipeline
from pairweave.llm import mixing, neardup, pii, quality, segment


def test_stages(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "encoding"]
    now = docs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name == "encoding":
            assert out.columns[0] == "doc_id"
            got = sorted(str(r) for r in out.select("doc_id").collect())
            assert got == sorted(str(r) for r in now.select("doc_id").collect())
            break
        assert out.columns == now.columns
        out = spark.createDataFrame(out.collect(), now.schema)
        ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
        if name == "quality":
            assert ids(out) == ids(quality.quality_weights(now, labels).where("selected"))
        elif name == "near_dedup":
            assert ids(out) == ids(neardup.near_duplicates(now, 5, 80).where("kept"))
        elif name == "pii":
            assert ids(out) == ids(now) and not [t for t in (r.text for r in out.collect()) if pii.base_spans(t)]
        elif name == "mixing":
            taken = {r.doc_id: (r.taken, r.size) for r in mixing.mixed(now).collect()}
            assert ids(out) == sorted(i for i, (t, s) in taken.items() if s for _ in range(-(-t // s)))
        now = out


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    row = out.first()
    assert segment.Decoder().decode(row.samples[0].ids)


def test_edges(spark, sf, odd, none):
    for start in (odd, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf)
            if name == "encoding":
                out.collect()
                break
            assert out.columns == now.columns
            now = spark.createDataFrame(out.collect(), now.schema)
