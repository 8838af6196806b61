import corpus_pipeline
from riftwise.llm import bpe, line_dedup, mixing, quality_model, simhash
from riftwise.llm.common import materialize, read

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, DIR, "documents")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r["doc_id"]: r for r in read(spark, DIR, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DIR), "test")
        sizes.append(docs.count())
        if stage is corpus_pipeline.classify:
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            good = [d for d, r in labels.items() if r["quality"] == 1 and not r["toxic"]]
            assert sum(d in kept for d in good) >= 0.95 * len(good)
        if stage is corpus_pipeline.dedup_near:
            assert docs.count() == simhash.near_duplicates(before).select("component_id").distinct().count()
        if stage is corpus_pipeline.encode:
            assert docs.count() == before.count() and docs.where("n_tokens = 0").count() == 0
        else:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3]
