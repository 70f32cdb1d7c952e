"""The pipeline's stages on small inputs."""

import corpus_pipeline
from blockwise.llm import toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.fixed(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    rows = [(r.doc_id, r.text) for r in kept["ngram_jaccard"].select("doc_id", "text").collect()]
    assert len({"".join((t or "").split()) for _, t in rows}) == len(rows) and not brute.jaccard_links(rows)
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").select("doc_id")
    clean = spark.read.parquet(f"{SF}/documents.parquet").join(toxic, "doc_id").count()
    assert kept["toxicity"].join(toxic, "doc_id").count() >= 0.98 * clean
    mixed = kept["mix_sources"].groupBy("doc_id").count()
    assert mixed.agg({"count": "max"}).first()[0] <= 3
    packed = kept["packing"]
    assert packed.where("start = 0").count() == kept["mix_sources"].count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_pipeline_on_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.fixed(stage(spark, docs, SF), "test-odd")
    assert docs.count() > 0


def test_keep_below_drops_by_score(spark, odd_docs, no_labels):
    model = toxicity.fit(odd_docs, no_labels)
    assert toxicity.keep_below(odd_docs, model).count() == 12 and toxicity.keep_below(odd_docs, model, -1.0).count() == 0
