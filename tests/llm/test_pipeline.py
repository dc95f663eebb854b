"""The corpus pipeline's stages, each against a plain version of what it promises."""

import corpus_pipeline
from dealspark.llm import decontaminate, neardup, phrases
from dealspark.llm.common import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "passages", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, sf))
        if name != "packing":
            assert after.columns == docs.columns
        old, new = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
            assert len(set(old) - set(new)) < 0.3 * len(old) and len(set(old) - set(new) - toxic) < 0.05 * len(old)
        if name == "near_duplicates":
            assert set(new) == {r.class_id for r in neardup.op1(before).collect()}
        if name == "passages":
            removed = {r.doc_id: (r.n_removed, r.n_words, r.kept) for r in phrases.remove_passages(before).collect()}
            for i, (n, total, kept) in removed.items():
                assert (i in new) == (n == 0 or n < total)
                if i in new:
                    assert new[i].text == (old[i] if n == 0 else kept)
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert set(old) - set(new) == {r.doc_id for r in decontaminate.op4(before, items).collect()}
        if name == "packing":
            assert set(old) == set(new)
        else:
            before = after


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
