from __future__ import annotations

import corpus_pipeline
from lettermill.llm import queries, simhash
from lettermill.llm.common import table
from tests.llm.helpers import DOCS, texts_of
from tests.llm.test_tokens_packing import verify_packing


def test_stages_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, texts = docs.columns, texts_of(sf_dir)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.simhash.store(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    by_quality = {r["doc_id"] for r in queries.op8_quality_classifier(spark, sf_dir).collect() if r["keep"]}
    assert set(kept[0]) == by_quality
    prints = {i: simhash.simhash(kept[0][i]) for i in kept[0]}
    assert len({*prints.values()}) >= len(kept[1])
    left = [prints[i] for i in kept[1]]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(left) for b in left[:k])
    assert all(any((prints[i] ^ prints[j]).bit_count() <= 2 for j in prints if j != i) for i in set(kept[0]) - set(kept[1]))
    leaks = {r["doc_id"] for r in queries.op4_benchmark_decontamination(spark, sf_dir).collect()}
    assert set(kept[2]) == set(kept[1]) - leaks
    assert set(kept[3]) == set(kept[2])
    changed = {i for i in kept[3] if kept[3][i] != texts[i]}
    assert all("[SECRET]" in kept[3][i] for i in changed)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    verify_packing(rows, list(kept[3].items()), 2048)


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
