import corpus_pipeline
from gradus.llm import decontaminate, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a and len(b) for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) < len(ids[0])
    found = ngram_join.near_duplicates(seen[2]).collect()
    assert len({r.component_id for r in found}) == len(found) == len(ids[2])
    assert ids[2] == {r.component_id for r in ngram_join.near_duplicates(seen[1]).collect()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.contaminated(seen[2], items).collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    assert len(last) == seen[-1].count()
    assert sorted((r.shard, r.slot) for r in last) == [(s, i) for s in range(16) for i in range(sum(r.shard == s for r in last))]
