import corpus_pipeline
from auditlake.llm.common import written


def test_stages_chain(spark, docs, corpus):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, own, ""), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == own.columns, name
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in own.select("doc_id").collect()}
        own = out
    assert own.count() > 0


def test_stages_take_empty_tables(spark, no_docs):
    own = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, own, "").count() == 0
