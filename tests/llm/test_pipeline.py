import corpus_pipeline


def test_stages(spark, corpus, labels):
    sf = "/root/testdata/sf0.001"
    docs, before = corpus, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).checkpoint()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus.columns
        assert before is None or out.count() <= before
        docs, before = out, out.count()
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    first = {r.doc_id for r in corpus_pipeline.quality(spark, corpus, sf).collect()}
    assert len(good & first) >= 0.97 * len(good & {r.doc_id for r in corpus.collect()})


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("copies < 1").count() == 0 and out.count() > 100


def test_empty(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.count() == 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == empty.columns, name
