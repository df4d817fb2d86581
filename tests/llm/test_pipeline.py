import corpus_pipeline
from kairograph.llm.common import durable
from tests.llm.util import edge_docs, empty_docs

DIR = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, DIR), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("n_chars <> length(text)").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == before


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_edge_rows(spark):
    for docs in (edge_docs(spark, extra=True), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = durable(stage(spark, docs, DIR), name)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()


def test_language_stage_drops_what_has_none(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.createDataFrame([(-1, "123 !!", "en", "s", 6), (-2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, DIR).collect()}
    assert not {-1, -2} & kept and len(kept) >= docs.count() - 4


def test_quality_stage_drops_bad_texts_and_keeps_repeats(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    twice = docs.unionByName(docs)
    kept = corpus_pipeline.keep_good_quality(spark, twice, DIR).groupBy("doc_id").count().collect()
    assert all(r["count"] % 2 == 0 for r in kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    stays = {r.doc_id for r in kept}
    good, bad = [i for i, q in known.items() if q == 1], [i for i, q in known.items() if q == 0]
    assert sum(i in stays for i in good) >= 0.9 * len(good) and sum(i in stays for i in bad) <= 0.3 * len(bad)


def test_personal_data_stage_leaves_no_base_span(spark):
    from kairograph.llm import pii

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = durable(corpus_pipeline.redact_personal_data(spark, docs.unionByName(docs), DIR), "redacted")
    assert out.count() == 2 * docs.count() and pii.base_spans(out).where("size(__base) > 0").isEmpty()
