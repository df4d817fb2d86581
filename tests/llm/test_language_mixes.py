import pytest

import corpus_pipeline
from kairograph.llm import language

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def by_lang(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").where("lang in ('de', 'en', 'es', 'fr') and length(text) > 1500").orderBy("doc_id").select("lang", "text").limit(400).collect()
    out = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.text.split())
    return out


def mixes(by_lang, share, number=10, words=200):
    """Texts of two languages each, `share` of their words in the first."""
    cut = int(2 * words * share)
    for a in sorted(by_lang):
        for b in sorted(by_lang):
            for x, y in zip(by_lang[a][:number], by_lang[b][-number:], strict=True) if a != b else ():
                yield " ".join(x[:cut] + y[: 2 * words - cut])


def test_stage_keeps_mixes_of_learnt_languages(spark, by_lang):
    texts = [t for share in (0.5, 0.55, 0.6) for t in mixes(by_lang, share)]
    assert len(texts) == 360
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    more = spark.createDataFrame([(-1 - i, t, None, "mix", len(t)) for i, t in enumerate(texts)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    out = corpus_pipeline.keep_known_languages(spark, docs.unionByName(more), DIR)
    assert out.where("source = 'mix'").count() == len(texts)


def test_one_span_scores_as_its_words_and_an_unsure_one_less(spark):
    model = language.train(spark.read.parquet(f"{DIR}/documents.parquet"))
    text = "the house of the people and their children"
    _, (whole, twice, none), _ = language.label_texts([text, f"{text} {text}", "Привет мир"], model)
    assert 0.9 < whole <= twice <= 1 and none == pytest.approx(1 / len(model.names))
