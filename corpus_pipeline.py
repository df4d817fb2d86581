"""A corpus pipeline: language, quality, near copies, personal data, packing.

Each stage reads what the one before kept and wrote. A stage's function takes (spark, docs, sf_dir); all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import language, neardups, packing, pii, quality
from kairograph.llm.common import durable, table

#: A text stays if its spans are in learnt languages with at least this score.
LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, hold no letter, or are in no learnt language. With nothing to learn from all go.

    Repeated rows stay as often as they occur, if they stay; an empty table gives none.
    """
    found = language.identified(docs, language.train(docs))
    return found.where((F.col("lang.lang_pred") != language.UNKNOWN) & (F.col("lang.lang_score") >= LANGUAGE_SCORE)).select("row.*")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier scores below its threshold. Without labels all stay.

    Null and empty texts are scored as texts without features; repeated rows go or stay alike; an empty table gives none.
    """
    scored = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more)."""
    return neardups.one_of_each(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the spans found by their kind in brackets; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows keep their number; an empty table gives no rows.
    """
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts with their places in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur; an empty table gives none.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage but the language and quality filters' comparisons could be written in SQL; the stages are tested apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
