"""The corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet below
the shared folder and reads again as the next stage's docs. All stages but the last return the
columns of documents; n_chars, where there is one, follows the text. Null texts count as empty and
are rejected by the first stage, as are texts without a letter. An empty table stays empty. Rows that
repeat an id and text stay together: they go through each stage alike, are no near-duplicates or repeated
passages of each other, and are packed each. Of equal or similar texts with different ids the smallest id
stays; among equal scores of languages the first by name wins. Further columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import langid, packing, pii, repeats, simhash
from frameloom.llm.common import crc_mod, keep, shared_dir, small_batches, table


#: Words that a worker keeps of the packing stage; the workers of earlier stages live on and need their memory too.
PACK_CACHE = 200_000


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those whose prediction is ``und`` go."""
    small_batches(spark)
    model = langid.fit_sample(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.predict(docs, model, label_col="__lang", score_col="__score")
    return found.where(F.col("__lang") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 over five words the document with the smallest id."""
    small_batches(spark)
    return simhash.deduplicate(docs, shared_dir(spark, "simhash"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have too."""
    small_batches(spark)
    return _with_length(repeats.remove_repeats(docs, shared_dir(spark, "repeats")).select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with labels in place of personal data and of terms that disclose it."""
    small_batches(spark)
    return _with_length(pii.sanitise(docs, shared_dir(spark, "pii")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, piece by piece."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "packing"), cache=PACK_CACHE)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, uri = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"{uri}/{name}")
    return docs
