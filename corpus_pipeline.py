"""A corpus pipeline: language, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import dartminhash, langid, mixing, pii, spm
from tessera.llm.common import drop_path, new_path, small_batches
from tessera.llm.queries import remainder, tokenizer_file

#: A text whose n-grams are on average no likelier in its predicted language than at random (log odds), or ``und``, is rejected.
LEAST_USUAL = 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a text go, and those whose n-grams are no likelier in the predicted language than at random.

    Those are foreign scripts and strings of random letters. The model learns from the stage's own labelled input; without labels nothing can be predicted and every document goes.
    Repeated rows are decided alike, rows without an id like any other.
    """
    small_batches(spark)
    return langid.keep(docs, langid.fit(docs, held_out=lambda c: remainder(c, 5) == 0), LEAST_USUAL)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows are decided by id and text: of rows with the same id and words one stays (the least in the order of the other columns, as text), rows of one id with different texts
    are documents of their own. Rows without an id stay. Columns of any name pass through.
    """
    small_batches(spark)
    return dartminhash.keep_one(docs, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with each piece of personal data replaced by its kind. Null and empty texts stay as they are, repeated rows change alike."""
    small_batches(spark)
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. n_chars and all else as it was; repeated rows and rows without an id are taken alike."""
    small_batches(spark)
    _, plan, small = mixing.mix_plan(docs)
    return mixing.take(docs, plan, small)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text is empty, an empty table gives none."""
    small_batches(spark)
    return spm.digests(docs, tokenizer_file("piece_bpe_32k.model")).drop("spans_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]

#: Language models, signatures and SentencePiece are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:  # nothing reads it any more
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
