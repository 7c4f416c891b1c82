"""A corpus pipeline of five stages over ``documents``; each calls one operator of ``millrace.llm``.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame that is written as Parquet and
read again.  All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, pieces, secrets, simhash, toxicity
from millrace.llm.queries import PIECE_MODEL, VERIFIED
from millrace.llm.scratch import drop, during


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on ``labels``, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, toxicity.standard_categories())
    return toxicity.accepted(docs, chain)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return simhash.survivors(docs, **simhash.STAGE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; the documents stay, with n_chars counted anew where the text changed."""
    return secrets.redact(docs, count_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its share."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their text."""
    with open(PIECE_MODEL, "rb") as f:
        model = f.read()
    return pieces.encode(docs, model, verified=VERIFIED)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Fitted models, fingerprints and ids are beyond SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, during(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")
        drop(before)
    return docs
