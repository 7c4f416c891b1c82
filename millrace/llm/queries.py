"""The queries ``opN_<name>``: each operator with production parameters over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ego, lm, mixing, pieces, quotes, secrets, simhash, topk, toxicity, urls

TOKENIZERS = "/opt/tokenizers"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
#: One text of so many is held against the sentencepiece library.
VERIFIED = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(_table(spark, sf_dir, "documents")).drop("found")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.standard_categories())
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("is_toxic"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    with open(model_path, "rb") as f:
        model = f.read()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, verified=VERIFIED).select("doc_id", "n_tokens", "is_lossless", "token_ids")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_lm_score(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    with open(model_path, "rb") as f:
        model = f.read()
    return lm.score(_table(spark, sf_dir, "documents"), model)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from millrace.llm import sql

    return sql.ORACLES
