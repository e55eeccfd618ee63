"""The queries that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import bpe, codes, maxscore, media, middle, mixing, ngrams, quality, secrets, simhash, substring, tokenfile, toxicity
from pairforge.llm.oracle import ORACLE_SQL as ORACLE_SQL
from pairforge.llm.storage import frugal
from pairforge.session import spread


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    frugal(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate_table(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir)).drop("times")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenfile.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokenfile.read(spark, path)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(spark, media.store(documents(spark, sf_dir)))


def op11_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(spark, sf_dir))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(documents(spark, sf_dir))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", middle.restore()))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frugal(spark)
    return codes.report(*codes.compress(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))))


QUERIES = {q.__name__: q for q in (op1_bpe, op2_substring, op3_mixing, op4_simhash, op5_maxscore, op6_toxicity, op7_quality, op8_token_files, op9_secrets, op10_media, op11_ngrams, op12_middle, op13_vector_codes)}
