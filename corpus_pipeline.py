"""A training-data pipeline over ``documents``: each stage is one operator of ``vigilog.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilog.llm.byte_pairs import BytePairs
from vigilog.llm.language import UNDETERMINED, identify, train
from vigilog.llm.memory import small_batches
from vigilog.llm.mixing import mix
from vigilog.llm.near_copies import near_copies, shingle_key
from vigilog.llm.secrets import redact, scan
from vigilog.sources.shared import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text that a language model makes no shorter than its bytes is in none of the languages.
BITS = 8.0
#: Weights that sources take in turn. Fixed values.
WEIGHTS = [5, 2, 1]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table; those without letters, or that no language fits, go.

    Null and empty texts go. Where no document names its language nothing can be told, and all stay."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = train(docs)
    if model is None:
        return docs
    found = docs.withColumn("found", identify(docs, model))
    return found.filter((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.bits") < BITS)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest ``doc_id``.

    Near copies are found by SimHash (``op5``); such links are checked, and completed without loss, by their texts:
    near copies share 0.8 or more of their shingles of five words.
    Of rows with this id the least stays. In a group without any id one row stays as well."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    found = near_copies(docs)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("one", one).filter("one = 1").select(*COLUMNS)
    nameless = found.filter("component_id IS NULL").select(F.col("key").alias("k"), "component").distinct()
    each = docs.filter("doc_id IS NULL").withColumn("key", shingle_key("text")).join(nameless, F.col("key") == F.col("k"))
    least = F.row_number().over(Window.partitionBy("component").orderBy("key", "text", "lang", "source", "n_chars"))
    return kept.unionByName(each.withColumn("one", least).filter("one = 1").select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    docs = docs.select(*COLUMNS)
    clean = redact(docs, scan(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice, always whole."""
    mixed = mix(docs.select(*COLUMNS), WEIGHTS, keep=COLUMNS)
    # Not sequence(1, times): that counts down from 1 to 0 where a document isn't taken.
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, round_trip``: token ids of each text, and whether they decode to it."""
    small_batches(spark)
    codec = BytePairs(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = docs.select("doc_id", "lang", "source", codec.encode_checked("text").alias("both"))
    ids = F.col("both.ids")
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("bigint").alias("n_tokens"), ids.alias("ids"), "both.round_trip")


STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Model training, bit links and merges have no SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages make of ``documents``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
