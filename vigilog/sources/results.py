"""Result files: JSON and CSV sinks, and the reader of result documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists

METRIC_SCHEMA = (
    "method string, precision double, recall double, f1 double, fpr double,"
    " tp bigint, fp bigint, tn bigint, fn bigint"
)
RESULT_SCHEMA = (
    "dataset string, total bigint, normal bigint, anomaly bigint, alpha double,"
    f" threshold double, ablation array<struct<{METRIC_SCHEMA}>>,"
    " latency_ms_per_block double, latency_ms_per_window double, total_time_sec double"
)

METRICS = ("precision", "recall", "f1", "fpr", "tp", "fp", "tn", "fn")
#: Every field of every kind of document. The shape of ``ablation`` differs, so it is read as text.
DOCUMENT_SCHEMA = (
    f"dataset string, {METRIC_SCHEMA}, total bigint, normal bigint, anomaly bigint, ablation string,"
    " latency_ms double, latency_ms_per_block double, latency_ms_per_window double, folds bigint,"
    " f1_mean double, f1_std double, fpr_mean double, fpr_std double"
)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def result_document(metrics: DataFrame, facts: dict[str, object], by_name: bool = False) -> DataFrame:
    """One document with the given facts and the metric rows as ``ablation``: an array, or an object ``by_name``.

    Takes the few rows of one ablation table. Where its rows count samples, the document says how many.
    """
    fields = [c for c in METRICS if c in metrics.columns]
    counted = {"total": "tp + fp + tn + fn", "normal": "fp + tn", "anomaly": "tp + fn"}
    counts = [F.expr(f"max({e})").alias(c) for c, e in counted.items() if "tp" in fields and c not in facts]
    rows = F.collect_list(F.struct("method", F.struct(*fields)) if by_name else F.struct("method", *fields))
    document = metrics.agg(*counts, (F.map_from_entries(rows) if by_name else rows).alias("ablation"))
    return document.select(*[F.lit(v).alias(k) for k, v in facts.items()], *document.columns)


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Metric rows of result documents: dataset, total, latency, method and its metrics."""
    docs = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(paths)
    return docs.select(
        "dataset",
        "total",
        F.coalesce("latency_ms_per_block", "latency_ms_per_window").alias("latency"),
        F.inline("ablation"),
    )


def read_documents(spark: SparkSession, catalogue: dict[str, str]) -> DataFrame:
    """The result documents of a catalogue (name of a job, path of its file), whatever their shapes.

    Columns: ``entry`` (place in the catalogue), ``name``, ``kind``, ``dataset`` (the name, where a document has
    none) and every field of ``DOCUMENT_SCHEMA``; what a document lacks is null. Kinds are ``ablation``,
    ``folds`` (a cross-validation summary; a file may hold several) and ``single`` (metrics of one method). A file that is absent, that
    is no JSON, or that holds no metrics gives no rows.
    """
    parts = [spark.createDataFrame([], f"entry int, name string, {DOCUMENT_SCHEMA}")]
    for entry, (name, path) in enumerate(catalogue.items()):
        if exists(spark, path):
            found = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
            parts.append(found.select(F.lit(entry).alias("entry"), F.lit(name).alias("name"), "*"))
    kind = (
        F.when(F.col("ablation").isNotNull(), "ablation")
        .when(F.col("f1_mean").isNotNull(), "folds")
        .when(F.col("f1").isNotNull(), "single")
    )
    every = reduce(DataFrame.unionByName, parts).withColumn("kind", kind).filter("kind IS NOT NULL")
    return every.withColumn("dataset", F.coalesce("dataset", "name"))


def metric_rows(documents: DataFrame) -> DataFrame:
    """Rows of ``dataset, total, latency, method`` and metrics of the ablations of ``read_documents``.

    An ablation is an array of rows with their methods, or an object of rows by method.
    """
    listed = F.from_json("ablation", f"array<struct<{METRIC_SCHEMA}>>")
    named = F.from_json("ablation", f"map<string, struct<{METRIC_SCHEMA}>>")
    entries = F.transform(
        F.map_entries(named),
        lambda e: F.struct(e["key"].alias("method"), *[e["value"][c].alias(c) for c in METRICS]),
    )
    rows = F.when(F.ltrim("ablation").startswith("{"), entries).otherwise(listed)
    latency = F.coalesce("latency_ms", "latency_ms_per_block", "latency_ms_per_window")
    return documents.filter("kind = 'ablation'").select(
        "dataset", "total", latency.alias("latency"), F.inline(rows)
    )


def hybrid_rows(metrics: DataFrame) -> DataFrame:
    """The rows of the hybrid method."""
    return metrics.filter(F.col("method").contains("Hybrid"))
