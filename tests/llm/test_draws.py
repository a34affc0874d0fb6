"""Draws of texts to learn from, on tables with one text over and over."""

import pytest
from pyspark.sql import functions as F

from vigilog.llm import quality
from vigilog.llm.draws import drawn_texts
from vigilog.llm.language import training_rows
from vigilog.llm.secrets import planted_findings, redact, scan, text_key

SECRET = 'api_key = "q8Zr51LkPw0TnX7vB3sD"'


def repeated(spark, text, rows=300_000):
    return spark.range(rows).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))


def test_draw_is_never_empty_and_never_above(spark):
    df = spark.range(5000).select(F.concat(F.lit("t"), F.least("id", F.lit(700))).alias("text"))
    for most in (1, 50, 700, 10_000):
        found = [r.text for r in drawn_texts(df, most).collect()]
        assert len(found) == len(set(found)) == min(most, 701)
        assert sorted(found) == sorted(r.text for r in drawn_texts(df.repartition(5), most).collect())
    assert drawn_texts(repeated(spark, "one"), 10).count() == 1
    assert drawn_texts(df.limit(0), 10).collect() == []


@pytest.mark.parametrize("text", ["one text", "", None])
def test_quality_of_one_text(spark, text):
    out = quality.score(repeated(spark, text)).groupBy("quality", "keep").count().collect()
    assert len(out) == 1 and out[0]["count"] == 300_000 and 0 <= out[0].quality <= 1


def test_secrets_of_one_text(spark):
    df = repeated(spark, SECRET)
    found = scan(df)
    assert found.groupBy("is_secret").count().collect() == [(True, 300_000)]
    assert redact(df, found).filter(F.col("text").contains("q8Zr")).isEmpty()
    assert planted_findings(df.limit(0)).isEmpty()


def test_redaction_keeps_other_texts(spark):
    """A secret of one text stays in the words of another, also where neither has an id."""
    rows = [(None, "x"), (None, "a diary of hunter2xx the cat"), (7, "y"), (7, "hunter2xx again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 found", "2 row", "3 own", "4 text_key")
    df = df.withColumn("text", F.when(F.col("text").isin("x", "y"), F.lit("password: hunter2xx now")).otherwise(F.col("text")))
    findings = df.filter("text LIKE 'password%'").select("doc_id", text_key("text").alias("text_key"), F.lit("hunter2xx").alias("candidate"), F.lit(True).alias("is_secret"))
    clean = redact(df, findings)
    assert clean.columns == df.columns
    assert sorted(r.text for r in clean.collect()) == ["a diary of hunter2xx the cat", "hunter2xx again", *["password: [REDACTED] now"] * 2]


def test_language_rows_without_ids(spark):
    df = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    assert 700 < training_rows(df).count() < 1300
