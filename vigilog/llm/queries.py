"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, new_path
from . import quality, warc
from .byte_pairs import BytePairs
from .chats import format_chats
from .language import identify, train
from .merkle import Manifest
from .mixing import mix
from .multiset import with_next
from .neighbours import nearest
from .repair import summary
from .rollups import Rollups, changes_of, token_count
from .secrets import scan
from .simhash import as_hex, near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_pairs")
def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the round trip back to bytes, as digests."""
    codec = BytePairs(
        spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    encoded = table(spark, sf_dir, "documents").select("doc_id", codec.encode_decoded("text").alias("both"))
    return encoded.select("doc_id", "both.ids", "both.decoded").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Weights that sources take in turn. Fixed values.
WEIGHTS = [5, 2, 1]

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
-- Sources reach their cap in the order of size by weight; the rate that fits is the first that stops no further one.
ordered AS (
  SELECT *, source_size::DOUBLE / weight AS ratio,
    coalesce(sum(source_size) OVER before, 0)::BIGINT AS stopped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight,
    (sum(source_size) OVER ())::BIGINT AS total
  FROM sources
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (
  SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * stopped) / open_weight AS rate FROM ordered
  WHERE source_size * 2.0::DOUBLE > weight * ((1.5::DOUBLE * total - 2.0::DOUBLE * stopped) / open_weight)
  ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * rate) AS target
  FROM sources LEFT JOIN rates ON true),
plan AS (
  SELECT source, source_size, coalesce(target, 0)::DOUBLE AS target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats
  FROM targets),
running AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.repeats,
    floor(p.target)::BIGINT - p.repeats * p.source_size AS budget,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) - s.size)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * repeats + greatest(0, least(size, budget - before)))::BIGINT AS taken
FROM running
"""


@query("op10_mixing", MIX_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by checksum, and documents without an id, are not learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@query("op9_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(docs, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.bits")


@query("op5_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


@query("op7_multiset_hash")
def multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return with_next(table(spark, sf_dir, "documents"))


@query("op8_nearest")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query("op2_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in every document, with the forest's verdict."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "at", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret"
    )


@query("op4_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior and score of every document."""
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Rank files by tokenizer version.
VERSIONS = {"v1": "byte_bpe_50k.tiktoken", "v2": "byte_bpe_multi_50k.tiktoken"}
LOADS = 4


@query("op3_token_rollups")
def token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a history of batches over all documents.

    Documents arrive in four loads counted by ``v1`` and are then counted by ``v2``; those labelled
    toxic are taken down; the rest is revised where it repeats a line. Two batches are sent twice.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    cleaned = docs.withColumn("cleaned", F.when(lines != F.col("text"), lines))
    columns = {}
    for version, name in VERSIONS.items():
        count = token_count(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)
        columns[version] = count("text")
        columns[f"{version}_cleaned"] = F.when(F.col("cleaned").isNotNull(), count("cleaned"))
    counted = materialise(cleaned.withColumns(columns).drop("text", "cleaned"), "token-counts")
    gone = counted.join(toxic, "doc_id", "left_semi")
    stays = counted.join(toxic, "doc_id", "left_anti").filter("v1_cleaned IS NOT NULL")
    load = F.pmod(F.xxhash64("doc_id"), F.lit(LOADS))
    batches = [(f"load-{i}", changes_of(counted.filter(load == i), "insert", "v1", "v1")) for i in range(LOADS)]
    batches.append(("recount", changes_of(counted, "insert", "v2", "v2")))
    batches.append(("takedown", changes_of(gone, "delete", "v1", None, "v1").unionByName(changes_of(gone, "delete", "v2", None, "v2"))))
    revised = [changes_of(stays, "revise", v, f"{v}_cleaned", v) for v in VERSIONS]
    batches.append(("clean", revised[0].unionByName(revised[1])))
    rollups = Rollups(spark, new_path(spark, "rollups"))
    for name, changes in [*batches, batches[1], batches[5]]:
        rollups.commit(name, changes)
    return rollups.totals()


#: Tools that conversations are taken to call. The limits leave some calls invalid.
SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 1000},
            "limit": {"type": "integer", "minimum": 1, "maximum": 200},
        },
    },
    "summarise": {
        "type": "object",
        "required": ["source", "words"],
        "additionalProperties": False,
        "properties": {"source": {"type": "string"}, "words": {"type": "integer", "minimum": 3}},
    },
}


@query("op6_chats")
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each answer taken as a search for the turn before it and a summary of what it found.

    The search asks for the text of the turn before; its result is that of the answer's first half, the
    summary's (which names the search) that of the second.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    # Of repeated turns the least text, so that a conversation calls the same however its rows come.
    asked = asked.groupBy("conv_id", "turn").agg(F.min("asked").alias("asked"))
    answers = turns.filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pairs = answers.join(asked, ["conv_id", "turn"])
    words = F.size(F.split("asked", " "))
    search = F.concat(F.lit("z"), F.col("turn"))
    arguments = [
        F.to_json(F.struct(F.col("asked").alias("query"), words.alias("limit"))),
        F.to_json(F.struct(F.struct(search.alias("$result")).alias("source"), F.size(F.split("text", " ")).alias("words"))),
    ]
    each = [
        pairs.select("conv_id", "turn", call_id.alias("call_id"), F.lit(name).alias("name"), a.alias("arguments"), content.alias("content"))
        for name, call_id, a, content in (
            ("search", search, arguments[0], F.expr("left(text, length(text) div 2)")),
            ("summarise", F.concat(F.lit("a"), F.col("turn")), arguments[1], F.expr("substr(text, length(text) div 2 + 1)")),
        )
    ]
    calls = each[0].unionByName(each[1])
    results = calls.filter("content <> ''").select("conv_id", "call_id", "content")
    return format_chats(turns, calls, results, SCHEMAS)


#: The columns of a leaf, in their order. Fixed values.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op13_merkle")
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents under one root, checked after every third text was lower-cased."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    now = lambda name: F.when(changed, lower).otherwise(F.col("text")) if name == "text" else F.col(name)
    return Manifest().prove(table(spark, sf_dir, "documents"), "doc_id", "lang", LEAF_FIELDS, now)


WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages),
typed AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM latest AS again FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN latest END AS refers_to
FROM typed
"""


@query("op12_warc", WARC_SQL)
def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    warc.register(spark)
    path = new_path(spark, "warc")
    warc.records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    return warc.verified(spark.read.format("warc").load(path)).select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which some, by a checksum, are left out, emptied, unended, repeated or given to the user."""
    space = F.lit(" ")
    named = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    named = named.withColumn("kind", F.crc32(key.cast("binary")) % 20).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


@query("op11_repair")
def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    all_ = turns.select(F.col("conv_id").alias("id")).distinct()
    found = all_.join(summary(damaged(turns)), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    longs = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        F.col("id").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
