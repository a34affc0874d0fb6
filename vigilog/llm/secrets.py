"""Secret scans: candidates by pattern, false positives removed by a random forest.

All work is column expressions and Spark's own forest. A candidate is a long run of key characters
with a digit or a known prefix, a value set beside a word such as password or key, whatever its
characters, or the password of a URL; its features are its length and character mix, how often the kind of character
changes, how much of it dictionary words cover, whether it stands in a path, and the words beside it.

The forest is trained from labelled findings. Where none are given, ``planted_findings`` makes them
from the documents themselves: a bounded sample of documents lends its own words as surroundings, and
keys of known kinds (secret or harmless) are set between them.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .draws import drawn_texts

#: Shortest candidate, and characters looked at on either side.
SHORTEST = 16
AROUND = 48
#: Words that make up harmless names, words beside secrets, and words beside harmless keys.
DICTIONARY = (
    "and|app|auth|build|cache|client|config|data|demo|example|file|for|http|image|img|index|item|key|"
    "lib|list|log|main|name|node|order|page|part|path|release|report|sample|server|session|sha|src|"
    "static|test|the|user|value|version|view|with|your"
)
SECRET_WORDS = "access|api.?key|auth|bearer|credential|passphrase|passwd|password|private|pwd|secret|token"
HARMLESS_WORDS = (
    "account|build|card|checksum|commit|digest|etag|file|guid|hash|id|image|invoice|isbn|md5|object|order|"
    "phone|release|revision|serial|sha|uuid|version"
)
PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|npm_|sk-|sk_live_|xox[abp]-|eyJ|SG_"
REDACTED = "[REDACTED]"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=(?:{PREFIXES})|[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{SHORTEST},}}+={{0,2}}"
#: A value set beside a word: all between quotes, or all up to a space but closing punctuation. Group 1 ends the match.
ASSIGNED = (
    r"""(?i:pass(?:word|wd|phrase)|pwd|secret|token|key|credential)s?["']?\s*(?:[=:]=?|=>)\s*["']?"""
    r"""((?<=")[^\s"]{6,}(?=")|(?<=')[^\s']{6,}(?=')|(?<!["'])[^\s"'][^\s"']{4,}[^\s"'.,;:)\]}>])"""
)
#: The password of a URL.
IN_URL = r"""://[^\s/:@"']*:([^\s/@"']+)(?=@)"""
#: Documents that lend surroundings to planted findings, at most about; trees and their depth; the cut.
TRAIN_DOCUMENTS = 2000
LEAST_DOCUMENTS = 100
TREES = 30
DEPTH = 7
CUT = 0.5
#: Bits of a digest by which texts with secrets are told from most others.
MARK_BITS = 24

FEATURES = (
    "length", "digits", "upper", "lower", "marks", "hex", "distinct", "changes", "vowel_turns", "dictionary",
    "slashes", "in_path", "extension", "prefix", "assigned", "quoted", "secret_word", "harmless_word", "groups",
)


def text_key(text: Column | str) -> Column:
    """A digest of a text, as binary."""
    return F.unhex(F.sha2(text, 256))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text_key, at, candidate, before, after`` of every candidate in every text.

    ``text_key`` is a digest of the text; ``at`` counts characters from 0; ``before`` and ``after`` are up to ``AROUND`` characters. Texts
    between the candidates come from a split by the same pattern, so a text is passed over twice for each
    pattern and only texts with candidates give rows. What several patterns find alike comes once; a value
    that holds a shorter candidate gives both. Null and empty texts give none; a row without ``doc_id``
    gives its candidates with a null id; repeated rows give theirs each.
    """
    patterns = {"run": (CANDIDATE, 0), "set": (ASSIGNED, 1), "url": (IN_URL, 1)}
    any_ = F.lit(False)
    for pattern, _ in patterns.values():
        any_ = any_ | F.col("t").rlike(pattern)
    parts = docs.select("doc_id", F.col(text).alias("t")).filter(any_)
    parts = parts.select("doc_id", text_key("t").alias("text_key"), *[
        column
        for name, (pattern, group) in patterns.items()
        for column in (
            F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias(f"{name}_all"),
            F.regexp_extract_all("t", F.lit(pattern), F.lit(group)).alias(f"{name}_keys"),
            F.split("t", pattern, -1).alias(f"{name}_gaps"),
        )
    ])
    # Characters before a candidate: the gaps up to it, the matches before it, and what its match has before it.
    total = "aggregate(slice({0}, 1, {1}), 0L, (s, x) -> s + length(x))"
    spans = {
        name: f"""transform({name}_keys, (k, i) -> named_struct(
            'at', {total.format(f"{name}_gaps", "i + 1")} + {total.format(f"{name}_all", "i + 1")} - length(k),
            'candidate', k,
            'before', right(concat({name}_gaps[i], left({name}_all[i], length({name}_all[i]) - length(k))), {AROUND}),
            'after', left({name}_gaps[i + 1], {AROUND})))"""
        for name in patterns
    }
    each = parts.select("doc_id", "text_key", *[F.expr(e).alias(name) for name, e in spans.items()])
    new = "filter({0}, x -> NOT exists({1}, y -> y.at = x.at AND y.candidate = x.candidate))"
    each = each.select("doc_id", "text_key", F.expr(f"concat(run, {new.format('set', 'run')}, {new.format('url', 'concat(run, set)')})").alias("all"))
    return each.select("doc_id", "text_key", F.explode("all").alias("c")).select("doc_id", "text_key", "c.at", "c.candidate", "c.before", "c.after")


def features(found: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES``, all doubles, to rows with ``candidate, before, after`` (null: empty)."""
    key = F.coalesce("candidate", F.lit(""))
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.greatest(F.length(key), F.lit(1))
    low, beside = F.lower(key), F.lower(F.concat(before, F.lit(" "), F.regexp_extract(after, r"^.{0,16}", 0)))

    def count(pattern: str, of: Column = key) -> Column:
        return F.coalesce(F.regexp_count(of, F.lit(pattern)), F.lit(0))

    def flag(of: Column, pattern: str) -> Column:
        return of.rlike(pattern).cast("int")

    runs = count("[a-z]+") + count("[A-Z]+") + count("[0-9]+") + count("[^A-Za-z0-9]+")
    values = {
        "length": F.length(key),
        "digits": count("[0-9]") / size,
        "upper": count("[A-Z]") / size,
        "lower": count("[a-z]") / size,
        "marks": count("[^A-Za-z0-9]") / size,
        "hex": flag(key, "^[0-9a-f]+$"),
        "distinct": F.size(F.array_distinct(F.split(key, ""))) / size,
        "changes": runs / size,
        "vowel_turns": count("[aeiou][^aeiou]", low) / size,
        "dictionary": (F.length(key) - F.length(F.regexp_replace(low, DICTIONARY, ""))) / size,
        "slashes": count("/"),
        "in_path": flag(before, r"(?:[/\\.]|://\S*|[A-Za-z]:\\\S*)$"),
        "extension": flag(after, r"^\.[a-z0-9]{1,5}\b"),
        "prefix": flag(key, f"^(?:{PREFIXES})"),
        "assigned": flag(before, r"""[=:]\s*["']?$"""),
        "quoted": flag(before, r"""["']$"""),
        "secret_word": flag(beside, rf"(?:{SECRET_WORDS})\W{{0,6}}(?:$|\s)|(?:{SECRET_WORDS})\W{{0,6}}$"),
        "harmless_word": flag(beside, rf"\b(?:{HARMLESS_WORDS})\b"),
        "groups": count("-"),
    }
    return found.withColumns({name: values[name].cast("double") for name in FEATURES})


def planted_findings(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """Labelled findings ``candidate, before, after, label`` in surroundings lent by documents.

    At most ``most`` distinct texts, the smallest by hash; each lends the words around its middle to
    every kind of key. Keys are digests of the document, so a rerun plants the same; where there are
    fewer than ``LEAST_DOCUMENTS`` texts each lends its words several times, under other digests. A table without
    texts plants nothing.
    """
    chosen = drawn_texts(docs.select("text").filter("text IS NOT NULL"), most)
    words = chosen.select(
        F.regexp_replace(F.expr(f"right(left(text, cast(length(text) / 2 as int)), {AROUND})"), r"^\S*\s|\S*$", "").alias("lead"),
        F.regexp_replace(F.expr(f"substr(text, cast(length(text) / 2 as int) + 1, {AROUND})"), r"^\S*", "").alias("tail"),
        F.sha2("text", 512).alias("h"),
        F.coalesce(F.nullif(F.regexp_extract("text", "([a-z]{4,8})", 1), F.lit("")), F.lit("name")).alias("word"),
    )
    words = materialise(words, "lent-words")
    times = -(-LEAST_DOCUMENTS // max(1, words.count()))
    again = F.when(F.col("time") > 1, F.sha2(F.concat("h", F.col("time").cast("string")), 512)).otherwise(F.col("h"))
    words = words.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("h", again)
    upper = "translate(upper(left(h, {0})), '0189BF', 'QZXWKM')"
    mixed = "left(regexp_replace(base64(unhex(h)), '[^A-Za-z0-9]', ''), {0})"
    # (label, text between the lead and the key, key, text after the key)
    kinds = [
        (1, "' token = \"'", "left(h, 40)", "'\"'"),
        (1, "' api_key: '", mixed.format(32), "''"),
        (1, "' password='", "left(h, 18)", "''"),
        (1, "' secret = \\''", mixed.format(24), "'\\''"),
        (1, "' TOKEN = \"'", "left(h, 32)", "'\"'"),
        (1, "' '", "concat('AKIA', " + upper.format(16) + ")", "''"),
        (1, "' access '", "concat('AKIA', " + upper.format(16) + ")", "','"),
        (1, "' '", "concat('ghp_', " + mixed.format(36) + ")", "''"),
        (1, "' Authorization: Bearer '", mixed.format(43), "''"),
        (1, "' '", "concat('AKIA', translate(" + upper.format(16) + ", '234567', 'GHIJLN'))", "''"),
        (1, "' password = \"'", "concat(initcap(translate(word, 'aeio', '4310')), substr(h, 7, 3))", "'\"'"),
        (1, "' password: '", "concat(initcap(word), left(translate(h, 'abcdef', '123456'), 3), '!')", "''"),
        (1, "' pwd='", "concat(substr(h, 3, 3), '$', initcap(word), '#', substr(h, 9, 2))", "''"),
        (1, "' secret: \\''", mixed.format(10), "'\\''"),
        (1, "' api_key = '", "concat(" + mixed.format(6) + ", '%', substr(h, 5, 4), '.', substr(h, 20, 4))", "''"),
        (1, "' postgres://admin:'", "concat(translate(word, 'aeio', '4310'), initcap(word))", "'@db.host/x'"),
        (1, "' https://build:'", mixed.format(12), "'@host.example/x'"),
        (0, "' password: '", "word", "''"),
        (0, "' key: '", "concat(word, word)", "''"),
        (0, "' key = '", "concat(word, '_', word)", "''"),
        (0, "' token: \"'", "concat(word, '-', word)", "'\"'"),
        (0, "' password = \"'", "'your_password'", "'\"'"),
        (0, "' secret='", "concat(word, '.', word)", "'(1)'"),
        (0, "' password=${'", "concat(upper(word), '_', upper(word))", "'}'"),
        (0, "' https://user:'", "'password'", "'@host.example/x'"),
        (0, "' commit '", "left(h, 40)", "''"),
        (0, "' sha256 checksum '", "left(h, 64)", "''"),
        (0, "' md5: '", "left(h, 32)", "''"),
        (0, "' https://host.example/files/'", "left(h, 32)", "'.html'"),
        (0, "' /var/lib/objects/'", "left(h, 38)", "''"),
        (0, "' uuid '", "concat_ws('-', left(h, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "''"),
        (0, "' '", "left(translate(h, 'abcdef', '123456'), 16)", "''"),
        (0, "' card '", "left(translate(h, 'abcdef', '123456'), 16)", "''"),
        (0, "' '", "left(translate(h, 'abcdef', '123456'), 20)", "'.'"),
        (0, "' '", "concat(word, '_', word, '_version_', left(translate(h, 'abcdef', '123456'), 2))", "''"),
        (0, "' file '", "concat('report-', word, '-', word, '-', left(translate(h, 'abcdef', '123456'), 4))", "'.txt'"),
        (0, "' order '", "concat('ORDER', " + upper.format(4) + ", left(translate(h, 'abcdef', '123456'), 10))", "''"),
        (0, "' password='", "concat('your_password_', left(translate(h, 'abcdef', '123456'), 4))", "''"),
        (0, "' token = \"'", "'EXAMPLE_TOKEN_1234567890'", "'\"'"),
        (0, "' src/'", "concat(word, '/', word, '/test_', word, '2')", "'.py'"),
    ]
    made = ", ".join(
        f"struct({label}D AS label, concat(lead, {lead}) AS before, {key} AS candidate, concat({tail}, tail) AS after)"
        for label, lead, key, tail in kinds
    )
    return words.select(F.explode(F.expr(f"array({made})")).alias("f")).select("f.*")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (``candidate, before, after, label`` with 1 for secrets)."""
    rows = materialise(features(findings).select("label", *FEATURES), "findings")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, maxMemoryInMB=64
    )
    return forest.fit(_assembled(rows))


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``doc_id, text_key, at, candidate, score, is_secret`` of every candidate in ``doc_id, text``.

    Other columns are not looked at. Without a model one is trained from planted findings; a table
    without texts gives no rows.
    """
    found = materialise(candidates(docs), "candidates")
    if model is None:
        planted = planted_findings(docs)
        if planted.isEmpty():
            return found.select("doc_id", "text_key", "at", "candidate", F.lit(0.0).alias("score"), F.lit(False).alias("is_secret"))
        model = train(planted)
    scored = model.transform(_assembled(features(found)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "text_key", "at", "candidate", score.alias("score"), (score >= CUT).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all rows and columns stay.

    ``findings`` are those of ``scan`` over the same rows. A string that is a secret in a text is replaced
    wherever it stands in that text, and in no other: findings meet texts by their digest, whatever their
    ``doc_id``. A bitmap of fixed size keeps most texts without a secret from being shuffled, and a join the rest.
    """
    findings = materialise(findings.filter("is_secret").select("text_key", "candidate"), "secrets")
    secrets = (
        findings.groupBy("text_key")
        .agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias("found"))
    )
    clean = F.expr(f"aggregate(found, text, (t, s) -> replace(t, s, '{REDACTED}'))")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), text_key("text").alias("own"))
    bit = _bit("text_key")
    marks = findings.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    marks = materialise(marks, "secret-marks")  # bounded: 2 ** MARK_BITS bits
    at = F.bitmap_bit_position(_bit("own")).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = own.join(F.broadcast(marks), F.bitmap_bucket_number(_bit("own")) == F.col("bucket"), "left")
    own = own.withColumn("marked", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("bucket", "bits")
    joined = own.filter("marked").join(secrets, F.col("own") == F.col("text_key"), "left")
    both = joined.select("row", F.coalesce(clean, F.col("text")).alias("text")).unionByName(own.filter("NOT marked").select("row", "text"))
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _bit(key: Column | str) -> Column:
    """The bit of a digest in the bitmap of texts with secrets, from 1."""
    return F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS)) + 1
