"""Token counts as rollups maintained by deltas.

A batch of changes (inserts, deletes, revised counts) is summed to one signed row per source, language
and tokenizer version, and added to the totals. The totals are versions in a folder: each names a
written table of totals and one of the batches within it. Version ``n + 1`` is made by creating its
marker, which only one writer can; a batch that is in already changes nothing, so a commit may be
repeated after any failure.
"""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

KEYS = ("source", "lang", "version")
SUMS = ("documents", "tokens")


def deltas(changes: DataFrame) -> DataFrame:
    """One row per source, language and version with signed sums of documents and tokens.

    ``changes`` has ``op, source, lang, version, tokens, old_tokens``: an ``insert`` adds ``tokens``; a
    ``delete`` takes away ``old_tokens``; a ``revise`` does both, in the same keys (a document that
    moves, for instance to a new tokenizer version, is a delete and an insert). Null counts are 0,
    null keys a group of their own, unknown operations fail. Sums combine before the shuffle, so a
    source with a third of all rows is one row per task.
    """
    known = F.col("op").isin("insert", "delete", "revise")
    op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))
    new = F.when(op != "delete", F.coalesce("tokens", F.lit(0))).otherwise(0)
    old = F.when(op != "insert", F.coalesce("old_tokens", F.lit(0))).otherwise(0)
    documents = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    return changes.groupBy(*KEYS).agg(
        F.sum(documents).cast("bigint").alias("documents"), F.sum(new - old).cast("bigint").alias("tokens")
    )


class Rollups:
    """Totals in a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/versions"))

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _tables(self, version: int) -> tuple[DataFrame, DataFrame] | None:
        if not version:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version}"))
        try:
            name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        read = self.spark.read.parquet
        return read(f"{self.folder}/{name}/totals"), read(f"{self.folder}/{name}/batches")

    def committed(self, batch: str) -> bool:
        tables = self._tables(self.version())
        return tables is not None and not tables[1].filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no change, if it is in already."""
        if self.committed(batch):
            return False
        own = f"data/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/{own}/delta")
        delta = self.spark.read.parquet(f"{self.folder}/{own}/delta")
        while True:
            version = self.version()
            tables = self._tables(version)
            if self.committed(batch):
                return False
            name = f"{own}-{version + 1}"
            this = self.spark.range(1).select(F.lit(batch).alias("batch"))
            totals = tables[0].unionByName(delta) if tables else delta
            sums = [F.sum(c).cast("bigint").alias(c) for c in SUMS]
            totals.groupBy(*KEYS).agg(*sums).filter("documents <> 0 OR tokens <> 0").write.parquet(f"{self.folder}/{name}/totals")
            (tables[1].unionByName(this) if tables else this).write.parquet(f"{self.folder}/{name}/batches")
            if self._create(version + 1, name):
                return True

    def _create(self, version: int, name: str) -> bool:
        """Make the marker of a version, whole at once; False if another writer was first."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        waiting = self._path(f"{self.folder}/waiting-{uuid.uuid4().hex}")
        stream = self._fs.create(waiting, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(waiting, self._path(f"{self.folder}/versions/{version}"), never_over)
        except Exception as failure:  # the JVM's exception carries its class in the text
            if "FileAlreadyExists" not in str(failure):
                raise
            self._fs.delete(waiting, False)
            return False
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens``; keys with nothing left are gone."""
        tables = self._tables(self.version())
        if tables is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, documents bigint, tokens bigint")
        return tables[0]


def changes_of(docs: DataFrame, op: str, version: str, tokens: Column | str | None, old_tokens: Column | str | None = None) -> DataFrame:
    """Changes of one kind from rows with ``source, lang`` and their counts."""
    nothing = F.lit(None).cast("bigint")

    def count(of: Column | str | None) -> Column:
        return nothing if of is None else (F.col(of) if isinstance(of, str) else of).cast("bigint")

    return docs.select(
        F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"),
        count(tokens).alias("tokens"), count(old_tokens).alias("old_tokens"),
    )


_encodings: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def token_count(spark: SparkSession, path: str, pattern: str):
    """Column function: tokens of a text under a rank file; null and empty texts have 0.

    The driver reads and broadcasts the file (a vocabulary, under 1 MB)."""
    with open(path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        key = (ranks.value, pattern)
        if key not in _encodings:
            pairs = map(bytes.split, ranks.value.splitlines())
            table = {base64.b64decode(token): int(rank) for token, rank in pairs}
            _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        encode = _encodings[key].encode_ordinary
        return pa.array([len(encode(t.as_py() or "")) for t in texts], pa.int64())

    return count
