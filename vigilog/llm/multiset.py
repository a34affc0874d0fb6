"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs.

A paragraph hashes to a wide vector; the fingerprint of a document is the sum of the vectors of its
paragraphs, lane by lane modulo a power of two. So the order of paragraphs doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector, without the rest of the text.

A vector has two parts. ``EQUAL_LANES`` lanes modulo 2^64 are a BLAKE2b digest of the paragraph and
tell equal multisets from different ones. ``LIKE_LANES`` lanes modulo 2^32 hold a count sketch of the
paragraph's windows of 16 bytes: each window adds 1 or -1 to one lane that its hash names, so that no
text under 2^31 bytes, more than a column value can have, wraps a lane. Dot
products of such sums estimate how many windows two documents share, with a relative error of about
(2 / LIKE_LANES)^0.5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType

from .ranges import in_ranges

EQUAL_LANES = 8
LIKE_LANES = 128
WINDOW = 16
#: Documents of one range when neighbours are sought, and the most ranges (a number for each is read by the driver).
RANGE_ROWS = 4096
MAX_RANGES = 4096
_HEX_EQUAL = 2 * 8 * EQUAL_LANES
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, np.int32) if like is None else like

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        """Of a text; paragraphs end at line feeds, null is the empty text (one empty paragraph)."""
        raw = (text or "").encode()
        digests = b"".join(hashlib.blake2b(p, digest_size=8 * EQUAL_LANES).digest() for p in raw.split(b"\n"))
        equal = np.frombuffer(digests, np.uint64).reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint64)
        # Zeros after each paragraph keep windows from reaching into the next one.
        data = raw.replace(b"\n", b"\0" * WINDOW) + b"\0" * WINDOW
        sums = np.zeros(2 * LIKE_LANES, np.int64)
        step = 1 << 18
        for start in range(0, len(data) - WINDOW, step):
            sums += _lanes(data[start : start + step + WINDOW])
        return cls(equal, (sums[::2] - sums[1::2]).astype(np.int32))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        return cls(
            np.frombuffer(bytes.fromhex(text[:_HEX_EQUAL]), ">u8").astype(np.uint64),
            np.frombuffer(bytes.fromhex(text[_HEX_EQUAL:]), ">i4").astype(np.int32),
        )

    def __str__(self) -> str:
        return (self.equal.astype(">u8").tobytes() + self.like.astype(">i4").tobytes()).hex()

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.equal == other.equal).all() and (self.like == other.like).all())

    def likeness(self, other: Fingerprint) -> float:
        """From 0 (nothing shared) to 1: twice the shared windows by all windows, as estimated."""
        if (self.equal == other.equal).all():
            return 1.0
        a, b = self.like.astype(np.float64), other.like.astype(np.float64)
        both = float(a @ a + b @ b)
        return min(1.0, max(0.0, 2 * float(a @ b) / both)) if both else 0.0


def _lanes(data: bytes) -> np.ndarray:
    """Windows that start in ``data`` (all but the last ``WINDOW`` bytes), by lane and sign."""
    positions = np.flatnonzero(np.frombuffer(data, np.uint8)[: len(data) - WINDOW])
    eights = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (len(data) - 7, 8), (1, 1))
    words = np.ascontiguousarray(eights).view(np.uint64)[:, 0]
    mixed = words[positions] * _MIX[0] ^ (words[positions + 8] * _MIX[1] >> np.uint64(7))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[2]
    return np.bincount((mixed >> np.uint64(56)).astype(np.int64) & (2 * LIKE_LANES - 1), minlength=2 * LIKE_LANES)


def fingerprint(text: Column | str) -> Column:
    """The fingerprint of a text as hexadecimal digits; null counts as the empty text."""

    @F.arrow_udf(StringType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([str(Fingerprint.of(t.as_py())) for t in texts], pa.string())

    return of(text)


def inserted(prints: Column | str, paragraph: Column | str) -> Column:
    """Fingerprints with one more paragraph each; null where either is null."""
    return _changed(prints, paragraph, 1)


def deleted(prints: Column | str, paragraph: Column | str) -> Column:
    """Fingerprints with one paragraph less; null where either is null."""
    return _changed(prints, paragraph, -1)


def _changed(prints: Column | str, paragraph: Column | str, sign: int) -> Column:
    @F.arrow_udf(StringType())
    def change(old: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(old.to_pylist(), texts.to_pylist(), strict=True):
            if a is None or b is None:
                out.append(None)
                continue
            step = Fingerprint.of(b)
            out.append(str(Fingerprint.parse(a) + step if sign > 0 else Fingerprint.parse(a) - step))
        return pa.array(out, pa.string())

    return change(prints, paragraph)


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gives way to as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEIGHBOURS = pa.schema(
    {
        "doc_id": pa.int64(),
        "n_chars": pa.int64(),
        "edited_sha256": pa.string(),
        "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(),
        "near_edited": pa.float64(),
        "near_next": pa.float64(),
    }
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order, each range closed by the first document of the next one."""
    waiting = None
    for batch in batches:
        rows = []
        columns = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            part, ghost, doc_id, text = (c[i].as_py() for c in columns)
            if waiting is not None and waiting[0] == part and waiting[1]:
                continue  # a range needs one document after its last
            text = text or ""
            mine = Fingerprint.of(text)
            if waiting is not None and waiting[0] == part:
                rows.append(_compare(waiting, text, mine))
            waiting = (part, ghost, doc_id, text, mine)
        yield pa.RecordBatch.from_pylist(rows, NEIGHBOURS)


def _compare(one: tuple, next_text: str, next_print: Fingerprint) -> dict:
    _, _, doc_id, text, mine = one
    new = edited(text, next_text)
    changed = Fingerprint.of(new)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
        "fingerprint": str(mine),
        "edited_fingerprint": str(changed),
        "near_edited": mine.likeness(changed),
        "near_next": mine.likeness(next_print),
    }


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness with it and the next one.

    Reads ``doc_id, text``; other columns are not looked at. The next document is that with the next
    larger ``doc_id``, equal ids by text; after the last comes the first, so a single document follows
    itself. Rows without an id come first. Null text is the empty text. An empty table gives no rows.

    Documents are dealt out by ranges of ids, with the first of each range sent to the range before
    as well: texts move once, and no task sees more than its ranges. All rows of one id share a range.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    ranges = min(MAX_RANGES, max(cores, docs.count() // RANGE_ROWS))
    ids = in_ranges(docs.select("doc_id"), "doc_id", "ids", ranges)
    parts = ids.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    bounds = [tuple(r) for r in parts.select("first", "last", "rows").orderBy("part").collect()]  # one row per range
    # Without an id sorts first, and min and max leave it out.
    lasts = [b[1] for b in bounds if b[1] is not None][:-1]
    firsts = [b[0] for b in bounds if b[0] is not None]
    nulls = ids.filter("doc_id IS NULL").limit(1).count()
    spans = max(1, len(firsts))
    # The number of the range: how many ranges end before the id.
    within = F.size(F.filter(F.array(*map(F.lit, lasts)), lambda last: last < F.col("doc_id"))) if lasts else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(within).cast("int")
    if nulls:
        starts = F.col("doc_id").isNull() | F.col("doc_id").isin(firsts[1:])
    else:
        starts = F.col("doc_id").isin(firsts)
    before = F.pmod(F.col("part") - 1, F.lit(spans)).cast("int")
    copies = F.when(
        starts, F.array(F.struct(F.col("part"), F.lit(0).alias("ghost")), F.struct(before.alias("part"), F.lit(1).alias("ghost")))
    ).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("ghost"))))
    placed = docs.select("doc_id", "text", part.alias("part")).select("doc_id", "text", F.explode(copies).alias("c"))
    dealt = placed.select(F.col("c.part").alias("part"), F.col("c.ghost").alias("ghost"), "doc_id", "text").repartition("part")
    ordered = dealt.sortWithinPartitions("part", "ghost", "doc_id", "text")
    return ordered.mapInArrow(_neighbours, from_arrow_schema(NEIGHBOURS))
