"""Near copies by SimHash fingerprints, checked and completed by Jaccard similarity of word shingles, without losing a pair.

Fingerprints (``simhash``) link first: texts of equal ones, and of ones within its radius, by its vantage-point trees.
Such a link counts if the texts are similar indeed. Four bits miss some similar texts, which shingles add:
Texts with equal sets of shingles are one point. Two sets of a similarity of at least 4/5 share at
least ``SHARED`` of their first ``size / 5 + SHARED`` shingles in any common order, and more the nearer
their sizes are, so only points that meet so often under these shingles are compared, by their texts.

The order puts shingles last that many documents share, such as those of a common passage, so that
points meet under them only where they have little else. All shingles are counted over all documents;
those of at least ``MANY`` documents come last (the bound doubles until ``MAX_FREQUENT`` hold). The order
bears on the time alone, not on the result. Shingles of one document alone lead to no other: of those
that are looked up only the ones in a bitmap of the repeated go on (it may hold others, the more the
larger the table).

Under each shingle all points are compared with the least one first. Points that hang together by
then need no comparison with one another, so a group of thousands of near copies takes thousands of
comparisons, not millions. Points of different groups are compared in pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from . import simhash
from .components import connected_components
from .memory import lean

#: Words of a shingle, and the similarity that links, as a fraction. Fixed values.
SHINGLE_WORDS = 5
ABOVE, BELOW = 4, 5
#: Shingles that two points must share to be compared.
SHARED = 4
#: Documents that make a shingle frequent, and the most frequent shingles that every task is sent (12 bytes each).
MANY = 8
MAX_FREQUENT = 1 << 20
#: Bits of the bitmap of repeated shingles that every task is sent, as a power of two.
BITMAP_BITS = 26
#: Bits of a key by which texts are told to be compared.
MARK_BITS = 20
#: Bytes of text whose shingles are counted in one task, about.
COUNTED_BYTES = 1 << 23
#: Shingles cut from a text at a time.
CUT_SHINGLES = 1 << 16
#: White space of words. Fixed value.
_SPACE = re.compile(rb"[\x09-\x0d ]+")


def shingles_of(text: str | None) -> set[bytes]:
    """Shingles of lower-cased (A-Z) words; a shorter text is one, a wordless one or null has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))}


def _hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of ``shingles_of``, which are cut from the text one by one: a long text takes eight
    bytes a word beside itself, not the hundreds of a set of shingles."""
    flat = _SPACE.sub(b" ", (text or "").encode().lower()).strip(b" ")
    if not flat:
        return np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == ord(" "))
    n = max(1, len(gaps) + 2 - SHINGLE_WORDS)
    starts, ends = np.zeros(n, np.int64), np.full(n, len(flat), np.int64)
    starts[1:] = gaps[: n - 1] + 1
    ends[: n - 1] = gaps[SHINGLE_WORDS - 1 : n + SHINGLE_WORDS - 2]
    hashed, found = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for i in range(0, n, CUT_SHINGLES):
        some = slice(i, i + CUT_SHINGLES)
        found[some] = [hashed(flat[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
    return np.unique(found).view(np.int64)


def similar(left: str | None, right: str | None) -> bool:
    """Whether the Jaccard similarity is 4/5 or more, by hashes of 64 bits. Two wordless texts are alike."""
    a, b = _hashes(left), _hashes(right)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * BELOW >= ABOVE * (len(a) + len(b) - both)


class Frequent:
    """Codes of frequent shingles, sorted, and how many documents have them; a bitmap of all repeated ones. A
    code is the beginning of a hash; two shingles may share one, which does no harm. ``codes`` and ``times``
    are those of hashes whose first bit is 0."""

    def __init__(self, bits: int, every: np.ndarray, counts: np.ndarray, repeated: np.ndarray):
        self.shift, self.every, self.counts, self.repeated = np.uint64(32 - bits), every, counts, repeated

    @property
    def codes(self) -> np.ndarray:
        return self.every[self.every < 1 << (63 - int(self.shift))]

    @property
    def times(self) -> np.ndarray:
        return self.counts[: len(self.codes)]

    def meeting(self, hashes: np.ndarray) -> np.ndarray:
        """Those of the hashes that other documents may have."""
        at = (hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).view(np.int64)
        return hashes[(self.repeated[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]

    def first(self, hashes: np.ndarray) -> np.ndarray:
        """Those of the distinct hashes that come first in the order."""
        rank = np.zeros(len(hashes), np.int64)
        if len(self.every) and len(hashes):
            codes = (hashes.view(np.uint64) >> self.shift).view(np.int64)
            at = np.minimum(np.searchsorted(self.every, codes), len(self.every) - 1)
            rank = np.where(self.every[at] == codes, self.counts[at], rank)
        return hashes[np.lexsort((hashes, rank))[: len(hashes) // BELOW + SHARED]]


NOTHING = Frequent(0, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))


def _points(text: Column | str, frequent: Broadcast | Frequent) -> Column:
    """``key, size, first``: digest and number of the shingles, and hashes of those that are looked up and may be met."""

    @F.arrow_udf("struct<key: binary, size: bigint, first: array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        lean()
        order = frequent.value if isinstance(frequent, Broadcast) else frequent
        # Columns of numbers, not rows of objects: a batch takes little more than its hashes.
        keys, sizes, ends, first = [], [], [0], [np.empty(0, np.int64)]
        for text in texts:
            hashes = _hashes(text.as_py())
            keys.append(xxhash.xxh128_digest(hashes.tobytes()))
            sizes.append(len(hashes))
            first.append(order.meeting(order.first(hashes)) if order is not NOTHING and len(order.repeated) else order.first(hashes))
            ends.append(ends[-1] + len(first[-1]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists], ["key", "size", "first"])

    return of(text)


def shingle_key(text: Column | str) -> Column:
    """The same for texts of the same shingles only."""
    return _points(text, NOTHING)["key"]


def _frequent(docs: DataFrame) -> Frequent:
    """Shingles of at least ``MANY`` documents, counted over all documents.

    A task packs the codes of its shingles by range of their hash, each once with the repeats it saw, so
    that a shingle of all documents comes once per batch; ranges are counted apart. Their number grows with
    the texts. Of the counts, only the frequent ones are kept, and at most ``MAX_FREQUENT`` are read."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITMAP_BITS - 3, max(4, int(total // COUNTED_BYTES).bit_length()))
    shift = np.uint64(32 - bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lean()
            held = [np.empty(0, np.int64)]
            for text in batch.column(0):
                hashes = _hashes(text.as_py())
                held.append((hashes.view(np.uint64) >> shift).view(np.int64))
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(codes, np.arange((1 << bits) + 1) << 32)
            again = times > 1
            rows = [
                (i, (codes[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes(), np.flatnonzero(again[a:b]).astype(np.uint32).tobytes(), (times[a:b][again[a:b]] - 1).astype(np.uint32).tobytes())
                for i, (a, b) in enumerate(itertools.pairwise(ends))
                if b > a
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "codes", "at", "more"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        lean()
        codes, times = [], []
        for own, at, more in zip(table["codes"], table["at"], table["more"], strict=True):
            codes.append(np.frombuffer(own.as_py(), np.uint32))
            n = np.ones(len(codes[-1]), np.int64)
            n[np.frombuffer(at.as_py(), np.uint32)] += np.frombuffer(more.as_py(), np.uint32)
            times.append(n)
        found, where = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(where, np.concatenate(times)).astype(np.int64)
        many = n >= MANY
        # The part's slice of the bitmap, in the row before the counts.
        bitmap = np.zeros(1 << (BITMAP_BITS - bits), np.uint8)
        bitmap[found[n > 1] >> np.uint32(32 - BITMAP_BITS + bits)] = 1
        packed = np.packbits(bitmap, bitorder="little").tobytes()
        codes = found[many].astype(np.int64) + (key[0].as_py() << 32)
        return pa.table({"part": pa.array([key[0].as_py()] * (len(codes) + 1), pa.int32()), "slice": pa.array([packed, *[None] * len(codes)], pa.binary()),
                         "code": pa.array([None, *codes.tolist()], pa.int64()), "n": pa.array([None, *n[many].tolist()], pa.int64())})

    packed = docs.select("text").mapInArrow(pack, "part int, codes binary, at binary, more binary")
    found = materialise(packed.groupBy("part").applyInArrow(count, "part int, slice binary, code bigint, n bigint"), "frequent")
    counts = found.filter("code IS NOT NULL").select("code", "n")
    level = F.floor(F.log2("n")).cast("int").alias("level")
    levels = {r["level"]: r["count"] for r in counts.groupBy(level).count().collect()}  # one row per power of two
    least = 0
    while sum(c for at, c in levels.items() if at >= least) > MAX_FREQUENT:
        least += 1
    top = counts.filter(F.col("n") >= (1 << least)).toArrow().sort_by("code")
    # All slices together are the bitmap, whose size is fixed.
    repeated = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    width = len(repeated) >> bits
    slices = found.filter("slice IS NOT NULL").select("part", "slice").toArrow()
    for part, own in zip(slices["part"].to_pylist(), slices["slice"], strict=True):
        repeated[part * width : (part + 1) * width] = np.frombuffer(own.as_buffer(), np.uint8)
    return Frequent(bits, top["code"].to_numpy(), top["n"].to_numpy(), repeated)


def _marked_key(text: Column | str, marks: Broadcast) -> Column:
    """``shingle_key`` of those texts whose key's first bits are marked, null for others."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        lean()
        marked, keys = marks.value, []
        for text in texts:
            key = xxhash.xxh128_digest(_hashes(text.as_py()).tobytes())
            keys.append(key if marked[int.from_bytes(key[:3], "big") >> (24 - MARK_BITS)] else None)
        return pa.array(keys, pa.binary())

    return of(text)


def _alike(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs ``a, b`` of points whose texts in ``docs`` are similar.

    Texts are read again for the points that are compared, not written for all: a bitmap of fixed size
    keeps most others from being shuffled, and a join the rest."""

    @F.arrow_udf("boolean")
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        lean()
        return pa.array([similar(a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True)], pa.bool_())

    nodes = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    nodes = materialise(nodes, "pair-keys")
    first = F.shiftright(F.conv(F.substring(F.hex("key"), 1, 6), 16, 10).cast("int"), 24 - MARK_BITS)
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[nodes.select(first.alias("at")).distinct().toArrow()["at"].to_numpy()] = True  # bounded: 2 ** MARK_BITS
    marked = _marked_key("text", docs.sparkSession.sparkContext.broadcast(marks))
    texts = docs.select(marked.alias("key"), "text").filter("key IS NOT NULL")
    wanted = texts.join(nodes, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    wanted = materialise(wanted, "pair-texts")
    left = wanted.select(F.col("key").alias("a"), F.col("text").alias("left"))
    right = wanted.select(F.col("key").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").filter(check("left", "right")).select("a", "b")


def _often(met: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with rows ``a, b, size_a, size_b``, one for each shared shingle, for enough of these."""
    sizes = [F.col("size_a"), F.col("size_b")]
    # So many they share if they are similar, and all but so many of them are looked up.
    both = F.ceil((sizes[0] + sizes[1]) * F.lit(ABOVE) / F.lit(ABOVE + BELOW))
    left = F.greatest(*[n - F.least(n, F.floor(n / BELOW) + SHARED) for n in sizes])
    return met.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n")).filter(F.col("n") >= both - left).select("a", "b")


def _fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of keys that the fingerprints ``fp`` of rows ``key, fp`` link: each key with the least of its
    fingerprint, and the least ones of linked fingerprints. They hang together as all texts within the radius do."""
    named = materialise(prints.select("key", "fp").distinct(), "key-prints")
    least = materialise(named.groupBy("fp").agg(F.min("key").alias("least")), "print-keys")
    equal = named.join(least, "fp").select(F.col("key").alias("a"), F.col("least").alias("b"))
    found = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("left")), "a")
    found = found.join(least.select(F.col("fp").alias("b"), F.col("least").alias("right")), "b")
    both = equal.unionByName(found.select(F.col("left").alias("a"), F.col("right").alias("b")))
    return both.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, key, component_id, component`` of each row of ``doc_id, text``.

    ``component_id`` is the smallest ``doc_id`` reachable over texts of a similarity of at least 4/5, the
    row itself included; null where a component has no id at all. ``component`` is the component's
    least key. Rows without ``doc_id`` are linked too, repeated rows stay repeated, and null and wordless
    texts are one point. Other columns are not looked at.
    """
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    found = docs.withColumn("p", _points("text", spark.sparkContext.broadcast(_frequent(docs))))
    found = found.select("doc_id", "p.key", "p.size", "p.first", simhash.fingerprint("text").alias("fp"))
    prints = materialise(found, "prints")
    points = materialise(prints.groupBy("key").agg(F.min("doc_id").alias("first_id")), "points")

    single = prints.select("key", "size", "first").dropDuplicates(["key"])
    looked_up = single.select("key", "size", F.explode("first").alias("shingle"))
    under = Window.partitionBy("shingle")
    least = F.min(F.struct("key", "size")).over(under)
    shared = looked_up.withColumns({"least": least, "rows": F.count("*").over(under)}).filter("rows > 1").drop("rows")
    shared = materialise(shared, "shared")

    close = F.least("size", "least.size") * BELOW >= F.greatest("size", "least.size") * ABOVE
    stars = shared.filter((F.col("key") != F.col("least.key")) & close)
    stars = stars.select(F.col("key").alias("a"), F.col("least.key").alias("b"), F.col("size").alias("size_a"), F.col("least.size").alias("size_b"))
    pairs = _fingerprint_pairs(prints).unionByName(_often(stars)).distinct()
    near = materialise(_alike(materialise(pairs, "stars"), docs), "near")

    parts = connected_components(near).select(F.col("node").alias("key"), "component")
    placed = shared.select("shingle", "key", "size").join(parts, "key", "left").withColumn("part", F.coalesce("component", "key"))
    placed = placed.select("shingle", "key", "size", "part")
    # Under most shingles all points hang together by now.
    open_ = placed.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    placed = materialise(placed.join(open_.select("shingle"), "shingle", "left_semi"), "placed")
    other = placed.select("shingle", F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("part").alias("part_b"))
    fits = F.least("size", "size_b") * BELOW >= F.greatest("size", "size_b") * ABOVE
    met = placed.join(other, "shingle").filter((F.col("key") < F.col("b")) & (F.col("part") != F.col("part_b")) & fits)
    met = met.select(F.col("key").alias("a"), "b", F.col("size").alias("size_a"), "size_b")
    across = materialise(_alike(materialise(_often(met), "met"), docs), "across")

    parts = materialise(connected_components(near.unionByName(across)), "parts")
    # Points without a link are their own component.
    named = points.join(parts, F.col("key") == F.col("node"), "left").select("key", "first_id", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumnRenamed("component", "c")
    by_key = named.join(smallest, F.col("component") == F.col("c")).select(F.col("key").alias("k"), "component_id", "component")
    return prints.select("doc_id", "key").join(by_key, F.col("key") == F.col("k")).select("doc_id", "key", "component_id", "component")
