"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. Sizes are summed by source and leading hash bits; the running sum
over the buckets of a source shows in which bucket its budget ends. Only that bucket is opened, by
the next bits, until a single hash is left. What lies below the threshold is taken: no sort, and a
larger budget always takes a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .ranges import positions

#: Words of a text. Fixed value.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits that one level of a histogram resolves, and levels: 60 bits in all.
LEVEL_BITS = 10
LEVELS = 6
HASH_BITS = LEVEL_BITS * LEVELS
#: Sources up to which their plan, a short row for each, is sent to every task and no text is shuffled.
FEW_SOURCES = 100_000


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_hash(*columns: str) -> Column:
    """60 bits of the MD5 of the columns' text, null being a text of its own."""
    text = F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    )
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: list[int], share: float, cap: float
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources in code-point order, null last, take the weights in turn. All targets together are
    ``share`` of all sizes; a target above ``cap`` times its source stops there and the excess goes
    to the others by weight, again until none is above (each round fixes at least one source, so it
    ends; a round is one small aggregate over a row per source). With ``share`` above ``cap`` every
    source stops at its cap. A source without words has the target 0.
    """
    totals = materialise(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources"
    )
    named = totals.filter("source IS NOT NULL")
    ranked = positions(named, "source", "mix-places")
    last = totals.filter("source IS NULL").withColumn("place", F.lit(named.count()).cast("bigint"))
    ranked = ranked.unionByName(last)
    turn = F.pmod("place", F.lit(len(weights))).cast("int") + 1
    weighted = materialise(
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)),
        "mix-weights",
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(cap) <= F.col("weight") * F.lit(rate)
        row = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if(full).alias("sources"),
        ).first()
        if row["sources"] == stopped or not row["weight"]:
            break
        stopped = row["sources"]
        rate = (share * total - cap * row["size"]) / row["weight"]
    target = F.least(F.col("source_size") * F.lit(cap), F.col("weight") * F.lit(rate))
    if not row["weight"]:
        target = F.col("source_size") * F.lit(cap)
    return weighted.select("source", "source_size", target.cast("double").alias("target"))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, threshold, rest, tied`` from ``source, hash, size`` and ``source, budget``.

    Documents of a source with a hash below ``threshold`` have ``budget - rest`` words; those with
    the very hash (``tied`` rows with more than ``rest`` words together) end it. A budget of at
    least all words has the threshold above every hash.
    """
    open_ = budgets.select(
        F.col("source").alias("s"), F.lit(0).cast("bigint").alias("prefix"), F.col("budget").alias("rest")
    )
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        if level:
            of_bucket = F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")
            inside = sized.join(open_, _same(F.col("source"), F.col("s")) & of_bucket, "left_semi")
            sized = materialise(inside, f"mix-inside{level}")
        sums = sized.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("tied")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        running = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        # The bucket in which the budget ends: at most one of a source.
        ends = (
            running.join(
                open_.select("s", F.col("rest").alias("wanted")), _same(F.col("source"), F.col("s"))
            )
            .filter("before <= wanted AND wanted < before + words")
            .select(
                "s",
                F.col("bucket").alias("prefix"),
                (F.col("wanted") - F.col("before")).alias("rest"),
                "tied",
            )
        )
        open_ = materialise(ends, f"mix-level{level}")
    return (
        budgets.join(open_, _same(F.col("source"), F.col("s")), "left")
        .select(
            "source",
            F.coalesce("prefix", F.lit(1 << HASH_BITS)).alias("threshold"),
            F.coalesce(open_["rest"], F.lit(0)).alias("rest"),
            F.coalesce("tied", F.lit(1)).alias("tied"),
        )
    )


def mix(
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    cap: float = 2.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """What the mix takes of each document.

    Reads ``doc_id, text, source`` and returns ``keep`` (default ``doc_id``), ``size``,
    ``source_size``, ``target`` and ``taken``; with ``keep`` also ``times``, which is ``taken`` in whole
    documents, the one on the threshold going up or down to the nearest. Words taken: whole repeats of the document plus, for documents
    whose hash is below the threshold of the source, one more. The one document on the threshold
    gives the words that are still wanting, so that a source misses its target by less than a word.
    Rows that share that hash (repeated rows) share those words evenly, which may leave up to one
    word for each of them. Null text has size 0; a null source is a source; an empty table gives an
    empty result. The hash is of ``doc_id`` alone. Other columns are not looked at.
    """
    kept = keep or ["doc_id"]
    names = [f"k{i}" for i in range(len(kept))]
    sized = docs.select(
        *[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)],
        "source",
        word_count("text").alias("size"),
        document_hash("doc_id").alias("hash"),
    )
    small = materialise(sized.select("source", "size", "hash") if keep else sized, "mix-sizes")
    targets = source_targets(small, weights, share, cap)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("repeats", repeats.cast("bigint")).withColumn(
        "budget", F.floor("target") - F.col("repeats") * F.col("source_size")
    )
    plan = materialise(plan, "mix-plan")
    limits = materialise(thresholds(small, plan.select("source", "budget")), "mix-limits")
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    plan = plan.join(limits.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).drop("s")
    plan = F.broadcast(plan) if few else plan
    more = (
        F.when(F.col("hash") < F.col("threshold"), F.col("size"))
        .when(F.col("hash") == F.col("threshold"), F.least("size", F.floor(F.col("rest") / F.col("tied"))))
        .otherwise(0)
    )
    whole = F.when(
        (F.col("hash") < F.col("threshold"))
        | ((F.col("hash") == F.col("threshold")) & (F.col("rest") * 2 >= F.col("size") * F.col("tied"))),
        1,
    ).otherwise(0)
    all_ = sized if keep else small
    mixed = all_.join(plan.withColumnRenamed("source", "s"), _same(F.col("source"), F.col("s"))).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)],
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats") + more).alias("taken"),
        (F.col("repeats") + whole).cast("int").alias("times"),
    )
    return mixed if keep else mixed.drop("times")
