"""Detection quality: confusion metrics, ablation, weight sweeps, folds, quantiles."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import ratio, threat
from ..sources.shared import materialise
from .forest import HASH_DIGITS, order_key
from .ordinals import dense_ordinal

FOLD_BUCKETS = 4096
#: Bits that a pass of the radix selection settles.
DIGIT_BITS = 16


def quality(counts: DataFrame, rounded: bool = True) -> DataFrame:
    """Add precision, recall, f1 and fpr to columns tp, fp, tn, fn; empty divisors give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    values = {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": ratio(fp, fp + tn),
    }
    return counts.withColumns({k: F.round(v, 4) if rounded else v for k, v in values.items()})


def _cells(label: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 1) & (pred == 1)),
        "fp": F.count_if((label == 0) & (pred == 1)),
        "tn": F.count_if((label == 0) & (pred == 0)),
        "fn": F.count_if((label == 1) & (pred == 0)),
    }


def compare_methods(
    df: DataFrame, methods: dict[str, Column], by: Sequence[str] = (), rounded: bool = True
) -> DataFrame:
    """Metrics per method. All methods are counted in one pass, then turned into rows."""
    label = F.col("label")
    cells = [
        c.alias(f"{cell}_{n}")
        for n, pred in enumerate(methods.values())
        for cell, c in _cells(label, pred).items()
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("method"),
                *[F.col(f"{cell}_{n}").alias(cell) for cell in ("tp", "fp", "tn", "fn")],
            )
            for n, name in enumerate(methods)
        ]
    )
    counts = df.groupBy(*by).agg(*cells).select(*by, F.inline(rows))
    return quality(counts, rounded)


def confusion_metrics(df: DataFrame, pred: str = "pred") -> DataFrame:
    """All metrics of one prediction. With a single class, all rows count as true positives."""
    label = F.col("label")
    cells = {k: c.alias(k) for k, c in _cells(label, F.col(pred)).items()}
    counts = df.agg(*cells.values(), F.count("*").alias("total_samples"))
    only_negative = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    scored = quality(counts).withColumns(
        {
            "false_positives": F.col("fp"),
            "false_negatives": F.col("fn"),
            "attack_samples": F.col("tp") + F.col("fn"),
            "normal_samples": F.col("fp") + F.col("tn"),
            "accuracy": F.round(ratio(F.col("tp") + F.col("tn"), F.col("total_samples")), 4),
            "false_negative_rate": F.round(ratio(F.col("fn"), F.col("fn") + F.col("tp")), 4),
            "true_positives": F.when(only_negative, F.col("tn")).otherwise(F.col("tp")),
            "true_negatives": F.when(only_negative, F.lit(0)).otherwise(F.col("tn")),
        }
    )
    return scored.select(
        "precision", "recall", F.col("f1").alias("f1_score"), "accuracy",
        F.col("fpr").alias("false_positive_rate"), "false_negative_rate",
        "true_positives", "false_positives", "true_negatives", "false_negatives",
        "total_samples", "attack_samples", "normal_samples",
    )


def _at_least(score: Column, cut: float) -> Column:
    return F.when(score >= cut, 1).otherwise(0)


def ablation_lines(df: DataFrame) -> DataFrame:
    """Rules, forest and both, per line: columns label, rule_pred, if_pred, anomaly_score."""
    rule = F.col("rule_pred").cast("double")
    mix = threat(rule, F.col("anomaly_score"), fv.LINE_ABLATION_ALPHA)
    return compare_methods(
        df,
        {
            "rule_only": F.col("rule_pred"),
            "isolation_forest": F.col("if_pred"),
            "hybrid": _at_least(mix, fv.LINE_ABLATION_THRESHOLD),
        },
    ).select("method", "precision", "recall", "f1", "fpr")


def ablation_sessions(df: DataFrame, alpha: float, cut: float) -> DataFrame:
    """Rules, forest and both, per session: columns label, rule_score, anomaly_score."""
    mix = threat(F.col("rule_score"), F.col("anomaly_score"), alpha)
    return compare_methods(
        df,
        {
            "Rule Only": F.when(F.col("rule_score") > 0, 1).otherwise(0),
            "Isolation Forest Only": _at_least(F.col("anomaly_score"), cut),
            "Hybrid (Rule + IF)": _at_least(mix, cut),
        },
    )


def sweep(df: DataFrame, alphas: Sequence[float], cuts: Sequence[float]) -> DataFrame:
    """Unrounded metrics for every weight and cut, from one pass over the sessions.

    A row is copied once per weight, not once per grid point: it falls into the slot given by
    how many cuts its threat score reaches. Slots are counted where the rows are, and what is
    shuffled is one small table of (weight, slot, label) counts; predictions at a cut are the
    counts of the slots above it.
    """
    ordered = sorted(cuts)
    weights = F.array(
        *[F.struct(F.lit(a).alias("alpha"), F.lit(1 - a).alias("rest")) for a in alphas]
    )
    rows = df.select("label", "rule_score", "anomaly_score", F.explode(weights).alias("w"))
    score = F.col("w.alpha") * F.col("rule_score") + F.col("w.rest") * F.col("anomaly_score")
    reached = sum((F.when(F.col("__threat") >= c, 1).otherwise(0) for c in ordered), F.lit(0))
    slots = (
        rows.withColumn("__threat", score)
        .groupBy(F.col("w.alpha").alias("alpha"), reached.alias("slot"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    )
    cut_rows = F.array(
        *[
            F.struct(F.lit(c).alias("threshold"), F.lit(n + 1).alias("need"))
            for n, c in enumerate(ordered)
        ]
    )
    above = F.col("slot") >= F.col("need")
    counts = (
        slots.select("alpha", "slot", "pos", "neg", F.inline(cut_rows))
        .groupBy("alpha", "threshold")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        )
    )
    return quality(counts, rounded=False)


def alpha_sweep(df: DataFrame, cut: float, alphas: Sequence[float] = fv.SWEEP_ALPHAS) -> DataFrame:
    """F1 and false positive rate for each weight of the rules."""
    return sweep(df, alphas, [cut]).select(
        "alpha", F.round("f1", 4).alias("f1"), F.round("fpr", 4).alias("fpr")
    )


def grid_tune(
    df: DataFrame,
    alphas: Sequence[float] = fv.TUNE_ALPHAS,
    cuts: Sequence[float] = fv.TUNE_THRESHOLDS,
) -> DataFrame:
    """The weight and cut with the best F1; of equal ones the smallest weight, then cut."""
    best = sweep(df, alphas, cuts).filter("f1 > 0").orderBy(F.desc("f1"), "alpha", "threshold").limit(1)
    rounded = [F.round(c, 4).alias(f"best_{c}") for c in ("f1", "precision", "recall", "fpr")]
    return best.select(
        F.col("alpha").alias("best_alpha"), F.col("threshold").alias("best_threshold"),
        *rounded, "tp", "fp", "tn", "fn",
    )


def stratified_folds(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = fv.SEED) -> DataFrame:
    """Add ``fold``: the rows of each label are dealt to the folds in hashed order.

    The order is that of an md5 of seed and key, so any engine finds the same folds. The fold sizes of a
    label differ by one at most. A label is ranked in hash ranges, so a frequent label does not meet in one
    task.
    """
    hashed = df.withColumn("__order", order_key(F.lit(seed), *map(F.col, key)))
    bucket = F.floor(F.col("__order") / F.lit(16.0**HASH_DIGITS / FOLD_BUCKETS))
    placed = dense_ordinal(hashed, ["label"], bucket, ["__order", *key], out="__place")
    return placed.withColumn("fold", F.pmod("__place", F.lit(folds)).cast("int")).drop("__order", "__place")


def fold_metrics(df: DataFrame, alpha: float, cut: float) -> DataFrame:
    """Unrounded metrics per fold from label, rule_score and anomaly_score."""
    mix = threat(F.col("rule_score"), F.col("anomaly_score"), alpha)
    return compare_methods(df, {"hybrid": _at_least(mix, cut)}, by=["fold"], rounded=False).drop(
        "method"
    )


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    names = {"f1": "f1", "precision": "p", "recall": "r", "fpr": "fpr"}
    stats = []
    for column, short in names.items():
        stats.append(F.round(F.avg(column), 4).alias(f"{short}_mean"))
        stats.append(F.round(F.stddev_samp(column), 4).alias(f"{short}_std"))
    return folds.agg(F.count("*").alias("folds"), *stats)


def contamination(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Share of anomalous rows, optionally clamped."""
    share = F.avg(F.col("label").cast("double"))
    if low is not None:
        share = F.greatest(F.lit(low), F.least(share, F.lit(high)))
    return df.agg(share.alias("contamination"))


def line_contamination(df: DataFrame) -> DataFrame:
    """Contamination for lines: the rounded percentage plus a margin, at most one half."""
    percent = F.round(F.lit(100) * F.sum("label") / F.greatest(F.count("*"), F.lit(1)), 2)
    return df.agg(F.least(F.lit(0.5), percent / 100 + F.lit(0.02)).alias("contamination"))


def order_bits(value: Column) -> Column:
    """A 64-bit integer for a double that orders as the double does (both zeros are one)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def from_order_bits(key: int) -> float:
    return struct.unpack(">d", struct.pack(">q", key if key >= 0 else key ^ (2**63 - 1)))[0]


def select_ranks(keys: DataFrame, ranks: Sequence[int]) -> list[int]:
    """The integers at some 0-based places in the order of ``key``, by radix selection.

    ``DIGIT_BITS`` bits are settled at a time, from the highest: the rows that share the digits settled so
    far are counted by their next digit, and the digit is the one in which the place lies. Four small
    aggregates, however the values are spread; none is sorted, and what is read is at most
    ``2 ** DIGIT_BITS`` counts for each place.
    """
    settled: dict[int, int | None] = dict.fromkeys(ranks)
    before = dict.fromkeys(ranks, 0)
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        head = F.shiftright("key", shift)
        inside = keys
        if None not in settled.values():
            inside = keys.filter(F.shiftright("key", shift + DIGIT_BITS).isin(sorted(set(settled.values()))))
        counts = inside.groupBy(head.alias("head")).agg(F.count("*").alias("n")).toArrow().sort_by("head")
        heads, n = counts["head"].to_numpy(), counts["n"].to_numpy()
        for rank, prefix in list(settled.items()):
            own = slice(None) if prefix is None else slice(*heads.searchsorted([prefix << DIGIT_BITS, (prefix + 1) << DIGIT_BITS]))
            upto = before[rank] + n[own].cumsum()
            at = int(upto.searchsorted(rank, "right"))
            settled[rank], before[rank] = int(heads[own][at]), int(upto[at] - n[own][at])
    return [settled[rank] for rank in ranks]


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """A quantile with linear interpolation between neighbours, exact at any size.

    The two values at its place are found by radix selection over order-preserving integers, which are
    written once. Nulls don't count; None without any value.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    keys = materialise(values.select(order_bits(F.col("v")).alias("key")), "quantile-keys")
    n = keys.count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = map(from_order_bits, select_ranks(keys, [int(place), min(int(place) + 1, n - 1)]))
    # Equal neighbours, infinite ones among them, need no interpolation.
    return low if low == high else low + (high - low) * (place - int(place))


def flag_outliers(df: DataFrame, score: str, cut: float | None) -> DataFrame:
    """Add ``if_pred``: 1 where the score is below the cut."""
    return df.withColumn("if_pred", F.when(F.col(score) < cut, 1).otherwise(0))
