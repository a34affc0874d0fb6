"""Column helpers for scores: severity, fusion, normalisation, address and source tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def severity(score: Column) -> Column:
    """Severity band of a score; the lower edge belongs to the band."""
    (name, edge), *rest = fv.SEVERITY_BANDS
    band = F.when(score >= edge, name)
    for name, edge in rest:
        band = band.when(score >= edge, name)
    return band.otherwise("NORMAL")


def threat(rule_score: Column, anomaly_score: Column, alpha: float | Column) -> Column:
    """``alpha * rule + (1 - alpha) * anomaly``, unrounded, in this order of operations."""
    if not isinstance(alpha, Column):
        return F.lit(float(alpha)) * rule_score + F.lit(1 - float(alpha)) * anomaly_score
    return alpha * rule_score + (F.lit(1.0) - alpha) * anomaly_score


def fuse_columns(rule_score: Column, anomaly_score: Column, alpha: float | Column) -> list[Column]:
    """The five fused columns. Severity comes from the unrounded threat score."""
    fused = threat(rule_score, anomaly_score, alpha)
    weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return [
        F.round(rule_score, 4).alias("rule_score"),
        F.round(anomaly_score, 4).alias("anomaly_score"),
        F.round(fused, 4).alias("threat_score"),
        severity(fused).alias("severity"),
        weight.alias("alpha"),
    ]


def invert_minmax(score: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1] with the lowest score at 1. A constant score gives 0."""
    return F.when(high == low, F.lit(0.0)).otherwise(
        F.lit(1.0) - (score - low) / F.when(high != low, high - low)
    )


def invert_minmax_eps(score: Column, low: Column, high: Column) -> Column:
    """As ``invert_minmax`` with a small constant in the divisor. A constant score gives 1."""
    return F.lit(1.0) - (score - low) / (high - low + F.lit(1e-9))


def is_external(ip: Column) -> Column:
    """True for an address that is known and not in one of the private ranges tested."""
    private = ip == fv.LOOPBACK
    for prefix in fv.PRIVATE_PREFIXES:
        private = private | ip.startswith(prefix)
    return F.coalesce((ip != "") & (ip != "unknown") & ~private, F.lit(False))


def is_ssh_source(source: Column) -> Column:
    return F.coalesce(source.isin(*fv.SSH_SOURCES), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient that is 0 where the divisor is 0."""
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(F.lit(0.0))
