"""Count-based sliding windows over the lines of each node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ordinals import dense_ordinal, key_buckets

# Windows of a node that are built in one group: enough to share most lines between
# neighbours, few enough to keep the group small (about step * WINDOWS_PER_CHUNK lines).
WINDOWS_PER_CHUNK = 64
WINDOW_KEY = ["node", "chunk", "win_no"]


def node_ordinals(lines: DataFrame) -> DataFrame:
    """Add ``ordinal``, the place of a line among the lines of its node, and ``node_lines``."""
    return dense_ordinal(
        lines, ["node"], key_buckets(lines, "line_key"), ["line_key"], total="node_lines"
    )


def window_span(lines: DataFrame, size: int, step: int) -> DataFrame:
    """Add ``first_win`` and ``last_win``, the full windows a numbered line is part of.

    Window k covers ordinals k*step to k*step+size-1. Lines in no full window are dropped: all
    lines of a node shorter than one window, and the remainder after the last full window.
    """
    return (
        lines.withColumn(
            "first_win", F.expr(f"greatest(0L, (ordinal - {size} + {step}) div {step})")
        )
        .withColumn(
            "last_win",
            F.expr(f"least(ordinal div {step}, (node_lines - {size}) div {step})"),
        )
        .filter(F.col("node_lines") >= size)
        .filter(F.col("first_win") <= F.col("last_win"))
    )


def window_lines(
    lines: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP
) -> DataFrame:
    """One row per line and full window it is in: adds ``win_no``, ``pos`` and ``chunk``.

    Neighbouring windows of a node are sent to one place together (a line at the edge of two
    chunks goes to both), and only there are lines copied into their windows. The result is
    partitioned by (node, chunk), so anything grouped by ``WINDOW_KEY`` needs no more shuffles.
    A chunk has a fixed number of lines, whatever the size of its node.
    """
    per_chunk = WINDOWS_PER_CHUNK
    chunks = F.expr(f"sequence(first_win div {per_chunk}, last_win div {per_chunk})")
    wins = F.expr(
        f"sequence(greatest(first_win, chunk * {per_chunk}),"
        f" least(last_win, chunk * {per_chunk} + {per_chunk} - 1))"
    )
    return (
        window_span(node_ordinals(lines), size, step)
        .withColumn("chunk", F.explode(chunks))
        .repartition("node", "chunk")
        .withColumn("win_no", F.explode(wins))
        .withColumn("pos", F.col("ordinal") - F.col("win_no") * step)
        .drop("first_win", "last_win", "node_lines")
    )


def sliding_windows(
    lines: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP
) -> DataFrame:
    """The windows: ``node``, ``win_no``, ``label`` (any line anomalous) and ``n_lines``."""
    return (
        window_lines(lines.select("node", "line_key", "label"), size, step)
        .groupBy(*WINDOW_KEY)
        .agg(F.max("label").alias("label"), F.count("*").alias("n_lines"))
        .drop("chunk")
    )


def window_ids(windows: DataFrame, prefix: str = "win_") -> DataFrame:
    """Add the running window id over all nodes in sorted order.

    The windows of a node are numbered 0, 1, ..., so the id needs only the number of windows of
    the nodes before. That running total goes over one row per first-letters group and then
    over the nodes inside a group.
    """
    nodes = windows.groupBy("node").agg((F.max("win_no") + 1).alias("__wins"))
    offsets = dense_offsets(nodes, "node", "__wins")
    return windows.join(offsets, "node").withColumn(
        "win_id", F.concat(F.lit(prefix), (F.col("__offset") + F.col("win_no")).cast("string"))
    ).drop("__offset")


def dense_offsets(nodes: DataFrame, key: str, amount: str, letters: int = 6) -> DataFrame:
    """Sum of ``amount`` over all rows with a smaller ``key``, one row per key.

    Keys are grouped by their first letters, which respects their order; totals run over the
    groups and, in parallel, inside each group.
    """
    lead = nodes.withColumn("__lead", F.substring(key, 1, letters))
    groups = lead.groupBy("__lead").agg(F.sum(amount).alias("__sum"))
    before_group = Window.orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(
        "__lead", F.coalesce(F.sum("__sum").over(before_group), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy("__lead").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        lead.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(groups, "__lead")
        .select(key, (F.col("__base") + F.col("__inside")).alias("__offset"))
    )
