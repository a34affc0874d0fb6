"""Aggregates of sliding windows from panes, so that no line is copied into its windows.

A pane is a stretch of lines of a node that each window holds whole or not at all. Lines are
reduced to one row per pane, and windows are sums of panes. Distinct values can't be summed; but
in a window a value counts once, at the line where it comes first: the line before with the same
value then lies before the window. So a pane tells, for each window that holds it, how many of its
lines bring a value that was not in the window before.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .windows import WINDOWS_PER_CHUNK, node_ordinals, window_span

PANE_KEY = ["node", "chunk", "pane"]
WINDOW = ["node", "chunk", "win_no"]


def pane_windows(
    lines: DataFrame,
    sums: Mapping[str, Column],
    distinct: Mapping[str, str],
    size: int = fv.WINDOW_SIZE,
    step: int = fv.WINDOW_STEP,
) -> DataFrame:
    """One row per full window: ``node``, ``win_no``, ``label`` (any line anomalous), ``seq_len``,
    the sums of columns over its lines, and numbers of distinct values.

    ``lines`` has ``node``, ``line_key``, ``label`` and what ``sums`` (name to column) and ``distinct``
    (name to the column whose values count, null aside) read. Lines are shuffled once for their
    ordinals and once into chunks of neighbouring windows of a node; panes and windows are made there.
    A chunk has a fixed number of lines, whatever the size of its node.
    """
    width = gcd(size, step)
    per_chunk = WINDOWS_PER_CHUNK
    chunks = F.expr(f"sequence(first_win div {per_chunk}, last_win div {per_chunk})")
    dealt = (
        window_span(node_ordinals(lines), size, step)
        .withColumn("chunk", F.explode(chunks))
        .withColumn("pane", F.expr(f"ordinal div {width}"))
        .drop("first_win", "last_win")
        .repartition("node", "chunk")
    )
    # Windows of a chunk begin in it: a line before it is in none of them.
    seen = {}
    for name, column in distinct.items():
        before = Window.partitionBy("node", "chunk", column).orderBy("ordinal")
        seen[name] = F.when(F.col(column).isNotNull(), F.coalesce(F.lag("ordinal").over(before), F.lit(-1)))
    marked = dealt.withColumns({f"__before_{n}": c for n, c in seen.items()})

    # The windows that hold a pane, from the last back.
    last = F.expr(f"pane * {width} div {step}")
    backs = range(-(-size // step))
    fresh = [
        F.count_if(F.col(f"__before_{n}") < (last - back) * step).alias(f"__fresh_{n}_{back}")
        for n in distinct
        for back in backs
    ]
    panes = marked.groupBy(*PANE_KEY).agg(
        F.max("node_lines").alias("node_lines"),
        F.max("label").alias("label"),
        F.count("*").alias("seq_len"),
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *fresh,
    )
    held = [
        F.struct(
            (last - back).alias("win_no"),
            *[F.col(f"__fresh_{n}_{back}").alias(n) for n in distinct],
        )
        for back in backs
    ]
    start = F.col("pane") * width
    whole = (
        (F.col("w.win_no") >= 0)
        & (F.col("w.win_no") * step + size >= start + width)
        & (F.col("w.win_no") * step + size <= F.col("node_lines"))
        & (F.floor(F.col("w.win_no") / per_chunk) == F.col("chunk"))
    )
    return (
        panes.withColumn("w", F.explode(F.array(*held)))
        .filter(whole)
        .select("node", "chunk", "label", "seq_len", *sums, "w.win_no", *[F.col(f"w.{n}").alias(n) for n in distinct])
        .groupBy(*WINDOW)
        .agg(F.max("label").alias("label"), *[F.sum(n).alias(n) for n in ("seq_len", *sums, *distinct)])
        .drop("chunk")
    )
