"""Sequence anomalies: which event follows a history of events in normal windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.shared import materialise
from .lookup import lookup
from .panes import pane_windows
from .windows import WINDOW_KEY, WINDOWS_PER_CHUNK, node_ordinals, window_lines, window_span


def log_vocabulary(
    lines: DataFrame,
    size: int = fv.WINDOW_SIZE,
    step: int = fv.WINDOW_STEP,
    words: int = fv.NGRAM_VOCABULARY,
) -> DataFrame:
    """The most frequent texts over all windows, numbered from 1: ``content``, ``n``, ``key``.

    A line counts once for each window it is in, which follows from its position, so windows
    are not built. Equal counts go to the text seen first, nodes in sorted order. Texts are
    reduced per node before the first place is compared, which keeps the large aggregation on
    fixed-width values.
    """
    spans = window_span(node_ordinals(lines.select("node", "line_key", "content")), size, step)
    per_node = spans.groupBy("content", "node").agg(
        F.sum(F.col("last_win") - F.col("first_win") + 1).alias("n"),
        F.min("ordinal").alias("__first"),
    )
    top = (
        per_node.groupBy("content")
        .agg(F.sum("n").alias("n"), F.min(F.struct("node", "__first")).alias("__seen"))
        .orderBy(F.desc("n"), "__seen")
        .limit(words)
    )
    # At most ``words`` rows are left, so ranking them in one place is fine.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "__seen"))
    return top.withColumn("key", rank).select("content", "n", "key")


def log_keys(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add the number of a line's text, 0 if not in the vocabulary (which has a fixed size)."""
    return lines.join(
        F.broadcast(vocabulary.select("content", "key")), "content", "left"
    ).withColumn("key", F.coalesce("key", F.lit(0)))


def key_sequences(
    keyed: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP
) -> DataFrame:
    """One row per window: ``node``, ``win_no``, ``label`` and the keys in order."""
    rows = window_lines(keyed.select("node", "line_key", "label", "key"), size, step)
    return (
        rows.groupBy(*WINDOW_KEY)
        .agg(
            F.max("label").alias("label"),
            F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("__keys"),
        )
        .select("node", "win_no", "label", F.col("__keys.key").alias("keys"))
    )


def ngrams(sequences: DataFrame, history: int = fv.NGRAM_HISTORY) -> DataFrame:
    """One row per step of a window: the ``history`` keys before it (``ctx``) and its key.

    ``ctx`` is text, the keys joined by commas. A window no longer than the history has none.
    """
    starts = F.when(
        F.size("keys") > history, F.sequence(F.lit(0), F.size("keys") - F.lit(history + 1))
    )
    return sequences.select("node", "win_no", "label", "keys", F.explode(starts).alias("start")).select(
        "node",
        "win_no",
        "label",
        "start",
        F.array_join(F.slice("keys", F.col("start") + 1, history).cast("array<string>"), ",").alias("ctx"),
        F.get("keys", F.col("start") + history).alias("nxt"),
    )


def transitions(grams: DataFrame) -> DataFrame:
    """How often, and where first, a key follows a context: ``ctx``, ``nxt``, ``n``, ``first``."""
    per_node = grams.groupBy("ctx", "nxt", "node").agg(
        F.count("*").alias("n"),
        F.min(F.struct("win_no", "start")).alias("__place"),
    )
    return per_node.groupBy("ctx", "nxt").agg(
        F.sum("n").alias("n"), F.min(F.struct("node", "__place")).alias("first")
    )


def top_next(counts: DataFrame, k: int = fv.NGRAM_TOP_K) -> DataFrame:
    """The k most frequent next keys of each context; equal counts go to the first seen.

    A context has at most one row per key of the vocabulary, so no context is large.
    """
    order = Window.partitionBy("ctx").orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sample_windows(sequences: DataFrame, limit: int, seed: int = fv.SEED) -> DataFrame:
    """Keys of ``limit`` windows chosen in hashed order (all of them if there are fewer)."""
    return (
        sequences.select("node", "win_no")
        .orderBy(F.xxhash64(F.lit(seed), "node", "win_no"), "node", "win_no")
        .limit(limit)
    )


def ngram_detect(
    sequences: DataFrame,
    history: int = fv.NGRAM_HISTORY,
    k: int = fv.NGRAM_TOP_K,
    train_windows: int | None = None,
) -> DataFrame:
    """Windows with ``pred`` = 1 if any step is not among the k usual ones of its context.

    Normal windows train the table, all of them or a sample of ``train_windows``. Steps meet
    the table by ``lookup`` with a text key, so a pair that makes up much of the log (long runs
    of one event) does not land in one task.
    """
    normal = sequences.filter(F.col("label") == 0)
    if train_windows is not None:
        chosen = sample_windows(normal, train_windows)
        normal = normal.join(chosen, ["node", "win_no"], "left_semi")
    usual = top_next(transitions(ngrams(normal, history)), k).select(
        F.concat_ws(",", "ctx", "nxt").alias("pair"), F.lit(1).alias("usual")
    )
    steps = ngrams(sequences, history).select(
        "node", "win_no", F.concat_ws(",", "ctx", "nxt").alias("pair"),
        F.struct("node", "win_no", "start").alias("step_key"),
    )
    unusual = (
        lookup(steps, usual, "pair", row_key="step_key")
        .filter(F.col("usual").isNull())
        .select("node", "win_no")
        .distinct()
        .withColumn("pred", F.lit(1))
    )
    return (
        sequences.select("node", "win_no", "label")
        .join(unusual, ["node", "win_no"], "left")
        .withColumn("pred", F.coalesce("pred", F.lit(0)))
    )


def line_steps(
    keyed: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP, history: int = fv.NGRAM_HISTORY
) -> DataFrame:
    """One row per line that is a step of some full window: ``node``, ``ordinal``, the keys before it
    (``ctx``) and its own (``nxt``), and the windows ``first_win`` to ``last_win`` it is a step of.

    A step is the same in all windows that hold it and its history. Lines are shuffled into chunks of a
    node; those before a chunk's first line come along, so that its history is there.
    """
    length = WINDOWS_PER_CHUNK * step + history
    near = F.col("ordinal") % length >= length - history
    chunk = F.expr(f"ordinal div {length}")
    numbered = node_ordinals(keyed.select("node", "line_key", "key")).drop("line_key")
    dealt = numbered.withColumn(
        "chunk", F.explode(F.when(near, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    ).repartition("node", "chunk")
    before = Window.partitionBy("node", "chunk").orderBy("ordinal").rowsBetween(-history, -1)
    last_full = F.expr(f"(node_lines - {size}) div {step}")
    return (
        dealt.withColumn("keys", F.collect_list("key").over(before))
        .filter((chunk == F.col("chunk")) & (F.size("keys") == history) & (F.col("node_lines") >= size))
        .select(
            "node", "ordinal", F.array_join(F.col("keys").cast("array<string>"), ",").alias("ctx"), F.col("key").alias("nxt"),
            F.greatest(F.lit(0).cast("bigint"), F.expr(f"(ordinal - {size} + {step}) div {step}")).alias("first_win"),
            F.least(F.expr(f"(ordinal - {history}) div {step}"), last_full).alias("last_win"),
        )
        .filter("first_win <= last_win")
    )


def detect_windows(
    keyed: DataFrame,
    size: int = fv.WINDOW_SIZE,
    step: int = fv.WINDOW_STEP,
    history: int = fv.NGRAM_HISTORY,
    k: int = fv.NGRAM_TOP_K,
) -> DataFrame:
    """``ngram_detect`` from keyed lines (``node``, ``line_key``, ``label``, ``key``), without building windows.

    Each step is matched against the usual ones once, however many windows overlap there; a window is
    found by those of its steps that are unusual. Windows as short as the history have no steps.
    """
    steps = materialise(line_steps(keyed, size, step, history), "steps")
    windows = materialise(pane_windows(keyed, {}, {}, size, step).select("node", "win_no", "label"), "windows")
    held = F.explode(F.sequence("first_win", "last_win"))
    normal = windows.filter("label = 0").select("node", "win_no")
    trained = steps.withColumn("win_no", held).join(normal, ["node", "win_no"], "left_semi")
    trained = trained.withColumn("start", F.col("ordinal") - F.lit(history) - F.col("win_no") * step)
    usual = top_next(transitions(trained), k).select(
        F.concat_ws(",", "ctx", "nxt").alias("pair"), F.lit(1).alias("usual")
    )
    pairs = steps.select(
        F.struct("node", "ordinal").alias("step_key"), "node", "first_win", "last_win",
        F.concat_ws(",", "ctx", "nxt").alias("pair"),
    )
    unusual = (
        lookup(pairs, usual, "pair", row_key="step_key")
        .filter(F.col("usual").isNull())
        .select("node", held.alias("win_no"))
        .distinct()
        .withColumn("pred", F.lit(1))
    )
    return windows.join(unusual, ["node", "win_no"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))
