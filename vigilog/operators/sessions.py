"""Session features and the line evidence of session rules, in one aggregation per kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import blank_to_null, java_pattern
from ..sources.shared import materialise
from .panes import pane_windows

HDFS_FEATURES = (
    "seq_len", "error_count", "error_ratio", "replicate_count", "max_block_size",
    "unique_event_ratio", "unique_components",
    *[f"count_E{n}" for n in range(1, 13)],
)
BGL_FEATURES = (
    "seq_len", *[c.name for c in fv.BGL_COUNTS],
    "fatal_ratio", "error_ratio", "unique_ratio", "unique_nodes",
)
THUNDERBIRD_FEATURES = (
    "seq_len", *[c.name for c in fv.THUNDERBIRD_COUNTS], "error_ratio", "unique_ratio",
)


class Evidence:
    """The patterns of a session kind, packed into the bits of one number per text.

    Every pattern runs once per text; what is shuffled afterwards is eight bytes. Patterns of
    rules come after those of features.
    """

    def __init__(self, counts: Sequence[fv.LineCount], rules: Sequence[fv.SessionRule]):
        self.counts = [c.name for c in counts]
        self.rule_lines = [r for r in rules if r.pattern]
        self.patterns = [(p.pattern, p.ignore_case, p.literals) for p in [*counts, *self.rule_lines]]

    def bits(self, lines: DataFrame, text: str, out: str) -> DataFrame:
        """Add the packed bits of a text column.

        A pattern runs only on texts that hold one of its literals. Comparing lower case finds
        the literals of patterns that ignore case in plain text; in text with other letters,
        some of which also count as equal, such patterns always run.
        """
        helped = lines.withColumn("__lower", F.lower(text)).withColumn(
            "__odd", F.length(text) != F.octet_length(text)
        )
        packed = F.lit(0).cast("bigint")
        for number, (pattern, ignore_case, literals) in enumerate(self.patterns):
            likely = F.col("__odd") if ignore_case else F.lit(False)
            for word in literals:
                likely = F.col("__lower" if ignore_case else text).contains(word) | likely
            hit = likely & F.col(text).rlike(java_pattern(pattern, ignore_case))
            bit = F.when(hit, F.lit(1 << number).cast("bigint"))
            packed = packed.bitwiseOR(bit.otherwise(F.lit(0).cast("bigint")))
        return helped.withColumn(out, packed).drop("__lower", "__odd")

    def sums(self, bits: str, lines: Column) -> list[Column]:
        """Matching lines per pattern; ``lines`` is the number of lines a row stands for."""
        names = [*self.counts, *[rule_column(r) for r in self.rule_lines]]
        return [
            F.sum(F.when(F.getbit(bits, F.lit(n)) == 1, lines).otherwise(0)).alias(name)
            for n, name in enumerate(names)
        ]

    def flags(self, bits: str) -> dict[str, Column]:
        """1 per pattern that a line matches, else 0."""
        names = [*self.counts, *[rule_column(r) for r in self.rule_lines]]
        return {name: F.getbit(bits, F.lit(n)).cast("bigint") for n, name in enumerate(names)}

    def resums(self) -> list[Column]:
        names = [*self.counts, *[rule_column(r) for r in self.rule_lines]]
        return [F.sum(name).alias(name) for name in names]


def rule_column(rule: fv.SessionRule) -> str:
    """Column with the number of lines that match the pattern of a rule."""
    return "lines_" + rule.rule_id.replace("-", "_")


HDFS_EVIDENCE = Evidence(fv.HDFS_COUNTS, fv.HDFS_RULES)
BGL_EVIDENCE = Evidence(fv.BGL_COUNTS, fv.BGL_RULES)
THUNDERBIRD_EVIDENCE = Evidence(fv.THUNDERBIRD_COUNTS, fv.THUNDERBIRD_RULES)


def hdfs_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: ``block_id``, the 19 features and the rule evidence.

    Lines are first reduced to distinct (block, text), so patterns run once per distinct text
    of a block, and a block of any size is spread over many tasks. To count distinct components
    without holding sets, each distinct text gives one row with its counts and one row per
    component; these are reduced by (block, component) and then by block.
    """
    texts = (
        lines.filter(F.col("block_id").isNotNull() & (F.col("block_id") != ""))
        .groupBy("block_id", "content")
        .agg(F.count("*").alias("__n"))
    )
    size = F.when(
        F.col("content").contains("size"),
        F.regexp_extract("content", java_pattern(fv.HDFS_SIZE), 1),
    ).try_cast("bigint")
    components = F.array_distinct(
        F.regexp_extract_all("content", F.lit(java_pattern(fv.HDFS_COMPONENT)), F.lit(1))
    )
    own_row = F.array(F.lit(None).cast("string"))
    rows = HDFS_EVIDENCE.bits(texts, "content", "__bits").select(
        "block_id",
        "__n",
        size.alias("__size"),
        "__bits",
        F.when(F.col("content").contains("dfs."), F.concat(own_row, components))
        .otherwise(own_row)
        .alias("__components"),
    ).withColumn("__component", F.explode("__components"))
    lines_here = F.when(F.col("__component").isNull(), F.col("__n")).otherwise(0)
    by_component = rows.groupBy("block_id", "__component").agg(
        F.sum(lines_here).alias("seq_len"),
        F.sum(F.when(F.col("__component").isNull(), 1).otherwise(0)).alias("__texts"),
        F.max("__size").alias("__size"),
        *HDFS_EVIDENCE.sums("__bits", lines_here),
    )
    blocks = by_component.groupBy("block_id").agg(
        F.sum("seq_len").alias("seq_len"),
        F.sum("__texts").alias("__texts"),
        F.coalesce(F.max("__size"), F.lit(0)).alias("max_block_size"),
        F.count("__component").alias("unique_components"),
        *HDFS_EVIDENCE.resums(),
    )
    return blocks.withColumns(
        {
            "error_ratio": F.col("error_count") / F.col("seq_len"),
            "unique_event_ratio": F.col("__texts") / F.col("seq_len"),
        }
    ).drop("__texts")


def _cluster_windows(
    lines: DataFrame, evidence: Evidence, rack: str | None, size: int, step: int
) -> DataFrame:
    """Per window: counts per pattern, distinct texts and (optionally) distinct racks.

    Lines are parsed once: what is written and shuffled afterwards is the label, the packed bits and
    digests of the text and the rack, not the text.
    """
    marked = evidence.bits(lines.select("node", "line_key", "label", "content"), "content", "__bits")
    columns = [F.unhex(F.md5(F.coalesce("content", F.lit("")))).alias("__text")]
    distinct = {"__texts": "__text"}
    if rack:
        columns.append(blank_to_null(F.regexp_extract("content", java_pattern(rack), 0)).alias("__rack"))
        distinct["unique_nodes"] = "__rack"
    compact = materialise(marked.select("node", "line_key", "label", "__bits", *columns), "marked-lines")
    found = pane_windows(compact, evidence.flags("__bits"), distinct, size, step)
    return found.withColumns(
        {
            "unique_ratio": F.col("__texts") / F.col("seq_len"),
            "error_ratio": F.col("error_count") / F.col("seq_len"),
        }
    ).drop("__texts")


def bgl_windows(
    lines: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP
) -> DataFrame:
    """One row per window: ``node``, ``win_no``, ``label``, 14 features, rule evidence."""
    return _cluster_windows(lines, BGL_EVIDENCE, fv.BGL_RACK, size, step).withColumn(
        "fatal_ratio", F.col("fatal_count") / F.col("seq_len")
    )


def thunderbird_windows(
    lines: DataFrame, size: int = fv.WINDOW_SIZE, step: int = fv.WINDOW_STEP
) -> DataFrame:
    """One row per window: ``node``, ``win_no``, ``label``, 11 features, rule evidence."""
    return _cluster_windows(lines, THUNDERBIRD_EVIDENCE, None, size, step)


def session_rules(sessions: DataFrame, rules: Sequence[fv.SessionRule]) -> DataFrame:
    """Add ``rule_score``, ``rules_hit``, ``rule_names`` and ``top_severity``; no shuffle.

    The top severity is that of the first rule of the table that fires.
    """

    def fires(rule: fv.SessionRule) -> Column:
        if rule.feature:
            return F.col(rule.feature) >= rule.threshold
        enough = F.col(rule_column(rule)) >= rule.min_lines
        return enough if rule.max_len is None else enough & (F.col("seq_len") <= rule.max_len)

    def listed(value) -> Column:
        return F.array_compact(F.array(*[F.when(fires(r), F.lit(value(r))) for r in rules]))

    scores = [F.when(fires(r), F.lit(r.score)) for r in rules]
    severities = [F.when(fires(r), F.lit(r.severity)) for r in rules]
    evidence = [rule_column(r) for r in rules if r.pattern]
    return sessions.withColumns(
        {
            "rule_score": F.coalesce(F.greatest(*scores), F.lit(0.0)),
            "rules_hit": listed(lambda r: r.rule_id),
            "rule_names": listed(lambda r: r.name),
            "top_severity": F.coalesce(*severities, F.lit("NORMAL")),
        }
    ).drop(*evidence)


def hdfs_sessions(lines: DataFrame) -> DataFrame:
    return session_rules(hdfs_blocks(lines), fv.HDFS_RULES)


def bgl_sessions(lines: DataFrame) -> DataFrame:
    return session_rules(bgl_windows(lines), fv.BGL_RULES)


def thunderbird_sessions(lines: DataFrame) -> DataFrame:
    return session_rules(thunderbird_windows(lines), fv.THUNDERBIRD_RULES)
