"""Find the known log files of a folder and load them as one labelled table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import labels as lab
from .labels import block_number_labels, read_label_rows
from .shared import materialise
from .text_lines import parse_files


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path names; what it refuses is an error, not an absence."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def find_file(spark: SparkSession, folder: str, names: tuple[str, ...]) -> str | None:
    """The first of the names that exists in the folder."""
    paths = (f"{folder}/{name}" for name in names)
    return next((p for p in paths if path_exists(spark, p)), None)


# Columns from which labels are inferred or joined, and ``line_key``, by which joins spread lines.
LABELLED_BY = ("line_key", "raw", "event_type", "ip", "user", "path", "user_agent", "block_id")


def load_sources(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All sources found, parsed and labelled, as one table with a column ``dataset``.

    Labels are inferred per source. HDFS lines take theirs from the label table if there is one. Of the parsed
    columns those named by ``columns`` are written and given (all by default), besides those that labels need.
    """
    parts = []
    for source, names in fv.SOURCE_FILES.items():
        path = find_file(spark, folder, names)
        if path is None:
            continue
        # Written, as inferring labels reads the lines more than once.
        lines = parse_files(spark, path, source)
        if columns is not None:
            lines = lines.select(*LABELLED_BY, *[c for c in columns if c not in LABELLED_BY])
        lines = materialise(lines, source)
        if source == "hdfs":
            label_path = find_file(spark, folder, fv.LABEL_FILES)
            if label_path is None:
                labelled = lab.infer_hdfs_labels(lines)
            else:
                table = block_number_labels(read_label_rows(spark, label_path))
                labelled = lab.join_labels(lines, table)
        else:
            infer = {
                "ssh": lab.infer_ssh_labels,
                "apache": lab.infer_apache_labels,
                "linux": lab.infer_linux_labels,
            }[source]
            labelled = infer(lines)
        parts.append(labelled.withColumn("dataset", F.lit(source)))
    if not parts:
        raise FileNotFoundError(f"no known log file in {folder}")
    return reduce(DataFrame.unionByName, parts)
