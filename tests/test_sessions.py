"""Windows, blocks and their rules on small logs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from vigilog.operators import ordinals, panes, parsing, sessions, windows


def cluster(spark, counts, seed=0):
    rows = [(node, f"text {n % 7}", int(n % 31 == 0)) for node, c in counts.items() for n in range(c)]
    random.Random(seed).shuffle(rows)
    data = [(key, *row) for key, row in enumerate(rows)]
    return spark.createDataFrame(data, "line_key bigint, node string, content string, label int")


def brute_windows(lines, size, step):
    by_node = {}
    for r in sorted(lines.collect(), key=lambda r: r["line_key"]):
        by_node.setdefault(r["node"], []).append(r)
    out = {}
    for node, rows in by_node.items():
        for k, start in enumerate(range(0, len(rows) - size + 1, step)):
            part = rows[start:start + size]
            out[node, k] = (max(r["label"] for r in part), len({r["content"] for r in part}) / size)
    return out


@pytest.mark.parametrize("lines, wins", [(45, 3), (19, 0), (20, 1), (29, 1), (30, 2)])
def test_number_of_windows(spark, lines, wins):
    assert windows.sliding_windows(cluster(spark, {"a": lines})).count() == wins


@pytest.mark.parametrize("size, step", [(20, 10), (15, 4), (7, 7), (5, 9)])
def test_windows_equal_brute_force(spark, size, step):
    # One node holds most of the lines; chunks of windows are crossed many times.
    lines = cluster(spark, {"hot": 1500, "b": 64, "c": 19, "d": 20})
    found = {
        (r["node"], r["win_no"]): (r["label"], r["unique_ratio"])
        for r in sessions.thunderbird_windows(lines, size, step).collect()
    }
    assert found == brute_windows(lines, size, step)


def test_ordinals_do_not_depend_on_partitions_or_buckets(spark, monkeypatch):
    lines = cluster(spark, {"hot": 500, "b": 90, "c": 3})
    wide = {r["line_key"]: (r["ordinal"], r["node_lines"]) for r in windows.node_ordinals(lines).collect()}
    monkeypatch.setattr(ordinals, "MIN_BUCKET_WIDTH", 16)
    other = lines.repartition(7, "content")
    narrow = {r["line_key"]: (r["ordinal"], r["node_lines"]) for r in windows.node_ordinals(other).collect()}
    assert wide == narrow
    hot = sorted((k, v[0]) for k, v in wide.items() if v[1] == 500)
    assert [o for _, o in hot] == list(range(500))


def test_lines_are_shuffled_twice_for_windows(spark):
    lines = cluster(spark, {"a": 100})
    plan = sessions.bgl_windows(lines)._jdf.queryExecution().executedPlan().toString()
    # Two for the lines; the others move one row per (node, bucket).
    assert plan.count("Exchange hashpartitioning(node") <= 5
    assert "Exchange SinglePartition" not in plan and "Cartesian" not in plan


def test_window_ids_count_over_sorted_nodes(spark):
    lines = cluster(spark, {"n1": 45, "n0": 30, "m-with-a-long-name": 20, "n10": 20})
    ids = {
        (r["node"], r["win_no"]): r["win_id"]
        for r in windows.window_ids(windows.sliding_windows(lines)).collect()
    }
    assert [ids[k] for k in sorted(ids)] == [f"win_{n}" for n in range(len(ids))]


def test_block_of_a_failed_transfer(raw):
    lines = raw([
        "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-16 src: /10.2.1.1:5 dest: /10.2.1.1:5",
        "081109 203518 35 INFO dfs.FSNamesystem: BLOCK* NameSystem.addStoredBlock: 10.2.1.1:5 is added to blk_-16 size 67108864",
        "081109 203519 144 WARN dfs.DataNode$DataXceiver: 10.2.1.1:5:Got exception while serving blk_-16 to /10.1.2.9:",
        "081109 203520 145 INFO dfs.DataNode$DataXceiver: java.io.IOException: Connection reset by peer",
        "081109 203521 146 INFO dfs.DataNode$DataXceiver: 10.2.1.1:5:Got exception while serving blk_-16 to /10.1.2.9:",
    ])
    row = sessions.hdfs_sessions(parsing.parse_hdfs_sessions(lines)).first().asDict()
    expected = {
        "block_id": "blk_-16", "seq_len": 4, "error_count": 2, "error_ratio": 0.5,
        "unique_event_ratio": 0.75, "max_block_size": 67108864, "unique_components": 0,
        "count_E1": 1, "rule_score": 0.8, "rules_hit": ["HDFS-006"], "top_severity": "HIGH",
    }
    assert {k: row[k] for k in expected} == expected


def test_components_are_counted_over_the_whole_block(spark):
    texts = ["dfs.A and dfs.B", "dfs.B dfs.B", "dfs.C", "none", "none"] * 3
    lines = spark.createDataFrame([("blk_1", t) for t in texts], "block_id string, content string")
    row = sessions.hdfs_blocks(lines).first()
    assert (row["unique_components"], row["seq_len"]) == (3, 15)
    assert row["unique_event_ratio"] == pytest.approx(4 / 15)


def test_top_severity_is_that_of_the_first_rule(spark):
    lines = spark.createDataFrame(
        [(n, "n", "link down" if n else "x timeout", 0) for n in range(20)],
        "line_key bigint, node string, content string, label int",
    )
    row = sessions.thunderbird_sessions(lines).first()
    assert row["rules_hit"] == ["TB-003", "TB-005"] and row["top_severity"] == "HIGH"
    assert row["rule_score"] == 0.9


def test_case_folding_beyond_ascii_still_counts(spark):
    """The long s equals s when case is ignored, so a literal test alone would miss it."""
    lines = spark.createDataFrame(
        [(n, "n", "acceſſ is denied, connection refuſed", 0) for n in range(20)],
        "line_key bigint, node string, content string, label int",
    )
    row = sessions.thunderbird_sessions(lines).first()
    assert row["error_count"] == 20 and "TB-005" in row["rules_hit"]


def test_literals_are_necessary(spark):
    """The cheap tests must never hide a match: compare with the patterns alone."""
    from vigilog.functions.text import matches

    texts = [
        "FATAL", "Kernel  fatal", "fault", "abort now", "SEVERE", "app FATAL", "ciod: No such file", "Timeout",
        "ddr corrected", "storage interrupt", "Machine  check", "data storage interrupt", "machine state",
        "DISCOVERY warning", "parity error", "uncorrectable", "link lost", "ib_sm x cannot", "node not answer",
        "connection  refused", "unreachable", "Replicate", "packetresponder x exception", "FAILED writeBlock",
        "receiveBlock Failed", "x IOException", "WARNING", "allocate", "heartbeat", "INFO", "gmetad", "NTPD", "lost",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    for evidence in (sessions.HDFS_EVIDENCE, sessions.BGL_EVIDENCE, sessions.THUNDERBIRD_EVIDENCE):
        want = F.lit(0).cast("bigint")
        for n, (pattern, ignore_case, _) in enumerate(evidence.patterns):
            hit = matches(F.col("content"), pattern, ignore_case)
            want = want.bitwiseOR(F.when(hit, F.lit(1 << n)).otherwise(0).cast("bigint"))
        rows = evidence.bits(df, "content", "bits").withColumn("want", want)
        assert rows.filter("bits <> want").count() == 0


@pytest.mark.parametrize("size, step", [(20, 10), (15, 4), (6, 9)])
def test_panes_equal_brute_force(spark, size, step):
    """Sums and distinct values, nulls among them, of every window, over nodes that span many chunks."""
    rng = random.Random(size)
    rows = [(i, rng.choice("aaab"), rng.choice([None, "x", "y", "z", "w"]), rng.randrange(3), int(rng.random() < 0.02)) for i in range(3000)]
    lines = spark.createDataFrame(rows, "line_key bigint, node string, value string, n int, label int")
    found = panes.pane_windows(lines, {"total": F.col("n")}, {"values": "value"}, size, step)
    wanted = {}
    for node in "ab":
        own = [r for r in rows if r[1] == node]
        for k, start in enumerate(range(0, len(own) - size + 1, step)):
            part = own[start : start + size]
            wanted[node, k] = (max(r[4] for r in part), size, sum(r[3] for r in part), len({r[2] for r in part} - {None}))
    assert {(r.node, r.win_no): (r.label, r.seq_len, r.total, r["values"]) for r in found.collect()} == wanted


def test_no_line_is_copied_into_windows(spark):
    """Only lines at the edge of two chunks are unfolded, and panes into the windows that hold them."""
    lines = cluster(spark, {"hot": 20_000})
    plan = panes.pane_windows(lines, {}, {"texts": "content"})
    rows = plan.count()
    assert rows == 1999
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate explode") <= 4 and "Exchange SinglePartition" not in text
