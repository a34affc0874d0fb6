"""Text files, label files, result files, discovery."""

import pytest

from vigilog.sources import discovery, labels, results, shared, text_lines


def test_lines_of_many_files_and_splits_are_numbered_in_order(spark, tmp_path):
    lines = [f"  line {n} " if n % 5 else " \t" for n in range(3000)]
    for part in range(3):
        text = "\n".join(lines[part * 1000:(part + 1) * 1000]) + "\n"
        (tmp_path / f"part-{part}.log").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        scanned = text_lines.scan_all_lines(spark, str(tmp_path))
        assert scanned.select("file", "split_start").distinct().count() > 6
        found = {r["line_key"]: r["raw"] for r in text_lines.number_lines(scanned).collect()}
        head = text_lines.head_lines(text_lines.scan_all_lines(spark, str(tmp_path)), 1203).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {n: line.strip() for n, line in enumerate(lines)}
    assert head == sum(1 for n in range(1203) if n % 5)


def test_bytes_that_are_not_utf8_are_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ab\xffc\r\n\xe2\x80\x83wide space\xe2\x80\x83\r\n\r\n")
    rows = text_lines.scan_lines(spark, str(tmp_path / "a.log")).orderBy("line_key").collect()
    assert [r["raw"] for r in rows] == ["abc", "wide space"]


@pytest.mark.parametrize("lines, kind", [
    (["x SSHD[1]: hi"], "ssh"),
    (["081109 203615 148 INFO dfs.X: y"], "hdfs"),
    (["[Sun Dec] [warn] x"], "apache"),
    (["plain"] * 10 + ["sshd"], "linux"),
    (["[Sun Dec]", "[error] spans lines"], "apache"),
])
def test_format_detection(spark, tmp_path, lines, kind):
    (tmp_path / "f.log").write_text("\n".join(lines))
    found = text_lines.detect_log_type(text_lines.scan_all_lines(spark, str(tmp_path))).collect()
    assert [r["log_type"] for r in found] == [kind]


def test_labels_last_row_wins(spark, tmp_path):
    (tmp_path / "l.csv").write_text("BlockId,Label\nblk_1,Anomaly\n blk_2 , ANOMALY \nblk_1,Normal\n")
    rows = labels.read_label_rows(spark, str(tmp_path / "l.csv"))
    assert {r["block_id"]: r["label"] for r in labels.block_number_labels(rows).collect()} == {"1": 0, "2": 1}
    raw = {r["block_id"]: r["label"] for r in labels.block_labels(rows).collect()}
    assert raw["blk_1"] == 0 and set(raw.values()) == {0}


def test_discovery_prefers_the_first_name(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discovery.load_sources(spark, str(tmp_path))
    ssh = "Jun 14 15:10:01 s sshd[1]: Failed password for root from 1.2.3.4 port 4 ssh2\n"
    (tmp_path / "SSH.log").write_text(ssh * 9)
    (tmp_path / "SSH_2k.log").write_text(ssh * 7)
    (tmp_path / "HDFS_2k.log").write_text("081109 203615 148 ERROR dfs.X: bad\n")
    rows = discovery.load_sources(spark, str(tmp_path)).groupBy("dataset").agg({"label": "sum"}).collect()
    assert {r["dataset"]: r["sum(label)"] for r in rows} == {"ssh": 7, "hdfs": 1}


def test_result_documents(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("Rule Only", .1, .2, .3, .4, 1, 2, 3, 4), ("Hybrid (Rule + IF)", .5, .6, .7, .8, 5, 6, 7, 8)],
        results.METRIC_SCHEMA.replace("bigint", "bigint"),
    )
    path = str(tmp_path / "r")
    results.write_json(results.result_document(metrics, {"dataset": "BGL", "total": 26}), path)
    rows = results.hybrid_rows(results.read_results(spark, path)).collect()
    assert [(r["dataset"], r["total"], r["f1"], r["tp"]) for r in rows] == [("BGL", 26, .7, 5)]


def test_shared_folder_follows_the_session(tmp_path):
    class Session:
        def __init__(self, **settings):
            self.conf = {k.replace("__", "."): v for k, v in settings.items()}

    named = Session(spark__checkpoint__dir=str(tmp_path) + "/", spark__master="yarn")
    assert shared.shared_dir(named) == str(tmp_path)
    with pytest.raises(ValueError):
        shared.shared_dir(Session(spark__master="spark://host:7077"))


def test_written_tables_keep_their_schema(spark):
    table = spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS t", "array(1) AS a")
    written = shared.materialise(table, "t")
    assert written.count() == 5 and written.columns == table.columns
