"""The report over result documents of different shapes."""

import json

from vigilog.operators import reports
from vigilog.sources import results

RULE, FOREST, HYBRID = "Rule Only", "Isolation Forest Only", "Hybrid (Rule + IF)"


def scores(f1):
    return {"precision": 0.9, "recall": 0.8, "f1": f1, "fpr": 0.01}


def listed(rule, forest, hybrid):
    return [{"method": m, **scores(f)} for m, f in ((RULE, rule), (FOREST, forest), (HYBRID, hybrid))]


def report(spark, tmp_path, documents, extra=()):
    catalogue = {}
    for name, document in documents.items():
        path = tmp_path / f"{name}.json"
        path.write_text(document if isinstance(document, str) else json.dumps(document, indent=2))
        catalogue[name] = str(path)
    for name in extra:
        catalogue[name] = str(tmp_path / "nowhere" / f"{name}.json")
    rows = reports.comparison_report(results.read_documents(spark, catalogue)).collect()
    assert len({r["dataset"] for r in rows}) == len(rows)
    return {r["dataset"]: r.asDict() for r in rows}


def test_all_shapes_meet_in_one_table(spark, tmp_path):
    found = report(
        spark, tmp_path,
        {
            "Lines": {"ablation": {"rule_only": scores(.1), "isolation_forest": scores(.2), "hybrid": scores(.3)}, "total": 7},
            "hdfs": {"dataset": "HDFS", "total": 575061, "latency_ms_per_block": 0.015, "ablation": listed(.4, .5, .6)},
            "bgl": {"dataset": "BGL", "total": 9, "latency_ms_per_window": 0.002, "ablation": listed(.5, .6, .7), "more": [1]},
            "deep": {"dataset": "BGL", "method": "n-grams", "windows": 3, **scores(.4659)},
            "cv": [
                {"dataset": "BGL", "folds": 5, "f1_mean": .61, "f1_std": .02, "fpr_mean": .03, "fpr_std": .004},
                {"dataset": "OpenSSH", "folds": 5, "f1_mean": .9, "f1_std": .0, "fpr_mean": .0, "fpr_std": .0},
            ],
        },
        extra=["thunderbird"],
    )
    assert set(found) == {"Lines", "HDFS", "BGL", "OpenSSH"}
    assert [found["Lines"][c] for c in ("samples", "rule_f1", "if_f1", "hybrid_f1", "latency_ms")] == [7, .1, .2, .3, None]
    assert [found["HDFS"][c] for c in ("samples", "hybrid_f1", "latency_ms", "baseline_f1", "f1_gain")] == [575061, .6, .015, None, None]
    bgl = found["BGL"]
    assert [bgl[c] for c in ("rule_f1", "if_f1", "hybrid_f1", "hybrid_recall", "latency_ms")] == [.5, .6, .7, .8, .002]
    assert [bgl[c] for c in ("baseline_f1", "f1_gain", "cv_f1_mean", "cv_f1_std", "cv_fpr_mean")] == [.4659, .2341, .61, .02, .03]
    assert found["OpenSSH"]["hybrid_f1"] is None and found["OpenSSH"]["cv_f1_mean"] == .9


def test_files_without_results_are_passed_over(spark, tmp_path):
    found = report(spark, tmp_path, {"broken": "{not json", "empty": "", "other": {"hello": 1}, "ok": {"ablation": listed(.1, .2, .3)}})
    assert list(found) == ["ok"]
    assert report(spark, tmp_path, {}, extra=["a", "b"]) == {}


def test_the_later_of_two_documents_counts(spark, tmp_path):
    old, new = ({"dataset": "BGL", "total": n, "ablation": listed(f, f, f)} for n, f in ((5, .9), (6, .1)))
    found = report(spark, tmp_path, {"first": old, "second": new})
    assert [found["BGL"][c] for c in ("samples", "rule_f1", "hybrid_f1")] == [6, .1, .1]


def test_written_documents_come_back(spark, tmp_path):
    rows = [(RULE, .1, .2, .3, .4, 1, 2, 3, 4), (HYBRID, .5, .6, .7, .8, 1, 2, 3, 4)]
    metrics = spark.createDataFrame(rows, results.METRIC_SCHEMA)
    catalogue = {"list": str(tmp_path / "list"), "object": str(tmp_path / "object")}
    results.write_json(results.result_document(metrics, {"dataset": "list"}), catalogue["list"])
    results.write_json(results.result_document(metrics, {}, by_name=True), catalogue["object"])
    found = results.metric_rows(results.read_documents(spark, catalogue)).collect()
    by_set = {(r["dataset"], r["method"]): tuple(r)[4:] for r in found}
    assert by_set == {(d, row[0]): row[1:] for d in catalogue for row in rows}
    assert {r["total"] for r in found} == {10}
