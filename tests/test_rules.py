"""Line rules, lookups and alerts."""

from pyspark.sql import functions as F

from vigilog.operators import fusion, line_rules, lookup, parsing


def alerts_of(lines, **options):
    found = line_rules.evaluate_rules(parsing.parse_ssh(lines), **options)
    return {r["rule_id"]: r for r in found.collect()}


def test_brute_force_score(raw):
    lines = [f"Jun 14 15:10:{n:02d} s sshd[1]: Failed password for root from 192.168.1.100 port 4 ssh2" for n in range(12)]
    alerts = alerts_of(raw(lines))
    assert set(alerts) == {"AUTH-001"}
    assert (alerts["AUTH-001"]["count"], alerts["AUTH-001"]["rule_score"]) == (12, 0.8400000000000001)
    assert alerts["AUTH-001"]["sample_raw"] == lines[0]
    assert alerts["AUTH-001"]["description"] == "IP 192.168.1.100 made 12 failed SSH login attempts"


def test_enumeration_and_stuffing(raw):
    users = ["oracle", "postgres", "nginx", "git", "deploy", "docker"]
    alerts = alerts_of(raw([f"Jun 16 02:14:0{n} s sshd[1]: Invalid user {u} from 103.45.67.89" for n, u in enumerate(users)]))
    assert {k: (a["count"], a["rule_score"]) for k, a in alerts.items()} == {
        "AUTH-002": (6, 0.8), "AUTH-005": (6, 0.7999999999999999)}
    assert alerts["AUTH-005"]["description"] == (
        "IP 103.45.67.89 tried 6 different usernames: ['deploy', 'docker', 'git', 'nginx', 'oracle']")


def test_batches_are_judged_alone(raw):
    line = "Jun 14 15:10:01 s sshd[1]: Failed password for root from 1.2.3.4 port 4 ssh2"
    lines = parsing.parse_ssh(raw([line] * 18)).withColumn("batch", F.col("line_key") % 2)
    assert line_rules.evaluate_rules(lines).count() == 1
    assert line_rules.evaluate_rules(lines, by=["batch"]).count() == 0


def test_line_rules_report_every_line(raw):
    line = '1.2.3.4 - - [04/Dec/2005:04:47:44 +0000] "GET /../etc/passwd HTTP/1.1" 200 1'
    found = line_rules.evaluate_rules(parsing.parse_apache(raw([line] * 30)), ["HTTP-003", "HTTP-006"])
    keys = {}
    for r in found.collect():
        keys.setdefault(r["rule_id"], []).append(r["first_key"])
    assert {k: sorted(v) for k, v in keys.items()} == {"HTTP-003": list(range(30)), "HTTP-006": list(range(30))}
    first = line_rules.first_alerts_of(found, "HTTP-003").collect()
    assert [r["first_key"] for r in first] == list(range(10))


def test_flood_of_lines_without_address(raw):
    line = "[Sun Dec 04 04:47:44 2005] [notice] ok"
    alert = line_rules.evaluate_rules(parsing.parse_apache(raw([line] * 120))).first()
    assert (alert["rule_id"], alert["source_ip"], alert["count"], alert["rule_score"]) == ("HTTP-005", None, 120, 0.6)
    assert alert["description"] == "IP None sent 120 requests (possible DDoS)"


def test_lookup_equals_a_plain_join(spark):
    """Hot, rare, unmatched and missing keys, with counted and with given weights."""
    keys = ["hot"] * 3000 + [None] * 500 + [f"k{n % 1700}" for n in range(4000)] + ["alone"] * 900
    facts = spark.createDataFrame(list(enumerate(keys)), "line_key bigint, k string")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(0, 1700, 3)], "k string, v int")
    want = sorted(facts.join(dim, "k", "left").select("line_key", "k", "v").collect(), key=lambda r: r[0])
    counted = lookup.lookup(facts, dim, "k").select("line_key", "k", "v")
    assert sorted(counted.collect(), key=lambda r: r[0]) == want
    weighted = lookup.count_keys(facts, "k", "n").join(dim, "k", "left")
    given = lookup.lookup(facts, weighted, "k", weight="n").select("line_key", "k", "v")
    assert sorted(given.collect(), key=lambda r: r[0]) == want


def test_ai_alerts_keep_lines_without_address(spark):
    scored = spark.createDataFrame(
        [(1, "1.1.1.1", 0.9, 1), (2, None, 0.9, 1), (3, "2.2.2.2", 0.9, 1), (4, None, 0.6, 1), (5, None, 0.9, 0)],
        "line_key bigint, ip string, anomaly_score double, if_pred int",
    ).withColumns({"raw": F.lit("x" * 200), "event_type": F.lit("unknown")})
    alerts = spark.createDataFrame([("1.1.1.1",)], "source_ip string")
    found = {r["first_key"]: r for r in fusion.ai_only_alerts(scored, alerts).collect()}
    assert set(found) == {2, 3}
    assert found[2]["source_ip"] == "unknown" and len(found[2]["sample_raw"]) == 120
    assert (found[2]["threat_score"], found[2]["severity"]) == (0.405, "MEDIUM")


def test_severity_comes_from_the_unrounded_score(spark):
    df = spark.createDataFrame([(0.79999, 0.79999)], "rule_score double, anomaly_score double")
    row = fusion.fuse(df).first()
    assert (row["threat_score"], row["severity"]) == (0.8, "HIGH")
