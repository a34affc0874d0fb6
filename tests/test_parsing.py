"""Hand-made lines with known results, and the peculiarities that must be kept."""

from pyspark.sql import functions as F

from vigilog.functions import fixed_values as fv
from vigilog.functions.scoring import is_external, severity
from vigilog.operators import parsing


def one(df):
    return df.first().asDict()


def test_brute_force_session(raw):
    lines = []
    for n in range(12):
        lines.append(f"Jun 14 15:10:{n:02d} srv sshd[{n}]: Failed password for root from 192.168.1.100 port 4 ssh2")
        lines.append(f"Jun 14 15:10:{n:02d} srv sshd[{n}]: Connection closed by 192.168.1.100 port 4 [preauth]")
    parsed = parsing.parse_ssh(raw(lines[:-1]))
    counts = {r["event_type"]: r["count"] for r in parsed.groupBy("event_type").count().collect()}
    assert counts == {"failed_password": 12, "disconnect": 11}
    assert {r["ip"] for r in parsed.select("ip").distinct().collect()} == {"192.168.1.100"}


def test_failed_password_for_an_invalid_user_is_not_invalid_user(raw):
    row = one(parsing.parse_ssh(raw(
        ["Dec 10 06:55:46 h sshd[1]: Failed password for invalid user web from 173.234.31.186 port 3 ssh2"])))
    assert (row["event_type"], row["user"], row["ip"]) == ("failed_password", "web", "173.234.31.186")


def test_break_in_takes_the_first_dot_of_a_host_name(raw):
    line = ("Dec 10 06:55:46 h sshd[1]: reverse mapping checking getaddrinfo for ns.mar.com "
            "[173.234.31.186] failed - POSSIBLE BREAK-IN ATTEMPT!")
    assert one(parsing.parse_ssh(raw([line])))["ip"] == "."
    assert one(parsing.parse_ssh(raw([line]), fixed=True))["ip"] == "173.234.31.186"


def test_disconnect_takes_digits_of_a_user_name(raw):
    line = "Dec 10 06:55:46 h sshd[1]: Connection closed by invalid user user9x 103.45.67.89 port 1 [preauth]"
    assert one(parsing.parse_ssh(raw([line])))["ip"] == "9"


def test_unicode_spaces_and_letters(raw):
    line = "Déc 10 06:55:46 h sshd[1]: Invalid user rené from 1.2.3.4"
    row = one(parsing.parse_ssh(raw([line])))
    assert (row["event_type"], row["user"], row["timestamp"]) == ("invalid_user", "rené", "Déc 10 06:55:46")


def test_sudo_and_session(raw):
    sudo = "Dec 10 06:55:46 h sudo:   bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /etc/shadow"
    pam = "Dec 10 06:55:46 h sshd[1]: pam_unix(sshd:session): session opened for user amy by (uid=0)"
    rows = parsing.with_extras(parsing.parse_ssh(raw([sudo, pam]))).orderBy("line_key").collect()
    assert rows[0]["event_type"] == "sudo_command" and rows[0]["extras"] == {"command": "/bin/cat /etc/shadow"}
    assert rows[1]["event_type"] == "session_event" and rows[1]["extras"] == {"action": "opened"}
    assert rows[1]["user"] == "amy" and rows[1]["ip"] is None


def test_hdfs_classes(raw):
    rows = parsing.parse_hdfs(raw([
        "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-16 src: /10.2.1.1:5 dest: /10.2.1.1:5",
        "081109 203518 35 INFO dfs.FSNamesystem: BLOCK* NameSystem.addStoredBlock blk_-16 size 67108864",
        "081109 203519 144 WARN dfs.DataNode$DataXceiver: 10.2.1.1:5:Got exception while serving blk_-16 to /10.1.2.9:",
        "not a line",
    ])).orderBy("line_key").collect()
    assert [r["event_type"] for r in rows] == ["hdfs_datanode", "hdfs_general", "hdfs_anomaly", "unknown"]
    assert [r["block_id"] for r in rows] == ["-16", "-16", "-16", None]
    assert rows[2]["template"] == "HDFS WARN <COMPONENT>: <ANOMALY_MSG>"
    assert rows[0]["timestamp"] == "081109 203518"


def test_apache_forms(raw):
    rows = parsing.parse_apache(raw([
        "[Sun Dec 04 04:47:44 2005] [notice] workerEnv.init() ok",
        "[Sun Dec 04 04:47:44 2005] [warn] client denied by server",
        "[Sun Dec 04 04:47:44 2005] [crit] access to nowhere",
        '1.2.3.4 - - [04/Dec/2005:04:47:44 +0000] "GET /A?Q=1 HTTP/1.1" 404 12 "-" "Nikto/2"',
        "nothing",
    ]), fixed=True).orderBy("line_key").collect()
    assert [r["event_type"] for r in rows] == [
        "apache_notice", "apache_access_denied", "apache_error", "http_get", "unknown"]
    assert (rows[3]["path"], rows[3]["status_code"], rows[3]["user_agent"]) == ("/a?q=1", 404, "Nikto/2")
    assert rows[3]["template"] == "HTTP GET <PATH> 404"


def test_syslog_hands_sshd_over(raw):
    rows = parsing.parse_linux(raw([
        "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; rhost=1.2.3.4",
        "Jun 14 15:16:01 combo SSHD[1]: Failed password for root from 1.2.3.4 port 1 ssh2",
        "Jun 14 15:16:01 combo sshd[1]: Failed password for root from 1.2.3.4 port 1 ssh2",
        "Jun 14 15:16:01 combo Kernel: link up",
        "Jun 14 15:16:01 combo ftpd[7]: connection refused, access denied",
    ])).orderBy("line_key").collect()
    assert [(r["source"], r["event_type"]) for r in rows] == [
        ("ssh", "unknown"), ("ssh", "unknown"), ("ssh", "failed_password"),
        ("linux", "kernel_event"), ("linux", "linux_error")]
    assert rows[3]["template"] == "Linux kernel: <MSG>"


def test_cluster_lines_keep_the_rest_of_the_line(raw):
    rows = parsing.parse_bgl(raw([
        "- 1 2005.06.03 R02-M1 2005-06-03 R02-M1 RAS  KERNEL INFO instruction  cache   parity",
        "APPREAD 1 2 R1 4 5 6 7 FATAL",
        "- 1 2 3 4 5 6 7",
    ])).orderBy("line_key").collect()
    assert [(r["label"], r["level"], r["content"]) for r in rows] == [
        (0, "INFO", "instruction  cache   parity"), (1, "FATAL", "")]


def test_parsing_does_not_shuffle_and_keeps_conditions_above_it(raw):
    df = parsing.parse_ssh(raw(["x"])).filter((F.col("ip") == "1.2.3.4") & (F.col("user") == "root"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    # One test and one rewrite per pattern, wherever the columns are used.
    assert plan.count("regexp_replace") <= len(fv.SSH_PATTERNS) * 2


def test_private_addresses(spark):
    ips = ["192.168.0.1", "10.1.1.1", "172.16.9.9", "172.17.0.1", "127.0.0.1", "8.8.8.8", "", "unknown", None]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select(is_external(F.col("ip"))).collect()
    assert [r[0] for r in rows] == [False, False, False, True, False, True, False, False, False]


def test_severity_edges(spark):
    scores = [0.8, 0.7999999999999999, 0.6, 0.4, 0.2, 0.19]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(severity(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "NORMAL"]
