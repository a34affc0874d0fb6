"""Log lines derived from the ``events`` table, once as Spark columns and once as DuckDB SQL.

Each line text is one SQL expression that both engines read; only the time format differs.
The order key of a derived line is ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilog.sources.shared import spread

# Time formats as (Spark pattern, DuckDB pattern).
SYSLOG_TIME = ("MMM dd HH:mm:ss", "%b %d %H:%M:%S")
ACCESS_TIME = ("dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S")
ERROR_TIME = ("EEE MMM dd HH:mm:ss yyyy", "%a %b %d %H:%M:%S %Y")
HDFS_TIME = ("yyMMdd HHmmss", "%y%m%d %H%M%S")

USER = "(CASE WHEN user_id % 5 = 0 THEN 'root' ELSE 'u' || CAST(user_id % 7 AS STRING) END)"
SSH_IP = (
    "(CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || CAST(user_id AS STRING)"
    " ELSE '173.234.31.' || CAST(user_id % 25 AS STRING) END)"
)
WEB_IP = (
    "(CASE WHEN user_id % 4 = 0 THEN '10.1.0.' || CAST(user_id % 20 AS STRING)"
    " ELSE '172.20.0.' || CAST(user_id AS STRING) END)"
)
BLOCK = (
    "('blk_' || (CASE WHEN user_id % 2 = 0 THEN '-' ELSE '' END) || CAST(user_id * 1000 +"
    " event_id % (CASE WHEN user_id % 3 = 0 THEN 1 ELSE 30 END) AS STRING))"
)
NODE = (
    "(CASE WHEN user_id % 8 = 7 THEN 'R07-M1-N' || CAST(event_id % 500 AS STRING)"
    " ELSE 'R0' || CAST(user_id % 8 AS STRING) || '-M0-N0' END)"
)
CLUSTER_LABEL = "(CASE WHEN value > 60 AND event_type = 'error' THEN 'KERNDTLB' ELSE '-' END)"
BLOCK_ANOMALY_VALUE = 150

SSH_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'last message repeated ' || CAST(event_id % 7 AS STRING) || ' times'
ELSE {{{{syslog}}}} || ' host ' ||
 CASE WHEN event_id % 20 = 7 THEN 'sudo:   ' || {USER} || ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND='
   || CASE WHEN event_id % 3 = 0 THEN '/bin/cat /etc/shadow' ELSE '/usr/bin/id' END
 ELSE 'sshd[' || CAST(event_id AS STRING) || ']: ' ||
  CASE event_type
   WHEN 'error' THEN 'Failed password for ' || CASE WHEN user_id % 2 = 0 THEN 'invalid user ' ELSE '' END
     || {USER} || ' from ' || {SSH_IP} || ' port 22 ssh2'
   WHEN 'signup' THEN 'Invalid user ' || {USER} || ' from ' || {SSH_IP}
   WHEN 'click' THEN 'Accepted password for ' || {USER} || ' from ' || {SSH_IP} || ' port 22 ssh2'
   WHEN 'view' THEN CASE WHEN event_id % 10 = 3
     THEN 'Postponed publickey for ' || {USER} || ' from ' || {SSH_IP} || ' port 22 ssh2'
     ELSE 'Received disconnect from ' || {SSH_IP} || ': 11: Bye Bye' END
   ELSE CASE event_id % 4
     WHEN 0 THEN 'reverse mapping checking getaddrinfo for '
       || CASE WHEN user_id % 3 = 0 THEN 'localnode' ELSE 'ns.mar.com' END
       || ' [' || {SSH_IP} || '] failed - POSSIBLE BREAK-IN ATTEMPT!'
     WHEN 1 THEN 'Did not receive identification string from ' || {SSH_IP}
     WHEN 2 THEN 'fatal: Read from socket failed'
     ELSE 'pam_unix(sshd:session): session opened for user ' || {USER} || ' by (uid=0)' END
  END
 END
END"""

APACHE_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'child exited ' || CAST(event_id AS STRING)
WHEN user_id % 10 = 9 THEN '[' || {{{{error}}}} || '] [' ||
  CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'notice' WHEN 2 THEN 'warn' WHEN 3 THEN 'crit'
    ELSE 'info' END || '] ' ||
  CASE WHEN event_id % 3 = 0 THEN 'client denied by server configuration' ELSE 'workerEnv.init() ok' END
ELSE {WEB_IP} || ' - - [' || {{{{access}}}} || ' +0000] "' ||
  CASE WHEN event_id % 9 = 0 THEN 'POST ' ELSE 'GET ' END ||
  CASE event_id % 16 WHEN 0 THEN '/Search?q=1+UNION+select+x' WHEN 1 THEN '/p?x=<script>alert(1)'
    WHEN 2 THEN '/../../etc/passwd' WHEN 3 THEN '/.env' WHEN 4 THEN '/wp-config.php.bak'
    ELSE '/index.html' END || ' HTTP/1.1" ' ||
  CASE event_type WHEN 'error' THEN '404' WHEN 'signup' THEN '500' ELSE '200' END || ' 512 "-" "' ||
  CASE WHEN event_id % 50 = 5 THEN 'sqlmap/1.5' WHEN event_id % 50 = 6 THEN 'Nikto/2.1'
    ELSE 'Mozilla/5.0' END || '"'
END"""

LINUX_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'corrupted entry'
ELSE {{{{syslog}}}} || ' combo ' ||
 CASE event_type
  WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'kernel: oom-killer invoked for task'
    ELSE 'ftpd[123]: connection failed from ' || {SSH_IP} END
  WHEN 'view' THEN 'Kernel: eth0 link up'
  WHEN 'click' THEN 'crond[12]: (root) CMD (run-parts)'
  WHEN 'signup' THEN 'sshd[11]: Failed password for ' || {USER} || ' from ' || {SSH_IP} || ' port 22 ssh2'
  ELSE CASE WHEN event_id % 2 = 0
    THEN 'sshd(pam_unix)[11]: authentication failure; logname= uid=0 rhost=' || {SSH_IP}
    ELSE 'su(pam_unix)[1]: session opened for user ' || {USER} || ' by (uid=0)' END
 END
END"""

HDFS_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'malformed line'
ELSE {{{{hdfs}}}} || ' ' || CAST(event_id % 300 AS STRING) || ' ' ||
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'WARN'
   WHEN event_type = 'error' AND event_id % 10 = 1 THEN 'ERROR' ELSE 'INFO' END || ' ' ||
 CASE event_id % 4 WHEN 0 THEN 'dfs.DataNode$DataXceiver' WHEN 1 THEN 'dfs.FSNamesystem'
   WHEN 2 THEN 'dfs.NameNode' ELSE 'org.DFSClient' END || ': ' ||
 CASE event_type
  WHEN 'click' THEN 'Receiving block ' || {BLOCK} || ' src: /10.0.0.1 size ' || CAST(event_id * 7 AS STRING)
  WHEN 'view' THEN 'Served block ' || {BLOCK} || ' to /10.0.0.' || CAST(event_id % 9 AS STRING)
  WHEN 'signup' THEN 'ask 10.0.0.1 to replicate ' || {BLOCK}
  WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'WARN dfs.DataNode slow dfs.FSNamesystem ' || {BLOCK}
    ELSE 'Deleting block ' || {BLOCK} || ' file /x' END
  ELSE CASE event_id % 5 WHEN 0 THEN 'PacketResponder 1 for ' || {BLOCK} || ' Exception java.io.IOException'
    WHEN 1 THEN 'writeBlock ' || {BLOCK} || ' received failed'
    WHEN 2 THEN 'Got exception while serving ' || {BLOCK}
    WHEN 3 THEN 'Served block ' || {BLOCK} || ' ok'
    ELSE 'java.io.IOException: Connection reset by peer' END
 END
END"""

BGL_CONTENT = """(CASE WHEN event_id % 89 = 0 THEN ''
WHEN value <= 80 THEN ' generating core.' || CAST(event_id % 40 AS STRING)
ELSE CASE event_id % 6 WHEN 0 THEN ' data TLB error interrupt' WHEN 1 THEN ' ciod: Error loading /x'
  WHEN 2 THEN ' machine check on R01-M0-N1' WHEN 3 THEN ' KERNEL FATAL ecc error'
  WHEN 4 THEN ' DISCOVERY WARNING link down' ELSE ' APP FATAL ib_sm cannot, timeout' END END)"""
BGL_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'broken line ' || CAST(event_id AS STRING)
ELSE {CLUSTER_LABEL} || ' ' || CAST(1117838570 + event_id AS STRING) || ' 2005.06.03 ' || {NODE}
  || ' 2005-06-03-15.42.50.363779 ' || {NODE} || ' RAS  KERNEL ' ||
  CASE WHEN value > 80 THEN 'FATAL' ELSE 'INFO' END || {BGL_CONTENT}
END"""

THUNDERBIRD_CONTENT = """(CASE WHEN value <= 80 THEN 'crond(pam_unix)[' || CAST(event_id % 40 AS STRING)
  || ']: session opened for user root'
ELSE CASE event_id % 7 WHEN 0 THEN 'kernel: parity error on memory bank' WHEN 1 THEN 'ib_sm.x: error'
  WHEN 2 THEN 'kernel: link down' WHEN 3 THEN 'sshd[4]: FATAL crash' WHEN 4 THEN 'ntpd: warning drift'
  WHEN 5 THEN 'gmetad: server not answer, connection refused' ELSE 'sendmail: timeout' END END)"""
THUNDERBIRD_LINE = f"""
CASE WHEN event_id % 97 = 0 THEN 'broken line ' || CAST(event_id AS STRING)
ELSE {CLUSTER_LABEL} || ' ' || CAST(1131566461 + event_id AS STRING) || ' 2005.11.09 ' || {NODE}
  || ' Nov 9 12:01:01 local@tbird ' || {THUNDERBIRD_CONTENT}
END"""

LINES = {
    "ssh": SSH_LINE,
    "apache": APACHE_LINE,
    "linux": LINUX_LINE,
    "hdfs": HDFS_LINE,
    "bgl": BGL_LINE,
    "thunderbird": THUNDERBIRD_LINE,
}
_TIMES = {
    "syslog": SYSLOG_TIME, "access": ACCESS_TIME, "error": ERROR_TIME, "hdfs": HDFS_TIME,
}


def _fill(text: str, engine: int) -> str:
    call = ("date_format(ts, '{}')", "strftime(ts, '{}')")[engine]
    for name, patterns in _TIMES.items():
        text = text.replace("{{" + name + "}}", call.format(patterns[engine]))
    return text


def duck_line(kind: str) -> str:
    """DuckDB expression of the line text."""
    return _fill(LINES[kind], 1).replace("AS STRING", "AS VARCHAR")


def raw_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``line_key``, ``value``, ``raw`` and the columns some queries need, from ``events``."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
    return events.selectExpr("event_id AS line_key", "value", f"{_fill(LINES[kind], 0)} AS raw")


def block_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest value per block, without the blocks of some users: the base of block labels."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .filter("user_id % 11 <> 0")
        .selectExpr(f"{BLOCK} AS block_id", "value")
        .groupBy("block_id")
        .agg({"value": "max"})
        .withColumnRenamed("max(value)", "top_value")
    )
