"""Parts of the DuckDB oracles: named common table expressions over ``events``."""

from __future__ import annotations

import re

from vigilog.functions import fixed_values as fv

from .derived import BLOCK, BLOCK_ANOMALY_VALUE, duck_line

PARSED = {
    "source": "VARCHAR", "timestamp": "VARCHAR", "ip": "VARCHAR", "user": "VARCHAR",
    "event_type": "VARCHAR", "path": "VARCHAR", "status_code": "INTEGER", "method": "VARCHAR",
    "user_agent": "VARCHAR", "log_level": "VARCHAR", "component": "VARCHAR",
    "template": "VARCHAR", "command": "VARCHAR", "action": "VARCHAR", "message": "VARCHAR",
    "block_id": "VARCHAR",
}
PARSED_LIST = ", ".join(f'"{c}"' for c in PARSED)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def found(column: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({column}, {text(pattern)}, {group}), '')"


def hit(column: str, pattern: str, ignore_case: bool = False) -> str:
    prefix = "(?i)" if ignore_case else ""
    return f"regexp_matches({column}, {text(prefix + pattern)})"


def any_word(column: str, words) -> str:
    tests = " OR ".join(f"contains({column}, {text(w)})" for w in words)
    return f"coalesce({tests}, false)"


def external(column: str) -> str:
    private = " OR ".join(f"starts_with({column}, {text(p)})" for p in fv.PRIVATE_PREFIXES)
    return (
        f"coalesce({column} <> '' AND {column} <> 'unknown' AND NOT ({private}"
        f" OR {column} = {text(fv.LOOPBACK)}), false)"
    )


def severity(score: str) -> str:
    cases = " ".join(f"WHEN {score} >= {num(edge)} THEN '{name}'" for name, edge in fv.SEVERITY_BANDS)
    return f"CASE {cases} ELSE 'NORMAL' END"


def threat(rule: str, anomaly: str, alpha: float) -> str:
    return f"({num(alpha)} * {rule} + {num(1 - alpha)} * {anomaly})"


def fused(rule: str, anomaly: str, alpha: float) -> str:
    score = threat(rule, anomaly, alpha)
    return (
        f"round({rule}, 4) AS rule_score, round({anomaly}, 4) AS anomaly_score,"
        f" round({score}, 4) AS threat_score, {severity(score)} AS severity, {num(alpha)} AS alpha"
    )


def ratio(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) > 0 THEN ({part}) / ({whole}) ELSE 0.0::DOUBLE END)"


QUALITY = (
    f"{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,"
    f" {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {ratio('fp', 'fp + tn')} AS fpr"
)
QUALITY_ROUNDED = (
    f"round({ratio('tp', 'tp + fp')}, 4) AS precision, round({ratio('tp', 'tp + fn')}, 4) AS recall,"
    f" round({ratio('2 * tp', '2 * tp + fp + fn')}, 4) AS f1, round({ratio('fp', 'fp + tn')}, 4) AS fpr"
)


def cells(label: str, pred: str) -> str:
    return (
        f"count(*) FILTER ({label} = 1 AND {pred} = 1) AS tp,"
        f" count(*) FILTER ({label} = 0 AND {pred} = 1) AS fp,"
        f" count(*) FILTER ({label} = 0 AND {pred} = 0) AS tn,"
        f" count(*) FILTER ({label} = 1 AND {pred} = 0) AS fn"
    )


def parsed_select(source: str, columns: dict[str, str], kept: str = "line_key, value, raw") -> str:
    chosen = ", ".join(
        f'CAST({columns.get(name, "NULL")} AS {kind}) AS "{name}"' for name, kind in PARSED.items()
    )
    return f"SELECT {kept}, {chosen} FROM {source}"


def ssh_kind(column: str = "raw") -> str:
    cases = " ".join(f"WHEN {hit(column, p.pattern)} THEN {n}" for n, p in enumerate(fv.SSH_PATTERNS))
    return f"CASE {cases} ELSE -1 END"


def ssh_columns(fixed: bool = False) -> dict[str, str]:
    def pick(values: dict[int, str], default: str | None = None) -> str:
        cases = " ".join(f"WHEN {n} THEN {v}" for n, v in values.items())
        return f"CASE kind {cases}" + (f" ELSE {default}" if default else "") + " END"

    numbered = list(enumerate(fv.SSH_PATTERNS))
    columns = {
        "event_type": pick({n: text(p.event_type) for n, p in numbered}, "'unknown'"),
        "template": pick({n: text(p.template) for n, p in numbered}, "'UNKNOWN_SSH_EVENT'"),
    }
    for name in ("timestamp", "user", "ip", "command", "action", "message"):
        values = {n: found("raw", p.pattern, p.groups[name]) for n, p in numbered if name in p.groups}
        if fixed and name == "ip":
            values[4] = f"coalesce({found('raw', fv.SSH_BREAK_IN_ADDRESS, 1)}, {values[4]})"
        columns[name] = pick(values)
    return columns


_HDFS_ANOMALY = f"upper(level) IN ('ERROR', 'WARN') OR {any_word('lower(msg)', fv.HDFS_PARSER_WORDS)}"


def _hdfs_case(anomaly: str, values: list[str], unknown: str) -> str:
    namenode, datanode, client, general = (text(v) for v in values)
    return (
        f"CASE WHEN msg IS NULL THEN {text(unknown)} WHEN {_HDFS_ANOMALY} THEN {anomaly}"
        f" WHEN contains(lower(comp), 'namenode') THEN {namenode}"
        f" WHEN contains(lower(comp), 'datanode') THEN {datanode}"
        f" WHEN contains(lower(comp), 'client') THEN {client} ELSE {general} END"
    )


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
#: Expressions that are read several times and costly to make.
KEPT: set[str] = set()


def cte(name: str, body: str, *needs: str, keep: bool = False) -> None:
    CTES[name] = (body, needs)
    if keep:
        KEPT.add(name)


def sql(select: str, *needs: str) -> str:
    """A query with the named expressions, and those they need, in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][1]:
                visit(need)
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return select
    recursive = any(re.search(rf"\b{n}\b", CTES[n][0]) for n in ordered)
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({CTES[n][0]})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{select}"


for _kind in ("ssh", "apache", "linux", "hdfs", "bgl", "thunderbird"):
    cte(f"{_kind}_raw", f"SELECT event_id AS line_key, value, {duck_line(_kind)} AS raw FROM events")

cte("ssh_kinds", f"SELECT *, {ssh_kind()} AS kind FROM ssh_raw", "ssh_raw")
cte("ssh", parsed_select("ssh_kinds", {"source": "'ssh'", **ssh_columns()}), "ssh_kinds")
cte("ssh_fixed", parsed_select("ssh_kinds", {"source": "'ssh'", **ssh_columns(True)}), "ssh_kinds")

cte(
    "hdfs_parts",
    f"SELECT *, {found('raw', fv.HDFS_LINE, 6)} AS msg, {found('raw', fv.HDFS_LINE, 4)} AS level,"
    f" {found('raw', fv.HDFS_LINE, 5)} AS comp FROM hdfs_raw",
    "hdfs_raw",
)
cte(
    "hdfs",
    parsed_select(
        "hdfs_parts",
        {
            "source": "'hdfs'",
            "timestamp": f"CASE WHEN msg IS NOT NULL THEN {found('raw', fv.HDFS_LINE, 1)} || ' ' ||"
            f" {found('raw', fv.HDFS_LINE, 2)} END",
            "log_level": "level",
            "component": "comp",
            "block_id": found("msg", fv.HDFS_BLOCK_NUMBER, 1),
            "event_type": _hdfs_case(
                "'hdfs_anomaly'",
                ["hdfs_namenode", "hdfs_datanode", "hdfs_client", "hdfs_general"], "unknown",
            ),
            "template": _hdfs_case(
                "'HDFS ' || upper(level) || ' <COMPONENT>: <ANOMALY_MSG>'",
                ["HDFS NameNode: <MSG>", "HDFS DataNode: <MSG>", "HDFS Client: <MSG>",
                 "HDFS <COMPONENT>: <MSG>"],
                "UNKNOWN_HDFS_LINE",
            ),
        },
    ),
    "hdfs_parts",
)

_AGENT = r'"[^"]*"\s+"([^"]*)"\s*$'
cte(
    "apache_parts",
    f"SELECT *, {found('raw', fv.APACHE_ERROR_LINE, 3)} AS msg,"
    f" {found('raw', fv.APACHE_ERROR_LINE, 2)} AS level,"
    f" {found('raw', fv.APACHE_ACCESS_LINE, 5)} AS status,"
    f" {found('raw', fv.APACHE_ACCESS_LINE, 3)} AS verb FROM apache_raw",
    "apache_raw",
)


def apache_columns(fixed: bool = False) -> dict[str, str]:
    access = "msg IS NULL AND status IS NOT NULL"
    return {
        "source": "'apache'",
        "timestamp": f"CASE WHEN msg IS NOT NULL THEN {found('raw', fv.APACHE_ERROR_LINE, 1)}"
        f" WHEN {access} THEN {found('raw', fv.APACHE_ACCESS_LINE, 2)} END",
        "log_level": "level",
        "ip": f"CASE WHEN {access} THEN {found('raw', fv.APACHE_ACCESS_LINE, 1)} END",
        "method": f"CASE WHEN {access} THEN verb END",
        "path": f"CASE WHEN {access} THEN lower({found('raw', fv.APACHE_ACCESS_LINE, 4)}) END",
        "status_code": f"CASE WHEN {access} THEN status END",
        "user_agent": f"CASE WHEN {access} THEN {found('raw', _AGENT, 1)} END" if fixed else "NULL",
        "event_type": "CASE WHEN msg IS NOT NULL AND level IN ('error', 'crit', 'alert', 'emerg')"
        " THEN 'apache_error' WHEN msg IS NOT NULL AND (contains(lower(msg), 'access') OR"
        " contains(lower(msg), 'denied')) THEN 'apache_access_denied'"
        " WHEN msg IS NOT NULL THEN 'apache_' || level"
        f" WHEN {access} THEN 'http_' || lower(verb) ELSE 'unknown' END",
        "template": "CASE WHEN msg IS NOT NULL THEN 'Apache [' || upper(level) || '] <MSG>'"
        f" WHEN {access} THEN 'HTTP ' || verb || ' <PATH> ' || CAST(CAST(status AS INTEGER) AS VARCHAR)"
        " ELSE 'UNKNOWN_APACHE_LINE' END",
    }


cte("apache", parsed_select("apache_parts", apache_columns()), "apache_parts")
cte("apache_fixed", parsed_select("apache_parts", apache_columns(True)), "apache_parts")

cte(
    "linux_parts",
    f"SELECT *, {found('raw', fv.LINUX_LINE, 5)} AS msg, lower({found('raw', fv.LINUX_LINE, 3)}) AS proc,"
    f" {found('raw', fv.LINUX_LINE, 1)} AS ts, {ssh_kind()} AS kind FROM linux_raw",
    "linux_raw",
)


def linux_columns() -> dict[str, str]:
    sshd = "msg IS NOT NULL AND contains(proc, 'sshd')"
    own = {
        "event_type": "CASE WHEN msg IS NULL THEN 'unknown'"
        f" WHEN {any_word('lower(msg)', fv.LINUX_ERROR_WORDS)} THEN 'linux_error'"
        " WHEN contains(proc, 'kernel') THEN 'kernel_event' ELSE 'linux_general' END",
        "template": "CASE WHEN msg IS NULL THEN 'UNKNOWN_LINUX_EVENT' ELSE 'Linux ' || proc || ': <MSG>' END",
        "timestamp": "CASE WHEN msg IS NOT NULL THEN ts END",
    }
    columns = {
        name: f"CASE WHEN {sshd} THEN {value} ELSE {own.get(name, 'NULL')} END"
        for name, value in ssh_columns().items()
    }
    return {"source": f"CASE WHEN {sshd} THEN 'ssh' ELSE 'linux' END", **columns}


cte("linux", parsed_select("linux_parts", linux_columns()), "linux_parts")

_PARSERS = {
    "ssh": ("ssh_kinds", "ssh"), "hdfs": ("hdfs_parts", "hdfs"),
    "apache": ("apache_parts", "apache"), "linux": ("linux_parts", "linux"),
}


def parse_as(kind: str, prefix: str) -> None:
    """Expression ``{prefix}{kind}``: the lines of ``{prefix}{kind}_raw`` parsed as a kind."""
    for name in _PARSERS[kind]:
        body, needs = CTES[name]
        for need in needs:
            body = body.replace(f"FROM {need}", f"FROM {prefix}{need}")
        cte(f"{prefix}{name}", body, *[f"{prefix}{need}" for need in needs])


def detected_type(column: str) -> str:
    """Format of the first lines joined to one text."""
    return (
        f"CASE WHEN {any_word(f'lower({column})', fv.DETECT_SSH_WORDS)} THEN 'ssh' WHEN {hit(column, fv.DETECT_HDFS)}"
        f" THEN 'hdfs' WHEN {hit(column, fv.DETECT_APACHE)} THEN 'apache' ELSE 'linux' END"
    )


# --- labels -----------------------------------------------------------------------------
cte(
    "ssh_labels",
    f"""SELECT l.*, CAST(CASE WHEN f.ip IS NOT NULL OR event_type = 'break_in_attempt'
      OR (event_type = 'no_identification' AND {external('l.ip')})
      OR (event_type = 'accepted_login' AND "user" = 'root' AND {external('l.ip')})
      OR (event_type = 'ssh_error' AND {external('l.ip')}) THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM ssh l LEFT JOIN (SELECT ip FROM ssh WHERE ip IS NOT NULL GROUP BY ip
      HAVING count(*) FILTER (event_type = 'failed_password') >= {fv.LABEL_FAILED_PASSWORDS}
        OR count(*) FILTER (event_type = 'invalid_user') >= {fv.LABEL_INVALID_USERS}) f ON l.ip = f.ip""",
    "ssh",
)
cte(
    "apache_labels",
    f"""SELECT l.*, CAST(CASE WHEN
      {any_word('path', fv.LABEL_SQLI_WORDS + fv.LABEL_XSS_WORDS + fv.LABEL_PATH_WORDS)}
      OR {any_word('lower(user_agent)', fv.LABEL_SCANNER_WORDS)}
      OR f.ip IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM apache l LEFT JOIN (SELECT ip FROM apache WHERE ip IS NOT NULL GROUP BY ip
      HAVING count(*) >= {fv.LABEL_FLOOD_REQUESTS}) f ON l.ip = f.ip""",
    "apache",
)
_LINUX_EVENTS = ", ".join(text(e) for e in fv.LABEL_LINUX_EVENTS)
cte(
    "linux_labels",
    f"""SELECT *, CAST(event_type IN ({_LINUX_EVENTS}) OR {any_word('lower(raw)', fv.LABEL_LINUX_WORDS)}
      AS INTEGER) AS label FROM linux""",
    "linux",
)
# Block labels with 'blk_' kept; the line parser gives block numbers without it.
cte(
    "block_labels",
    f"""SELECT block_id, CAST(max(value) > {BLOCK_ANOMALY_VALUE} AS INTEGER) AS label FROM
      (SELECT {BLOCK.replace('AS STRING', 'AS VARCHAR')} AS block_id, value FROM events
       WHERE user_id % 11 <> 0) GROUP BY block_id""",
)
cte(
    "hdfs_labels",
    "SELECT l.*, coalesce(b.label, 0) AS label FROM hdfs l LEFT JOIN block_labels b"
    " ON 'blk_' || l.block_id = b.block_id",
    "hdfs", "block_labels",
)
_PARTS = [("ssh", 0), ("hdfs", 1), ("apache", 2), ("linux", 3)]
cte(
    "all_logs",
    " UNION ALL ".join(
        f"SELECT line_key * 4 + {n} AS line_key, value, raw, {PARSED_LIST}, label, '{s}' AS dataset"
        f" FROM {s}_labels"
        for s, n in _PARTS
    ),
    *[f"{s}_labels" for s, _ in _PARTS],
)

# --- per-line features ------------------------------------------------------------------
_FLAGS = {
    "is_ssh": "source = 'ssh'", "is_hdfs": "source = 'hdfs'", "is_apache": "source = 'apache'",
    "is_linux": "source = 'linux'", "is_failed_pw": "event_type = 'failed_password'",
    "is_invalid_user": "event_type = 'invalid_user'", "is_accepted": "event_type = 'accepted_login'",
    "is_sudo": "event_type = 'sudo_command'", "is_session": "event_type = 'session_event'",
    "is_break_in": "event_type = 'break_in_attempt'", "is_no_ident": "event_type = 'no_identification'",
    "is_ssh_error": "event_type = 'ssh_error'",
    "is_root_user": "\"user\" IN ('root', 'admin', 'administrator')",
    "is_external_ip": external("ip"),
    "is_susp_sudo": f"event_type = 'sudo_command' AND {any_word('lower(command)', fv.FEATURE_SUDO_WORDS)}",
    "is_hdfs_anomaly": "event_type = 'hdfs_anomaly'", "is_hdfs_error": "log_level IN ('ERROR', 'WARN')",
    "hdfs_kw_hit": f"source = 'hdfs' AND {any_word('lower(raw)', fv.FEATURE_HDFS_WORDS)}",
    "is_4xx": "status_code BETWEEN 400 AND 499", "is_5xx": "status_code >= 500",
    "is_sqli": any_word("path", fv.FEATURE_SQLI_WORDS), "is_xss": any_word("path", fv.FEATURE_XSS_WORDS),
    "is_susp_path": any_word("path", fv.FEATURE_PATH_WORDS),
    "is_scanner_ua": any_word("lower(user_agent)", fv.FEATURE_SCANNER_WORDS),
    "is_brute_signal": any_word("lower(raw)", fv.FEATURE_BRUTE_WORDS),
    "is_unknown": "event_type = 'unknown'",
}
LINE_FLAGS = ", ".join(f"CAST(coalesce({t}, false) AS INTEGER) AS {n}" for n, t in _FLAGS.items())
cte(
    "per_ip",
    """SELECT ip, count(*) AS n, count(*) FILTER (event_type IN ('failed_password', 'invalid_user')) AS f
    FROM all_logs WHERE ip IS NOT NULL GROUP BY ip""",
    "all_logs",
)
BURST = (
    "coalesce(n, 0) AS ip_total_count, coalesce(f, 0) AS ip_fail_count,"
    " round(coalesce(n, 0) / (SELECT count(*) FROM all_logs), 6) AS ip_freq_norm,"
    " round(coalesce(f, 0) / (SELECT count(*) FROM all_logs), 6) AS ip_fail_norm"
)

# --- rules over lines -------------------------------------------------------------------
ALERT_LIST = (
    "rule_ord, first_key, rule_id, rule_name, description, severity, source_ip, count,"
    " rule_score, sample_raw"
)


def rule_selects(table: str, fixed: bool = False, by: str | None = None) -> dict[str, str]:
    """One select per rule over a table of parsed lines, which ``by`` cuts into batches."""
    own = f"{by}, " if by else ""
    ssh, apache = "source IN ('auth', 'ssh', 'linux')", "source = 'apache'"
    order = {r.rule_id: n for n, r in enumerate(fv.LINE_RULES)}
    meta = {r.rule_id: r for r in fv.LINE_RULES}
    who = "coalesce(ip, 'None')"

    def alert(rule: str, where: str, need: int, description: str, score: str,
              sample: str = "arg_min(raw, line_key)", sev: str | None = None,
              count: str = "count(*)") -> str:
        r = meta[rule]
        return (
            f"SELECT {own}CAST({order[rule]} AS INTEGER) AS rule_ord, min(line_key) AS first_key,"
            f" '{rule}' AS rule_id, '{r.name}' AS rule_name, {description} AS description,"
            f" {sev or text(r.severity)} AS severity, ip AS source_ip, {count} AS count,"
            f" {score} AS rule_score, {sample} AS sample_raw FROM {table}"
            f" WHERE {where} GROUP BY {own}ip HAVING {count} >= {need}"
        )

    def line(rule: str, where: str, description: str, score: float, ip: str = "ip") -> str:
        r = meta[rule]
        return (
            f"SELECT {own}CAST({order[rule]} AS INTEGER) AS rule_ord, line_key AS first_key,"
            f" '{rule}' AS rule_id, '{r.name}' AS rule_name, {description} AS description,"
            f" '{r.severity}' AS severity, {ip} AS source_ip, CAST(1 AS BIGINT) AS count,"
            f" {num(score)} AS rule_score, raw AS sample_raw FROM {table} WHERE {where}"
        )

    sqli = any_word("path", fv.FEATURE_SQLI_WORDS) if fixed else "event_type = 'sql_injection_attempt'"
    xss = any_word("path", fv.FEATURE_XSS_WORDS) if fixed else "event_type = 'xss_attempt'"
    scanners = fv.RULE_SCANNER_WORDS
    first_agent = "lower(arg_min(user_agent, line_key))"
    scanner = "CASE " + " ".join(
        f"WHEN contains({first_agent}, '{w}') THEN '{w}'" for w in scanners
    ) + " ELSE 'scanner' END"
    path60 = "substring(arg_min(path, line_key), 1, 60)"
    users = "count(DISTINCT \"user\")"
    one = num(1.0)
    accepted = "accepted_login" if fixed else "accepted_password"
    return {
        "AUTH-001": alert(
            "AUTH-001", f"{ssh} AND event_type = 'failed_password'", 10,
            f"'IP ' || {who} || ' made ' || count(*) || ' failed SSH login attempts'",
            f"least({one}, {num(0.8)} + (count(*) - 10) * {num(0.02)})"),
        "AUTH-002": alert(
            "AUTH-002", f"{ssh} AND event_type = 'invalid_user'", 5,
            f"'IP ' || {who} || ' probed ' || count(*) || ' invalid usernames'",
            f"least({one}, {num(0.75)} + (count(*) - 5) * {num(0.05)})"),
        "AUTH-003": line(
            "AUTH-003", f"{ssh} AND event_type = '{accepted}' AND \"user\" = 'root' AND {external('ip')}",
            f"'Root login accepted from external IP ' || {who}", 1.0),
        "AUTH-004": line(
            "AUTH-004", f"{ssh} AND event_type = 'sudo_command' AND {any_word('command', fv.RULE_SUDO_WORDS)}",
            "'User ' || coalesce(\"user\", 'None') || ' ran sensitive sudo: ' || substring(command, 1, 60)",
            0.85, "coalesce(nullif(ip, ''), 'localhost')"),
        "AUTH-005": alert(
            "AUTH-005", f"{ssh} AND event_type IN ('failed_password', 'invalid_user') AND \"user\" <> '' AND ip <> ''",
            4, f"'IP ' || {who} || ' tried ' || {users} || ' different usernames: [''' ||"
            " array_to_string(list_slice(list_sort(list_distinct(list(\"user\"))), 1, 5), ''', ''') || ''']'",
            f"least({one}, {num(0.7)} + ({users} - 4) * {num(0.05)})", "''", count=users),
        "HTTP-001": alert(
            "HTTP-001", f"{apache} AND {sqli}", 1,
            f"'IP ' || {who} || ' made ' || count(*) || ' SQLi attempts. Sample: ' || {path60}",
            f"least({one}, {num(0.7)} + count(*) * {num(0.01)})",
            sev="CASE WHEN count(*) > 5 THEN 'CRITICAL' ELSE 'HIGH' END"),
        "HTTP-002": alert(
            "HTTP-002", f"{apache} AND {xss}", 1,
            f"'IP ' || {who} || ' injected XSS payload. Sample: ' || {path60}", num(0.82)),
        "HTTP-003": line(
            "HTTP-003", f"{apache} AND {any_word('path', fv.RULE_TRAVERSAL_WORDS)}",
            f"'IP ' || {who} || ' attempted path traversal: ' || substring(path, 1, 60)", 0.88),
        "HTTP-004": alert(
            "HTTP-004", f"{apache} AND {any_word('lower(user_agent)', scanners)}", 1,
            f"'IP ' || {who} || ' using ' || {scanner} || ' (' || count(*) || ' requests)'", num(0.9)),
        "HTTP-005": alert(
            "HTTP-005", apache, 100,
            f"'IP ' || {who} || ' sent ' || count(*) || ' requests (possible DDoS)'",
            f"least({one}, count(*) / CAST(200 AS DOUBLE))", "''"),
        "HTTP-006": line(
            "HTTP-006", f"{apache} AND {any_word('path', fv.RULE_SENSITIVE_WORDS)}",
            f"'IP ' || {who} || ' accessed sensitive path: ' || substring(path, 1, 60)", 0.87),
        "HTTP-007": alert(
            "HTTP-007", f"{apache} AND status_code BETWEEN 400 AND 499", 20,
            f"'IP ' || {who} || ' triggered ' || count(*) || ' client errors (scanning?)'",
            f"least({num(0.8)}, count(*) / CAST(50 AS DOUBLE))", "''"),
    }


cte("alerts", " UNION ALL ".join(f"({s})" for s in rule_selects("all_logs").values()), "all_logs")
# Stand-in anomaly score of a line: its value over the highest value; flagged above 60.
cte(
    "scored",
    """SELECT *, value / (SELECT max(value) FROM all_logs) AS anomaly_score,
      CAST(value > 60 AS INTEGER) AS if_pred FROM all_logs""",
    "all_logs",
)


def fusion(prefix: str, scored: str) -> None:
    """Predictions and alerts of scored lines: ``{prefix}predicted``, ``fused_alerts``, ``ai_alerts``, ``hybrid``."""
    cte(
        f"{prefix}predicted",
        f"""SELECT s.*, CAST(coalesce(s.ip IN (SELECT source_ip FROM alerts WHERE source_ip IS NOT NULL
          AND source_ip <> ''), false) AS INTEGER) AS rule_pred FROM {scored} s""",
        scored, "alerts",
    )
    cte(
        f"{prefix}fused_alerts",
        f"""SELECT rule_ord, first_key, rule_id, rule_name, description, source_ip, count, sample_raw,
          'Rule + AI' AS detection_method, {fused('a.rule_score', 'm.mean', fv.LINE_ALPHA)}
        FROM alerts a CROSS JOIN (SELECT avg(anomaly_score) AS mean FROM {scored}) m""",
        "alerts", scored,
    )
    cte(
        f"{prefix}ai_alerts",
        f"""SELECT CAST(12 AS INTEGER) AS rule_ord, line_key AS first_key, 'AI-001' AS rule_id,
          '{fv.AI_RULE[1]}' AS rule_name,
          'Isolation Forest flagged ' || coalesce(nullif(ip, ''), 'unknown IP') || ' (event=' || event_type
            || ', score=' || printf('%.3f', anomaly_score) || ')' AS description,
          coalesce(nullif(ip, ''), 'unknown') AS source_ip, CAST(1 AS BIGINT) AS count,
          substring(raw, 1, 120) AS sample_raw, 'Isolation Forest' AS detection_method,
          {fused(num(0.0), 'anomaly_score', fv.LINE_ALPHA)}
        FROM {prefix}predicted WHERE if_pred = 1 AND rule_pred = 0 AND anomaly_score > {num(fv.AI_ONLY_CUT)}""",
        f"{prefix}predicted",
    )
    cte(
        f"{prefix}hybrid", f"SELECT * FROM {prefix}fused_alerts UNION ALL BY NAME SELECT * FROM {prefix}ai_alerts",
        f"{prefix}fused_alerts", f"{prefix}ai_alerts",
    )


def line_ablation(predicted: str) -> str:
    mix = threat("rule_pred", "anomaly_score", fv.LINE_ABLATION_ALPHA)
    return "SELECT method, precision, recall, f1, fpr FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS method, {QUALITY_ROUNDED} FROM (SELECT {cells('label', pred)} FROM {predicted})"
        for name, pred in (
            ("rule_only", "rule_pred"),
            ("isolation_forest", "if_pred"),
            ("hybrid", f"CAST({mix} >= {num(fv.LINE_ABLATION_THRESHOLD)} AS INTEGER)"),
        )
    ) + ")"


fusion("", "scored")
cte("line_table", f"SELECT l.*, {LINE_FLAGS}, {BURST} FROM all_logs l LEFT JOIN per_ip USING (ip)", "per_ip", keep=True)

# --- session logs -----------------------------------------------------------------------
cte(
    "hdfs_lines",
    f"""SELECT line_key, value, {found('raw', fv.HDFS_SESSION_LINE, 1)} AS date,
      {found('raw', fv.HDFS_SESSION_LINE, 2)} AS time,
      CAST({found('raw', fv.HDFS_SESSION_LINE, 3)} AS BIGINT) AS pid,
      {found('raw', fv.HDFS_SESSION_LINE, 4)} AS level,
      {found('raw', fv.HDFS_SESSION_LINE, 5)} AS component,
      regexp_extract(raw, {text(fv.HDFS_SESSION_LINE)}, 6) AS content,
      nullif(regexp_extract(regexp_extract(raw, {text(fv.HDFS_SESSION_LINE)}, 6), {text(fv.HDFS_BLOCK)}, 1), '') AS block_id,
      raw
    FROM hdfs_raw WHERE {hit('raw', fv.HDFS_SESSION_LINE)}""",
    "hdfs_raw",
)
for _kind, _last in (("bgl", 9), ("thunderbird", 8)):
    # Fields are cut off one by one: the rest of the line may hold more white space.
    _head = r"^(\S+)\s+\S+\s+\S+\s+(\S+)\s+(?:\S+\s+){4}"
    _head += r"(\S+)(?:\s+(.*))?$" if _last == 9 else r"(.*)$"
    _level = f"{found('raw', _head, 3)} AS level, " if _last == 9 else ""
    cte(
        f"{_kind}_lines",
        f"""SELECT line_key, value, CAST(regexp_extract(raw, {text(_head)}, 1) <> '-' AS INTEGER) AS label,
          regexp_extract(raw, {text(_head)}, 2) AS node, {_level}
          regexp_extract(raw, {text(_head)}, {4 if _last == 9 else 3}) AS content,
          regexp_extract(raw, {text(_head)}, 1) AS raw_label
        FROM {_kind}_raw WHERE {hit('raw', _head)}""",
        f"{_kind}_raw",
    )
    cte(
        f"{_kind}_ordinals",
        f"""SELECT *, row_number() OVER (PARTITION BY node ORDER BY line_key) - 1 AS ordinal,
          count(*) OVER (PARTITION BY node) AS node_lines FROM {_kind}_lines""",
        f"{_kind}_lines",
    )
    cte(
        f"{_kind}_in_windows",
        f"""SELECT o.*, w.win_no, o.ordinal - w.win_no * 10 AS pos FROM {_kind}_ordinals o,
          LATERAL (SELECT unnest([ordinal // 10 - 1, ordinal // 10]) AS win_no) w
        WHERE w.win_no >= 0 AND w.win_no * 10 + 20 <= o.node_lines""",
        f"{_kind}_ordinals",
    )


def count_columns(counts, lines: str = "count(*)") -> str:
    return ", ".join(
        f"count(*) FILTER ({hit('content', c.pattern, c.ignore_case)}) AS {c.name}" for c in counts
    )


def rule_evidence(rules) -> str:
    return ", ".join(
        f"count(*) FILTER ({hit('content', r.pattern, r.ignore_case)}) AS \"r_{r.rule_id}\""
        for r in rules if r.pattern
    )


def session_rule_columns(rules) -> str:
    """Score, hits, names and top severity; lists are joined by commas."""

    def fires(r) -> str:
        if r.feature:
            return f"{r.feature} >= {num(float(r.threshold))}"
        test = f'"r_{r.rule_id}" >= {r.min_lines}'
        return test if r.max_len is None else f"{test} AND seq_len <= {r.max_len}"

    scores = ", ".join(f"CASE WHEN {fires(r)} THEN {num(r.score)} ELSE {num(0.0)} END" for r in rules)
    hits = ", ".join(f"CASE WHEN {fires(r)} THEN {text(r.rule_id)} END" for r in rules)
    names = ", ".join(f"CASE WHEN {fires(r)} THEN {text(r.name)} END" for r in rules)
    tops = " ".join(f"WHEN {fires(r)} THEN '{r.severity}'" for r in rules)
    return (
        f"greatest({scores}) AS rule_score, concat_ws(',', {hits}) AS rules_hit,"
        f" concat_ws(',', {names}) AS rule_names, CASE {tops} ELSE 'NORMAL' END AS top_severity"
    )


cte(
    "hdfs_components",
    f"""SELECT block_id, count(DISTINCT c) AS unique_components FROM (SELECT block_id,
      unnest(regexp_extract_all(content, {text(fv.HDFS_COMPONENT)}, 1)) AS c FROM hdfs_lines
      WHERE block_id IS NOT NULL) GROUP BY block_id""",
    "hdfs_lines",
)
cte(
    "hdfs_features",
    f"""SELECT l.*, coalesce(c.unique_components, 0) AS unique_components FROM (
      SELECT block_id, count(*) AS seq_len, {count_columns(fv.HDFS_COUNTS)}, {rule_evidence(fv.HDFS_RULES)},
        count(*) FILTER ({hit('content', fv.HDFS_COUNTS[0].pattern, True)}) / count(*) AS error_ratio,
        coalesce(max(CAST({found('content', fv.HDFS_SIZE, 1)} AS BIGINT)), 0) AS max_block_size,
        count(DISTINCT content) / count(*) AS unique_event_ratio
      FROM hdfs_lines WHERE block_id IS NOT NULL GROUP BY block_id) l
    LEFT JOIN hdfs_components c USING (block_id)""",
    "hdfs_lines", "hdfs_components",
)
cte(
    "bgl_features",
    f"""SELECT node, win_no, max(label) AS label, count(*) AS seq_len, {count_columns(fv.BGL_COUNTS)},
      {rule_evidence(fv.BGL_RULES)},
      count(*) FILTER ({hit('content', fv.BGL_COUNTS[0].pattern, True)}) / count(*) AS fatal_ratio,
      count(*) FILTER ({hit('content', fv.BGL_COUNTS[1].pattern, True)}) / count(*) AS error_ratio,
      count(DISTINCT content) / count(*) AS unique_ratio,
      count(DISTINCT nullif(regexp_extract(content, {text(fv.BGL_RACK)}, 0), '')) AS unique_nodes
    FROM bgl_in_windows GROUP BY node, win_no""",
    "bgl_in_windows",
)
cte(
    "thunderbird_features",
    f"""SELECT node, win_no, max(label) AS label, count(*) AS seq_len,
      {count_columns(fv.THUNDERBIRD_COUNTS)}, {rule_evidence(fv.THUNDERBIRD_RULES)},
      count(*) FILTER ({hit('content', fv.THUNDERBIRD_COUNTS[1].pattern, True)}) / count(*) AS error_ratio,
      count(DISTINCT content) / count(*) AS unique_ratio
    FROM thunderbird_in_windows GROUP BY node, win_no""",
    "thunderbird_in_windows",
)
# Stand-in anomaly score of a session, from its features.
cte(
    "hdfs_scored",
    f"""SELECT f.*, {session_rule_columns(fv.HDFS_RULES)}, coalesce(b.label, 0) AS label,
      error_ratio * {num(0.5)} + ({num(1.0)} - unique_event_ratio) * {num(0.5)} AS anomaly_score
    FROM hdfs_features f LEFT JOIN block_labels b USING (block_id)""",
    "hdfs_features", "block_labels",
)
cte(
    "bgl_scored",
    f"SELECT *, {session_rule_columns(fv.BGL_RULES)}, unique_ratio AS anomaly_score FROM bgl_features",
    "bgl_features",
)
cte(
    "thunderbird_scored",
    f"""SELECT *, {session_rule_columns(fv.THUNDERBIRD_RULES)}, unique_ratio AS anomaly_score
    FROM thunderbird_features""",
    "thunderbird_features",
)

# --- sequences --------------------------------------------------------------------------
cte(
    "vocab",
    f"""SELECT content, n, row_number() OVER (ORDER BY n DESC, node, first) AS key FROM (
      SELECT content, count(*) AS n, min(node) AS node,
        min(ordinal) FILTER (node = first_node) AS first FROM (
          SELECT content, node, ordinal, min(node) OVER (PARTITION BY content) AS first_node
          FROM bgl_in_windows) GROUP BY content
      ) ORDER BY n DESC, node, first LIMIT {fv.NGRAM_VOCABULARY}""",
    "bgl_in_windows",
)
cte(
    "sequences",
    """SELECT node, win_no, max(label) AS label, list(coalesce(key, 0) ORDER BY pos) AS keys
    FROM bgl_in_windows LEFT JOIN vocab USING (content) GROUP BY node, win_no""",
    "bgl_in_windows", "vocab",
)
cte(
    "grams",
    """SELECT node, win_no, label, start, array_to_string(keys[start + 1 : start + 10], ',') AS ctx,
      keys[start + 11] AS nxt FROM (SELECT *, unnest(range(0, len(keys) - 10)) AS start FROM sequences)""",
    "sequences",
)
cte(
    "transitions",
    """SELECT ctx, nxt, count(*) AS n, min({'node': node, 'win_no': win_no, 'start': start}) AS first
    FROM grams WHERE label = 0 GROUP BY ctx, nxt""",
    "grams",
)
cte(
    "top_next",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, first) AS rank
    FROM transitions) WHERE rank <= {fv.NGRAM_TOP_K}""",
    "transitions",
)
cte(
    "detected",
    """SELECT node, win_no, max(g.label) AS label, CAST(max(CASE WHEN t.ctx IS NULL THEN 1 ELSE 0 END)
      AS INTEGER) AS pred FROM grams g LEFT JOIN top_next t USING (ctx, nxt) GROUP BY node, win_no""",
    "grams", "top_next",
)
