"""Patterns, word lists, rule tables and constants.

Everything in this file must equal the published values for results to be right.
Patterns are written as plain regular expressions (no dialect prefix); see
``text.java_pattern`` for the prefix Spark needs.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: line patterns of the OpenSSH log, first match wins -------------------


class SshPattern(NamedTuple):
    event_type: str
    template: str
    pattern: str
    groups: dict[str, int]
    # Literal text without which the pattern cannot match; tested first because a substring
    # test is far cheaper than a backtracking regular expression.
    literals: tuple[str, ...]


_HEAD = r"(\w+\s+\d+\s[\d:]+).*sshd\[.*?\]:\s+"
_ANY_HEAD = r"(\w+\s+\d+\s[\d:]+).*"

SSH_PATTERNS: tuple[SshPattern, ...] = (
    SshPattern(
        "failed_password",
        "Failed password for <USER> from <IP>",
        _HEAD + r"Failed password for (?:invalid user )?(\S+) from ([\d.]+)",
        {"timestamp": 1, "user": 2, "ip": 3},
        ("Failed password for ",),
    ),
    SshPattern(
        "accepted_login",
        "Accepted login for <USER> from <IP>",
        _HEAD + r"Accepted (?:password|publickey) for (\S+) from ([\d.]+)",
        {"timestamp": 1, "user": 2, "ip": 3},
        ("Accepted p",),
    ),
    SshPattern(
        "invalid_user",
        "Invalid user <USER> from <IP>",
        _HEAD + r"Invalid user (\S+) from ([\d.]+)",
        {"timestamp": 1, "user": 2, "ip": 3},
        ("Invalid user ",),
    ),
    SshPattern(
        "disconnect",
        "Disconnect from <IP>",
        _HEAD + r"(?:Connection closed|Received disconnect|Disconnecting).*?([\d.]+)",
        {"timestamp": 1, "ip": 2},
        ("Connection closed", "Received disconnect", "Disconnecting"),
    ),
    SshPattern(
        "break_in_attempt",
        "POSSIBLE BREAK-IN from <IP>",
        _HEAD + r"reverse mapping checking.*?([\d.]+).*POSSIBLE BREAK-IN",
        {"timestamp": 1, "ip": 2},
        ("POSSIBLE BREAK-IN",),
    ),
    SshPattern(
        "no_identification",
        "No identification from <IP>",
        _HEAD + r"Did not receive identification.*?([\d.]+)",
        {"timestamp": 1, "ip": 2},
        ("Did not receive identification",),
    ),
    SshPattern(
        "sudo_command",
        "sudo <USER> COMMAND=<CMD>",
        _ANY_HEAD + r"sudo.*?:\s+(\S+).*?COMMAND=(.+)",
        {"timestamp": 1, "user": 2, "command": 3},
        ("COMMAND=",),
    ),
    SshPattern(
        "session_event",
        "session <ACTION> for user <USER>",
        _ANY_HEAD + r"pam_unix.*?session (opened|closed) for user (\S+)",
        {"timestamp": 1, "action": 2, "user": 3},
        ("pam_unix",),
    ),
    SshPattern(
        "ssh_error",
        "SSH error: <MSG>",
        _HEAD + r"(?:error|fatal):\s+(.+)",
        {"timestamp": 1, "message": 2},
        ("error:", "fatal:"),
    ),
    SshPattern(
        "postponed_auth",
        "Postponed auth for <USER> from <IP>",
        _HEAD + r"Postponed.*?for (\S+) from ([\d.]+)",
        {"timestamp": 1, "user": 2, "ip": 3},
        ("Postponed",),
    ),
)

# Corrected address capture of the break-in pattern (``fixed=True``): the address is the
# bracketed one, not the first dot of a host name.
SSH_BREAK_IN_ADDRESS = r"reverse mapping checking.*?\[([\d.]+)\]"

# --- fixed values: other line patterns --------------------------------------------------
HDFS_LINE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([\w.$]+):\s+(.+)"
HDFS_SESSION_LINE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+(\S+):\s+(.*)"
HDFS_BLOCK = r"(blk_-?\d+)"
HDFS_BLOCK_NUMBER = r"blk_(-?\d+)"
APACHE_ERROR_LINE = r"^\[([^\]]+)\]\s+\[(\w+)\]\s+(.+)"
APACHE_ACCESS_LINE = r"^([\d.]+).*?\[([^\]]+)\]\s+\"(\w+)\s+(\S+)[^\"]*\"\s+(\d+)"
LINUX_LINE = r"^(\w+\s+\d+\s+[\d:]+)\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)"

DETECT_SSH_WORDS = ("sshd", "failed password", "invalid user")
DETECT_HDFS = r"\d{6}\s+\d{6}\s+\d+\s+(INFO|WARN|ERROR)"
DETECT_APACHE = r"\[.+?\]\s+\[(notice|error|warn|info)\]"
DETECT_SAMPLE_LINES = 10

UNKNOWN_TEMPLATES = {
    "ssh": "UNKNOWN_SSH_EVENT",
    "hdfs": "UNKNOWN_HDFS_LINE",
    "apache": "UNKNOWN_APACHE_LINE",
    "linux": "UNKNOWN_LINUX_EVENT",
}

# --- fixed values: word lists of the parsers --------------------------------------------
HDFS_PARSER_WORDS = (
    "exception", "error", "failed", "failure", "timeout",
    "lost", "corrupt", "missing", "refused", "denied",
)
APACHE_ERROR_LEVELS = ("error", "crit", "alert", "emerg")
LINUX_ERROR_WORDS = ("error", "failed", "failure", "critical", "denied")

# --- fixed values: word lists of the per-line features ----------------------------------
FEATURE_SUDO_WORDS = (
    "/bin/bash", "/bin/sh", "passwd root", "sudoers",
    "chmod 777", "/etc/shadow", "/bin/su", "chown root", "/etc/",
)
FEATURE_PATH_WORDS = (
    "passwd", "shadow", "sudoers", ".env", ".git", "wp-config",
    "phpmyadmin", "shell.php", "backup.zip", ".htaccess", "db.sql",
)
FEATURE_SQLI_WORDS = (
    "union+select", "'+or+", "1=1", "drop+table", "select+*",
    "waitfor+delay", "sleep(", "'--", "or '1'='1", "benchmark(",
)
FEATURE_XSS_WORDS = (
    "<script", "onerror=", "onload=", "javascript:", "alert(", "<svg", "document.cookie",
)
FEATURE_SCANNER_WORDS = (
    "nikto", "sqlmap", "nmap", "masscan", "dirbuster",
    "gobuster", "flood-bot", "zgrab", "hydra", "medusa",
)
FEATURE_HDFS_WORDS = (
    "exception", "error", "failed", "failure", "timeout",
    "lost", "corrupt", "missing", "refused", "denied", "warn",
)
FEATURE_BRUTE_WORDS = (
    "failed password", "invalid user", "authentication failure",
    "possible break-in", "did not receive identification",
)
ROOT_USERS = ("root", "admin", "administrator")

# --- fixed values: word lists and thresholds of the labels ------------------------------
LABEL_SQLI_WORDS = ("union+select", "'+or+", "1=1", "drop+table", "select+*", "'--")
LABEL_XSS_WORDS = ("<script", "onerror=", "onload=", "javascript:", "alert(")
LABEL_PATH_WORDS = ("passwd", "shadow", ".env", ".git", "wp-config", "shell.php")
LABEL_SCANNER_WORDS = ("nikto", "sqlmap", "nmap", "masscan", "dirbuster", "hydra")
LABEL_LINUX_EVENTS = ("failed_password", "invalid_user", "break_in_attempt", "linux_error")
LABEL_LINUX_WORDS = (
    "segfault", "kernel panic", "oom-killer", "authentication failure", "possible break",
)
LABEL_FAILED_PASSWORDS = 6
LABEL_INVALID_USERS = 4
LABEL_FLOOD_REQUESTS = 100

# --- fixed values: word lists of the line rules -----------------------------------------
SSH_SOURCES = ("auth", "ssh", "linux")
RULE_SUDO_WORDS = (
    "/bin/bash", "/bin/sh", "passwd", "sudoers",
    "chmod 777", "/etc/shadow", "/bin/su", "chown root",
)
RULE_TRAVERSAL_WORDS = ("../", "%2e%2e", "..%2f", "%2f..")
RULE_SCANNER_WORDS = ("nikto", "sqlmap", "nmap", "masscan", "dirbuster", "gobuster", "flood-bot")
RULE_SENSITIVE_WORDS = (
    ".env", "wp-config", "phpmyadmin", ".git/config",
    "backup.zip", "db.sql", "/etc/passwd", "shell.php",
)

# --- fixed values: private address tests ------------------------------------------------
PRIVATE_PREFIXES = ("192.168.", "10.", "172.16.")
LOOPBACK = "127.0.0.1"

# --- fixed values: line rules in alert order --------------------------------------------


class LineRule(NamedTuple):
    rule_id: str
    name: str
    severity: str


LINE_RULES: tuple[LineRule, ...] = (
    LineRule("AUTH-001", "SSH Brute Force", "CRITICAL"),
    LineRule("AUTH-002", "User Enumeration", "HIGH"),
    LineRule("AUTH-003", "External Root Login", "CRITICAL"),
    LineRule("AUTH-004", "Suspicious Sudo Command", "HIGH"),
    LineRule("AUTH-005", "Credential Stuffing", "HIGH"),
    LineRule("HTTP-001", "SQL Injection Attempt", "HIGH"),
    LineRule("HTTP-002", "XSS Attempt", "HIGH"),
    LineRule("HTTP-003", "Directory Traversal", "HIGH"),
    LineRule("HTTP-004", "Scanner Detected", "HIGH"),
    LineRule("HTTP-005", "HTTP Flood", "CRITICAL"),
    LineRule("HTTP-006", "Sensitive File Access", "HIGH"),
    LineRule("HTTP-007", "Repeated 4xx Errors", "MEDIUM"),
)
AI_RULE = ("AI-001", "Anomaly — Unknown Pattern")

# --- fixed values: line features of the session kinds -----------------------------------


class LineCount(NamedTuple):
    """A feature that counts the lines of a session that match a pattern.

    ``literals`` are texts (lower case if case is ignored) of which a matching line holds at
    least one: a cheap test that spares most runs of the pattern.
    """

    name: str
    pattern: str
    ignore_case: bool = False
    literals: tuple[str, ...] = ()


HDFS_COUNTS: tuple[LineCount, ...] = (
    LineCount("error_count", r"Exception|Error|Failed|failed|WARN|WARNING", True,
              ("exception", "error", "failed", "warn")),
    LineCount("replicate_count", r"replicate|Replicat", True, ("replicat",)),
    LineCount("count_E1", r"Receiving block", literals=("Receiving block",)),
    LineCount("count_E2", r"Served block", literals=("Served block",)),
    LineCount("count_E3", r"writeBlock", literals=("writeBlock",)),
    LineCount("count_E4", r"Deleting block", literals=("Deleting block",)),
    LineCount("count_E5", r"received block", literals=("received block",)),
    LineCount("count_E6", r"PacketResponder.*Exception", literals=("PacketResponder",)),
    LineCount("count_E7", r"Exception|Error|Failed|failed", literals=("Exception", "Error", "Failed", "failed")),
    LineCount("count_E8", r"heartbeat", literals=("heartbeat",)),
    LineCount("count_E9", r"allocate", literals=("allocate",)),
    LineCount("count_E10", r"replicate|Replicat", literals=("replicate", "Replicat")),
    LineCount("count_E11", r"WARN|WARNING", literals=("WARN",)),
    LineCount("count_E12", r"INFO", literals=("INFO",)),
)
HDFS_SIZE = r"size\s+(\d+)"
HDFS_COMPONENT = r"dfs\.(\w+)"

BGL_COUNTS: tuple[LineCount, ...] = (
    LineCount("fatal_count", r"\bFATAL\b", True, ("fatal",)),
    LineCount("error_count", r"\b(error|fail|fault|exception|corrupt|crash|abort)\b", True,
              ("error", "fail", "fault", "exception", "corrupt", "crash", "abort")),
    LineCount("warn_count", r"\b(warn|WARNING|SEVERE)\b", True, ("warn", "severe")),
    LineCount("kern_count", r"\bKERNEL\b", True, ("kernel",)),
    LineCount("app_count", r"\bAPP\b", True, ("app",)),
    LineCount("ciod_count", r"\bciod\b", True, ("ciod",)),
    LineCount("timeout_count", r"\btimeout\b", True, ("timeout",)),
    LineCount("mem_count", r"\b(memory|ddr|parity|ecc|corrected)\b", True,
              ("memory", "ddr", "parity", "ecc", "corrected")),
    LineCount(
        "fatal_type_ct",
        r"\b(TLB|storage\s+interrupt|machine\s+check|program\s+interrupt)\b",
        True,
        ("tlb", "interrupt", "check"),
    ),
)
BGL_RACK = r"R\d+-M\d+-N"

THUNDERBIRD_COUNTS: tuple[LineCount, ...] = (
    LineCount("fatal_count", r"\bfatal\b", True, ("fatal",)),
    LineCount("error_count", r"\b(error|fail|fault|failed|cannot|denied|refused)\b", True,
              ("error", "fail", "fault", "cannot", "denied", "refused")),
    LineCount("warn_count", r"\b(warn|warning)\b", True, ("warn",)),
    LineCount("link_count", r"\blink\b", True, ("link",)),
    LineCount("proc_count", r"\b(crond|sshd|ntpd|sendmail)\b", True,
              ("crond", "sshd", "ntpd", "sendmail")),
    LineCount("timeout_count", r"\b(timeout|not answer|lost)\b", True,
              ("timeout", "not answer", "lost")),
    LineCount("switch_count", r"\b(ib_sm|ganglia|gmetad)\b", True,
              ("ib_sm", "ganglia", "gmetad")),
    LineCount("mem_count", r"\b(memory|ecc|parity)\b", True, ("memory", "ecc", "parity")),
)

# --- fixed values: session rules in table order -----------------------------------------


class SessionRule(NamedTuple):
    """One rule over a session.

    A rule with a ``pattern`` needs ``min_lines`` matching lines (and at most ``max_len`` lines
    in the session); a rule with a ``feature`` needs the feature to reach ``threshold``.
    """

    rule_id: str
    name: str
    score: float
    severity: str
    pattern: str | None = None
    ignore_case: bool = False
    min_lines: int = 1
    max_len: int | None = None
    feature: str | None = None
    threshold: float | None = None
    literals: tuple[str, ...] = ()


HDFS_RULES: tuple[SessionRule, ...] = (
    SessionRule("HDFS-001", "PacketResponder Exception", 1.0, "CRITICAL",
                r"PacketResponder.*\bException\b", True,
                literals=("packetresponder",)),
    SessionRule("HDFS-002", "Block Transfer Failed", 0.9, "HIGH",
                r"(writeBlock|receiveBlock).*[Ff]ailed|[Ff]ailed.*(writeBlock|receiveBlock)",
                literals=("ailed",)),
    SessionRule("HDFS-003", "IOException During Block Op", 0.85, "HIGH", r"\bIOException\b",
                literals=("IOException",)),
    SessionRule("HDFS-004", "Excessive Replication", 0.7, "MEDIUM",
                feature="replicate_count", threshold=6),
    SessionRule("HDFS-006", "High Error Rate in Block", 0.8, "HIGH",
                feature="error_ratio", threshold=0.5),
    SessionRule("HDFS-007", "Excessive Warnings", 0.5, "MEDIUM", r"\bWARN\b", min_lines=5,
                literals=("WARN",)),
    SessionRule("HDFS-008", "Short Failed Block", 0.8, "HIGH",
                r"\b(Exception|IOException|Failed)\b", max_len=5,
                literals=("Exception", "Failed")),
)
BGL_RULES: tuple[SessionRule, ...] = (
    SessionRule("BGL-001", "Kernel FATAL Event", 1.0, "CRITICAL", r"KERNEL\s+FATAL", True,
                literals=("kernel",)),
    SessionRule("BGL-002", "APP FATAL Failure", 0.95, "CRITICAL", r"APP\s+FATAL", True,
                literals=("app",)),
    SessionRule("BGL-003", "ciod Process Failure", 0.9, "HIGH",
                r"ciod:.*(?:fail|error|Error|cannot|No such)", True,
                literals=("ciod:",)),
    SessionRule("BGL-004", "Data TLB / Storage Interrupt", 0.95, "CRITICAL",
                r"(data\s+TLB\s+error|data\s+storage\s+interrupt)", True,
                literals=("data",)),
    SessionRule("BGL-005", "High Fatal Ratio in Window", 0.85, "HIGH",
                feature="fatal_ratio", threshold=0.3),
    SessionRule("BGL-006", "Machine Check / Program Interrupt", 0.9, "CRITICAL",
                r"(machine\s+check|program\s+interrupt|machine\s+state)", True,
                literals=("machine", "interrupt")),
    SessionRule("BGL-007", "Discovery SEVERE / WARNING", 0.7, "MEDIUM",
                r"DISCOVERY\s+(SEVERE|WARNING)", True,
                literals=("discovery",)),
)
THUNDERBIRD_RULES: tuple[SessionRule, ...] = (
    SessionRule("TB-001", "Hardware FATAL", 1.0, "CRITICAL", r"FATAL", True,
                literals=("fatal",)),
    SessionRule("TB-002", "Memory Parity/ECC Error", 0.95, "CRITICAL",
                r"(parity\s+error|ecc\s+error|uncorrectable)", True,
                literals=("parity", "ecc", "uncorrectable")),
    SessionRule("TB-003", "Link Failure", 0.9, "HIGH", r"link\s+(down|fail|error|lost)", True,
                literals=("link",)),
    SessionRule("TB-004", "Switch/Fabric Error", 0.85, "HIGH",
                r"ib_sm.*(error|fail|cannot)", True,
                literals=("ib_sm",)),
    SessionRule("TB-005", "Node Timeout / Offline", 0.7, "MEDIUM",
                r"(not\s+answer|connection\s+refused|timeout|unreachable)", True,
                literals=("answer", "refused", "timeout", "unreachable")),
    SessionRule("TB-006", "High Error Ratio", 0.8, "HIGH",
                feature="error_ratio", threshold=0.3),
)

# --- fixed values: windows, weights, thresholds, grids ----------------------------------
WINDOW_SIZE = 20
WINDOW_STEP = 10

SEVERITY_BANDS = (("CRITICAL", 0.80), ("HIGH", 0.60), ("MEDIUM", 0.40), ("LOW", 0.20))
LINE_ALPHA = 0.55
HDFS_ALPHA = 0.40
HDFS_THRESHOLD = 0.45
CLUSTER_ALPHA = 0.55
CLUSTER_THRESHOLD = 0.40
LINE_ABLATION_ALPHA = 0.5
LINE_ABLATION_THRESHOLD = 0.5
AI_ONLY_CUT = 0.65
ALERT_SAMPLE_CHARS = 120
ALERT_HEAD = 100
EXPLAIN_CUT = 0.1
EXPLAIN_FEATURES = 12

LINE_TREES = 200
SESSION_TREES = 100
TREE_SAMPLE = 256
SEED = 42

SWEEP_ALPHAS = (
    0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
    0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0,
)
TUNE_ALPHAS = (
    0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0,
)
TUNE_THRESHOLDS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)

NGRAM_HISTORY = 10
NGRAM_TOP_K = 9
NGRAM_VOCABULARY = 500

# --- fixed values: input file names, first existing one wins -----------------------------
SOURCE_FILES = {
    "ssh": ("SSH_2k.log", "SSH.log"),
    "hdfs": ("HDFS.log", "HDFS_2k.log"),
    "apache": ("Apache_2k.log", "Apache.log"),
    "linux": ("Linux_2k.log", "Linux.log"),
}
LABEL_FILES = ("anomaly_label.csv",)
