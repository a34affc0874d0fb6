"""Parse raw lines into typed rows.

Each ``parse_*`` takes a table with a ``raw`` text column (any other columns pass through) and
adds the parsed columns. Nothing runs outside the JVM and nothing shuffles. Lines that match no
pattern stay, with event type ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import blank_to_null, contains_any, extract, matches, rewrite

PARSED_TYPES = {
    "source": "string",
    "timestamp": "string",
    "ip": "string",
    "user": "string",
    "event_type": "string",
    "path": "string",
    "status_code": "int",
    "method": "string",
    "user_agent": "string",
    "log_level": "string",
    "component": "string",
    "template": "string",
    "command": "string",
    "action": "string",
    "message": "string",
    "block_id": "string",
}
EXTRA_COLUMNS = ("command", "action", "message", "block_id")
# Fields that regular expressions take from a line of a kind, in the order in which they are packed.
SSH_FIELDS = ("kind", "timestamp", "ip", "user", "command", "action", "message")
HDFS_FIELDS = ("timestamp", "level", "component", "message")
APACHE_FIELDS = ("kind", "timestamp", "ip", "level", "method", "path", "status", "message")
LINUX_FIELDS = ("timestamp", "process", "message")
# Levels in capitals as they are; others are rare.
CAPITAL_LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "FATAL")


def _layout(names: tuple[str, ...], groups: dict[str, int | str]) -> str:
    """Replacement text that packs groups (by number) and constants, one field per line.

    It begins with a line feed, by which a text that a pattern has packed is known."""
    cells = (groups.get(name, "") for name in names)
    return "".join(f"\n${cell}" if isinstance(cell, int) else f"\n{cell}" for cell in cells)


def _unpack(lines: DataFrame, packed: Column, names: tuple[str, ...], otherwise: Column | None = None) -> DataFrame:
    """Add one text column ``__<field>`` per field of the packed text (null when empty, or when nothing was packed).

    A line is tested and taken apart by one run of one regular expression, whatever the number
    of fields: text that it doesn't match stays as it is. No line holds a line feed, which therefore
    tells a packed text and separates the fields. Only lines that were not packed, and not empty, run
    ``otherwise``. The packed text comes out of a generator that gives one row: filters and join conditions
    on parsed columns stay above it, where the optimizer would otherwise copy the regular expressions into
    every condition and run them again.
    """
    kept = [c for c in lines.columns if c not in PARSED_TYPES]
    parts = lines.select(*kept, F.explode(F.array(packed)).alias("__packed"))
    if otherwise is not None:
        done = (F.col("__packed") == "") | F.col("__packed").contains("\n")
        parts = parts.select(*kept, F.explode(F.array(F.when(done, F.col("__packed")).otherwise(otherwise))).alias("__packed"))
    parts = parts.withColumn("__parts", F.split("__packed", "\n", -1))
    fields = {
        f"__{name}": blank_to_null(F.get("__parts", F.lit(n))) for n, name in enumerate(names, 1)
    }
    return parts.withColumns(fields)


def _with_parsed(fields: DataFrame, **columns: Column) -> DataFrame:
    """The input columns plus every parsed column (null where not given)."""
    kept = [c for c in fields.columns if not c.startswith("__")]
    parsed = [
        columns.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in PARSED_TYPES.items()
    ]
    return fields.select(*kept, *parsed)


def with_extras(parsed: DataFrame) -> DataFrame:
    """Add ``extras``: the optional fields a line has, as a map."""
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in EXTRA_COLUMNS])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return parsed.withColumn("extras", F.map_from_entries(present))


# --- OpenSSH ----------------------------------------------------------------------------


def _packed_ssh(raw: Column, tested: bool) -> Column:
    """Fields by the first pattern that matches; ``kind`` is its event type.

    Without ``tested`` only the first pattern is run whose literal text the line holds. The line itself where it
    doesn't match, which is rare: the patterns are then tested in order."""
    packed = F
    for p in fv.SSH_PATTERNS:
        test = contains_any(raw, p.literals)
        layout = _layout(SSH_FIELDS, {"kind": p.event_type, **p.groups})
        packed = packed.when(test & matches(raw, p.pattern) if tested else test, rewrite(raw, p.pattern, layout))
    return packed.otherwise(F.lit(""))


def _ssh_columns(fixed: bool) -> dict[str, Column]:
    event = F.coalesce("__kind", F.lit("unknown"))
    templates = {p.event_type: p.template for p in fv.SSH_PATTERNS}
    table = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    ip = F.col("__ip")
    if fixed:
        bracketed = blank_to_null(extract(F.col("raw"), fv.SSH_BREAK_IN_ADDRESS, 1))
        ip = F.when(event == "break_in_attempt", F.coalesce(bracketed, ip)).otherwise(ip)
    return {
        "event_type": event,
        "template": F.coalesce(F.try_element_at(table, event), F.lit(fv.UNKNOWN_TEMPLATES["ssh"])),
        "timestamp": F.col("__timestamp"),
        "ip": ip,
        "user": F.col("__user"),
        "command": F.col("__command"),
        "action": F.col("__action"),
        "message": F.col("__message"),
    }


def parse_ssh(lines: DataFrame, fixed: bool = False) -> DataFrame:
    """OpenSSH lines: ten patterns tried in order.

    ``fixed`` takes the bracketed address of a break-in line instead of the first digits or
    dots after the phrase.
    """
    raw = F.col("raw")
    fields = _unpack(lines, _packed_ssh(raw, False), SSH_FIELDS, _packed_ssh(raw, True))
    return _with_parsed(fields, source=F.lit("ssh"), **_ssh_columns(fixed))


# --- HDFS -------------------------------------------------------------------------------


def parse_hdfs(lines: DataFrame) -> DataFrame:
    """HDFS lines: level, component, block number and an event class."""
    raw = F.col("raw")
    layout = _layout(HDFS_FIELDS, {"timestamp": "$1 $2", "level": 4, "component": 5, "message": 6})
    fields = _unpack(lines, rewrite(raw, fv.HDFS_LINE, layout), HDFS_FIELDS)
    known = F.col("__message").isNotNull()
    level = F.col("__level")
    upper_level = F.when(level.isin(*CAPITAL_LEVELS), level).otherwise(F.upper(level))
    component = F.lower("__component")
    anomaly = upper_level.isin("ERROR", "WARN") | contains_any(
        F.lower("__message"), fv.HDFS_PARSER_WORDS
    )
    event = (
        F.when(~known, "unknown")
        .when(anomaly, "hdfs_anomaly")
        .when(component.contains("namenode"), "hdfs_namenode")
        .when(component.contains("datanode"), "hdfs_datanode")
        .when(component.contains("client"), "hdfs_client")
        .otherwise("hdfs_general")
    )
    block = F.when(F.col("__message").contains("blk_"), extract(F.col("__message"), fv.HDFS_BLOCK_NUMBER, 1))
    fields = fields.withColumns({"__event": event, "__block": block})
    event = F.col("__event")
    template = (
        F.when(
            event == "hdfs_anomaly",
            F.concat(F.lit("HDFS "), upper_level, F.lit(" <COMPONENT>: <ANOMALY_MSG>")),
        )
        .when(event == "hdfs_namenode", "HDFS NameNode: <MSG>")
        .when(event == "hdfs_datanode", "HDFS DataNode: <MSG>")
        .when(event == "hdfs_client", "HDFS Client: <MSG>")
        .when(event == "hdfs_general", "HDFS <COMPONENT>: <MSG>")
        .otherwise(fv.UNKNOWN_TEMPLATES["hdfs"])
    )
    return _with_parsed(
        fields,
        source=F.lit("hdfs"),
        timestamp=F.col("__timestamp"),
        log_level=F.col("__level"),
        component=F.col("__component"),
        block_id=blank_to_null(F.col("__block")),
        event_type=event,
        template=template,
    )


# --- Apache -----------------------------------------------------------------------------


def parse_apache(lines: DataFrame, fixed: bool = False) -> DataFrame:
    """Apache lines: the error form is tried first, then the access form.

    ``fixed`` also reads the user agent, the last quoted field of an access line.
    """
    raw = F.col("raw")
    error_layout = _layout(APACHE_FIELDS, {"kind": "error", "timestamp": 1, "level": 2, "message": 3})
    access_layout = _layout(
        APACHE_FIELDS, {"kind": "access", "ip": 1, "timestamp": 2, "method": 3, "path": 4, "status": 5}
    )
    # The first character tells which of the two forms a line may have.
    packed = (
        F.when(raw.startswith("["), rewrite(raw, fv.APACHE_ERROR_LINE, error_layout))
        .when(raw.contains('"'), rewrite(raw, fv.APACHE_ACCESS_LINE, access_layout))
        .otherwise(F.lit(""))
    )
    fields = _unpack(lines, packed, APACHE_FIELDS)
    level, method = F.col("__level"), F.col("__method")
    status = F.col("__status").try_cast("int")
    message = F.lower("__message")
    error_form, access_form = F.col("__kind") == "error", F.col("__kind") == "access"
    agent = extract(raw, r"\"[^\"]*\"\s+\"([^\"]*)\"\s*$", 1)
    return _with_parsed(
        fields,
        source=F.lit("apache"),
        timestamp=F.col("__timestamp"),
        log_level=level,
        ip=F.col("__ip"),
        method=method,
        path=F.lower("__path"),
        status_code=status,
        user_agent=F.when(access_form, blank_to_null(agent)) if fixed else F.lit(None),
        event_type=F.when(error_form & level.isin(*fv.APACHE_ERROR_LEVELS), "apache_error")
        .when(error_form & contains_any(message, ("access", "denied")), "apache_access_denied")
        .when(error_form, F.concat(F.lit("apache_"), level))
        .when(access_form, F.concat(F.lit("http_"), F.lower(method)))
        .otherwise("unknown"),
        template=F.when(error_form, F.concat(F.lit("Apache ["), F.upper(level), F.lit("] <MSG>")))
        .when(
            access_form,
            F.concat_ws(" ", F.lit("HTTP"), method, F.lit("<PATH>"), status.cast("string")),
        )
        .otherwise(fv.UNKNOWN_TEMPLATES["apache"]),
    )


# --- Linux syslog -----------------------------------------------------------------------


def parse_linux(lines: DataFrame, fixed: bool = False) -> DataFrame:
    """Syslog lines. Lines of an sshd process are parsed, and sourced, as OpenSSH lines.

    A line is taken apart as syslog first; only lines of sshd are then taken apart again.
    """
    raw = F.col("raw")
    layout = _layout(LINUX_FIELDS, {"timestamp": 1, "process": 3, "message": 5})
    syslog = _unpack(lines, rewrite(raw, fv.LINUX_LINE, layout), LINUX_FIELDS)
    process, message = F.lower("__process"), F.lower("__message")
    own = {
        "event_type": F.when(process.isNull(), "unknown")
        .when(contains_any(message, fv.LINUX_ERROR_WORDS), "linux_error")
        .when(process.contains("kernel"), "kernel_event")
        .otherwise("linux_general"),
        "template": F.when(
            process.isNotNull(), F.concat(F.lit("Linux "), process, F.lit(": <MSG>"))
        ).otherwise(fv.UNKNOWN_TEMPLATES["linux"]),
        "timestamp": F.col("__timestamp"),
    }
    sshd = F.coalesce(process.contains("sshd"), F.lit(False))
    kept = [c for c in lines.columns if c not in PARSED_TYPES]
    syslog = syslog.select(
        *kept, sshd.alias("own_sshd"), *[c.alias(f"own_{n}") for n, c in own.items()]
    )
    own_sshd = F.col("own_sshd")
    packed = F.when(own_sshd, _packed_ssh(raw, False)).otherwise(F.lit(""))
    fields = _unpack(syslog, packed, SSH_FIELDS, F.when(own_sshd, _packed_ssh(raw, True)).otherwise(F.lit("")))
    columns = {
        name: F.when(F.col("own_sshd"), column).otherwise(F.col(f"own_{name}"))
        if name in own
        else column
        for name, column in _ssh_columns(fixed).items()
    }
    parsed = _with_parsed(
        fields, source=F.when(F.col("own_sshd"), "ssh").otherwise("linux"), **columns
    )
    return parsed.drop("own_sshd", *[f"own_{n}" for n in own])


PARSERS = {"ssh": parse_ssh, "hdfs": parse_hdfs, "apache": parse_apache, "linux": parse_linux}


def parse_source(lines: DataFrame, source: str) -> DataFrame:
    """Parse with the parser of a source; an unknown source is parsed as syslog."""
    return PARSERS.get(source, parse_linux)(lines)


# --- session logs -----------------------------------------------------------------------


def parse_hdfs_sessions(lines: DataFrame) -> DataFrame:
    """HDFS lines for session work; lines that do not match are dropped. Content may be empty."""
    raw = F.col("raw")
    cells = "$1\n$2\n$3\n$4\n$5\n$6"
    packed = F.when(
        matches(raw, fv.HDFS_SESSION_LINE), rewrite(raw, fv.HDFS_SESSION_LINE, cells)
    )
    parts = (
        lines.select("*", F.explode(F.array(packed)).alias("__packed"))
        .filter(F.col("__packed").isNotNull())
        .withColumn("__parts", F.split("__packed", "\n", -1))
    )
    names = ("date", "time", "pid", "level", "component", "content")
    fields = {name: F.get("__parts", F.lit(n)) for n, name in enumerate(names)}
    fields["pid"] = fields["pid"].try_cast("bigint")
    block = blank_to_null(extract(F.col("content"), fv.HDFS_BLOCK, 1))
    return parts.withColumns(fields).withColumn("block_id", block).drop("__packed", "__parts")


def _cluster_fields(lines: DataFrame, fields: int) -> DataFrame:
    parts = F.split(F.col("raw"), r"(?U)\s+", fields)
    return (
        lines.withColumn("__parts", parts)
        .filter(F.size("__parts") >= 9)
        .withColumns(
            {
                "raw_label": F.get("__parts", F.lit(0)),
                "label": F.when(F.get("__parts", F.lit(0)) == "-", 0).otherwise(1),
                "node": F.get("__parts", F.lit(3)),
            }
        )
    )


def parse_bgl(lines: DataFrame) -> DataFrame:
    """BlueGene/L lines: at most ten fields; a line with fewer than nine is dropped."""
    return (
        _cluster_fields(lines, 10)
        .withColumns(
            {
                "level": F.get("__parts", F.lit(8)),
                "content": F.coalesce(F.get("__parts", F.lit(9)), F.lit("")),
            }
        )
        .drop("__parts")
    )


def parse_thunderbird(lines: DataFrame) -> DataFrame:
    """Thunderbird lines: at most nine fields; a line with fewer than nine is dropped."""
    return (
        _cluster_fields(lines, 9)
        .withColumn("content", F.get("__parts", F.lit(8)))
        .drop("__parts")
    )
