"""The twelve rules over parsed lines.

All rules that look at an address share one aggregation. A rule's sample line is fetched after
the aggregation, by its key, so the aggregation moves counts and keys instead of texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import is_external, is_ssh_source
from ..functions.text import contains_any, flag, is_blank
from ..sources.shared import materialise

RULE_ORDER = {rule.rule_id: number for number, rule in enumerate(fv.LINE_RULES)}
RULES = {rule.rule_id: rule for rule in fv.LINE_RULES}
ALERT_COLUMNS = (
    "rule_ord", "first_key", "rule_id", "rule_name", "description", "severity", "source_ip",
    "count", "rule_score", "sample_raw",
)
GROUPED_RULES = (
    "AUTH-001", "AUTH-002", "AUTH-005",
    "HTTP-001", "HTTP-002", "HTTP-004", "HTTP-005", "HTTP-007",
)
SAMPLED_RULES = ("AUTH-001", "AUTH-002", "HTTP-001", "HTTP-002", "HTTP-004")


def _triggers(fixed: bool) -> dict[str, Column]:
    """Which lines count for a grouped rule.

    Three of them wait for event types or a field that the parsers do not give; ``fixed`` looks
    for the attack text instead (the agent needs ``parse_apache(fixed=True)``).
    """
    event, path = F.col("event_type"), F.col("path")
    ssh = is_ssh_source(F.col("source"))
    apache = F.coalesce(F.col("source") == "apache", F.lit(False))
    failed = ssh & (event == "failed_password")
    invalid = ssh & (event == "invalid_user")
    sqli = contains_any(path, fv.FEATURE_SQLI_WORDS) if fixed else event == "sql_injection_attempt"
    xss = contains_any(path, fv.FEATURE_XSS_WORDS) if fixed else event == "xss_attempt"
    status = F.col("status_code")
    return {
        "AUTH-001": failed,
        "AUTH-002": invalid,
        "AUTH-005": (failed | invalid) & ~is_blank(F.col("user")) & ~is_blank(F.col("ip")),
        "HTTP-001": apache & sqli,
        "HTTP-002": apache & xss,
        "HTTP-004": apache & contains_any(F.lower("user_agent"), fv.RULE_SCANNER_WORDS),
        "HTTP-005": apache,
        "HTTP-007": apache & (status >= 400) & (status < 500),
    }


def _short(rule_id: str) -> str:
    return rule_id.replace("-", "_").lower()


def _users_per_ip(lines: DataFrame, by: list[str], fixed: bool) -> DataFrame:
    """Lines reduced to (address, tried user): counts and first keys per rule."""
    aggregates = []
    for rule_id, trigger in _triggers(fixed).items():
        name = _short(rule_id)
        aggregates.append(F.sum(flag(trigger)).alias(f"n_{name}"))
        aggregates.append(F.min(F.when(trigger, F.col("line_key"))).alias(f"k_{name}"))
    tried = F.when(_triggers(fixed)["AUTH-005"], F.col("user"))
    return lines.withColumn("__user", tried).groupBy(*by, "ip", "__user").agg(*aggregates)


def _grouped_alerts(lines: DataFrame, wanted: Sequence[str], by: list[str], fixed: bool) -> DataFrame:
    # Written, a row per address and tried user: the lines are reduced once for all that follows.
    users = materialise(_users_per_ip(lines, by, fixed), "tried-users")
    per_ip = users.groupBy(*by, "ip").agg(
        *[F.sum(f"n_{_short(r)}").alias(f"n_{_short(r)}") for r in GROUPED_RULES],
        *[F.min(f"k_{_short(r)}").alias(f"k_{_short(r)}") for r in GROUPED_RULES],
        F.count("__user").alias("n_users"),
    )

    def count_of(rule_id: str) -> Column:
        return F.col("n_users" if rule_id == "AUTH-005" else f"n_{_short(rule_id)}")

    needed = {
        "AUTH-001": 10, "AUTH-002": 5, "AUTH-005": 4, "HTTP-001": 1, "HTTP-002": 1,
        "HTTP-004": 1, "HTTP-005": 100, "HTTP-007": 20,
    }
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    count_of(r) >= needed[r],
                    F.struct(
                        F.lit(RULE_ORDER[r]).alias("rule_ord"),
                        F.lit(r).alias("rule_id"),
                        count_of(r).alias("count"),
                        F.col(f"k_{_short(r)}").alias("first_key"),
                    ),
                )
                for r in wanted
            ]
        )
    )
    alerts = per_ip.select(*by, F.col("ip").alias("source_ip"), F.explode(hits).alias("hit")).select(
        *by, "source_ip", "hit.*"
    )
    alerts = _add_samples(lines, materialise(alerts, "grouped-alerts"), wanted, fixed)
    alerts = _add_users(users, alerts, by) if "AUTH-005" in wanted else alerts.withColumn(
        "__users", F.lit(None).cast("string")
    )
    n, ip = F.col("count"), F.coalesce("source_ip", F.lit("None"))
    of = {r: F.col("rule_id") == r for r in GROUPED_RULES}

    def text(pattern: str, *columns: Column) -> Column:
        return F.format_string(pattern, *columns)

    path60 = F.substring("__path", 1, 60)
    agent = F.lower("__agent")
    scanner = F.coalesce(*[F.when(agent.contains(w), F.lit(w)) for w in fv.RULE_SCANNER_WORDS],
                         F.lit("scanner"))
    descriptions = {
        "AUTH-001": text("IP %s made %d failed SSH login attempts", ip, n),
        "AUTH-002": text("IP %s probed %d invalid usernames", ip, n),
        "AUTH-005": text("IP %s tried %d different usernames: %s", ip, n, F.col("__users")),
        "HTTP-001": text("IP %s made %d SQLi attempts. Sample: %s", ip, n, path60),
        "HTTP-002": text("IP %s injected XSS payload. Sample: %s", ip, path60),
        "HTTP-004": text("IP %s using %s (%d requests)", ip, scanner, n),
        "HTTP-005": text("IP %s sent %d requests (possible DDoS)", ip, n),
        "HTTP-007": text("IP %s triggered %d client errors (scanning?)", ip, n),
    }
    one = F.lit(1.0)
    scores = {
        "AUTH-001": F.least(one, F.lit(0.8) + (n - 10) * F.lit(0.02)),
        "AUTH-002": F.least(one, F.lit(0.75) + (n - 5) * F.lit(0.05)),
        "AUTH-005": F.least(one, F.lit(0.7) + (n - 4) * F.lit(0.05)),
        "HTTP-001": F.least(one, F.lit(0.7) + n * F.lit(0.01)),
        "HTTP-002": F.lit(0.82),
        "HTTP-004": F.lit(0.9),
        "HTTP-005": F.least(one, n / F.lit(200)),
        "HTTP-007": F.least(F.lit(0.8), n / F.lit(50)),
    }

    def choose(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(of[r], values[r]) for r in wanted])

    severities = {r: F.lit(RULES[r].severity) for r in wanted} | {
        "HTTP-001": F.when(n > 5, "CRITICAL").otherwise("HIGH")
    }
    return alerts.select(
        *by,
        "rule_ord",
        "first_key",
        "rule_id",
        choose({r: F.lit(RULES[r].name) for r in wanted}).alias("rule_name"),
        choose(descriptions).alias("description"),
        choose(severities).alias("severity"),
        "source_ip",
        "count",
        choose(scores).alias("rule_score"),
        F.coalesce("__raw", F.lit("")).alias("sample_raw"),
    )


def _add_samples(lines: DataFrame, alerts: DataFrame, wanted: Sequence[str], fixed: bool) -> DataFrame:
    """Fetch text, path and agent of the first line of an alert by its key.

    Line keys are unique, so no key is hot. Lines that some alert begins with are picked by a hash of
    their key first, eight bytes an alert, so that neither a shuffle nor a broadcast holds the other lines:
    the planner judges lines by their file, which may be much smaller than they are in memory.
    """
    sampled = [r for r in SAMPLED_RULES if r in wanted]
    if not sampled:
        return alerts.withColumns(
            {c: F.lit(None).cast("string") for c in ("__raw", "__path", "__agent")}
        )
    triggers = _triggers(fixed)
    candidate = F.lit(False)
    for rule_id in sampled:
        candidate = candidate | F.coalesce(triggers[rule_id], F.lit(False))
    samples = lines.filter(candidate).select(
        F.col("line_key").alias("__key"),
        F.col("raw").alias("__raw"),
        F.col("path").alias("__path"),
        F.col("user_agent").alias("__agent"),
    )
    first = alerts.filter(F.col("rule_id").isin(*sampled)).select(F.xxhash64("first_key").alias("__hash"))
    first = materialise(first.distinct(), "alert-keys")
    picked = samples.withColumn("__hash", F.xxhash64("__key")).join(first, "__hash", "left_semi").drop("__hash")
    picked = materialise(picked, "alert-samples")  # a row for each key, and perhaps a few of equal hashes
    joined = alerts.join(picked, F.col("first_key") == F.col("__key"), "left").drop("__key")
    own = F.when(F.col("rule_id").isin(*sampled), F.col("__raw"))
    return joined.withColumn("__raw", own)


def _add_users(users: DataFrame, alerts: DataFrame, by: list[str]) -> DataFrame:
    """The first five tried users in sorted order, as text.

    The rank limit applies before the shuffle, so an address sends five users per task.
    """
    order = Window.partitionBy(*by, "ip").orderBy("__user")
    first = (
        users.filter(F.col("__user").isNotNull())
        .select(*by, "ip", "__user")
        .withColumn("__rank", F.row_number().over(order))
        .filter(F.col("__rank") <= 5)
        .groupBy(*by, "ip")
        .agg(F.sort_array(F.collect_list("__user")).alias("__list"))
        .select(
            *[F.col(c).alias(f"__by_{c}") for c in by],
            F.col("ip").alias("__ip"),
            F.concat(F.lit("['"), F.array_join("__list", "', '"), F.lit("']")).alias("__users"),
        )
    )
    same = (F.col("source_ip") == F.col("__ip")) & (F.col("rule_id") == "AUTH-005")
    for c in by:
        same = same & (F.col(c) == F.col(f"__by_{c}"))
    return alerts.join(first, same, "left").drop("__ip", *[f"__by_{c}" for c in by])


def _line_alert(rule_id: str, by: list[str], trigger: Column, description: Column,
                score: float, source_ip: Column | None = None) -> Column:
    """The alert of a line, null where the rule does not fire."""
    rule = RULES[rule_id]
    return F.when(trigger, F.struct(
        *by,
        F.lit(RULE_ORDER[rule_id]).alias("rule_ord"),
        F.col("line_key").alias("first_key"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        description.alias("description"),
        F.lit(rule.severity).alias("severity"),
        (F.col("ip") if source_ip is None else source_ip).alias("source_ip"),
        F.lit(1).cast("bigint").alias("count"),
        F.lit(score).alias("rule_score"),
        F.col("raw").alias("sample_raw"),
    ))


def _single_alerts(lines: DataFrame, wanted: Sequence[str], by: list[str], fixed: bool) -> DataFrame:
    """Every alert of the rules that look at one line, in one pass over the lines."""
    ssh = is_ssh_source(F.col("source"))
    apache = F.col("source") == "apache"
    ip = F.coalesce("ip", F.lit("None"))
    user = F.coalesce("user", F.lit("None"))
    path60 = F.substring("path", 1, 60)
    accepted = "accepted_login" if fixed else "accepted_password"
    triggers = {
        "AUTH-003": ssh & (F.col("event_type") == accepted) & (F.col("user") == "root") & is_external(F.col("ip")),
        "AUTH-004": ssh & (F.col("event_type") == "sudo_command") & contains_any(F.col("command"), fv.RULE_SUDO_WORDS),
        "HTTP-003": apache & contains_any(F.col("path"), fv.RULE_TRAVERSAL_WORDS),
        "HTTP-006": apache & contains_any(F.col("path"), fv.RULE_SENSITIVE_WORDS),
    }
    alerts = {
        "AUTH-003": _line_alert(
            "AUTH-003", by, triggers["AUTH-003"],
            F.concat(F.lit("Root login accepted from external IP "), ip), 1.0,
        ),
        "AUTH-004": _line_alert(
            "AUTH-004", by, triggers["AUTH-004"],
            F.concat(F.lit("User "), user, F.lit(" ran sensitive sudo: "),
                     F.substring("command", 1, 60)),
            0.85,
            F.when(is_blank(F.col("ip")), "localhost").otherwise(F.col("ip")),
        ),
        "HTTP-003": _line_alert(
            "HTTP-003", by, triggers["HTTP-003"],
            F.concat(F.lit("IP "), ip, F.lit(" attempted path traversal: "), path60), 0.88,
        ),
        "HTTP-006": _line_alert(
            "HTTP-006", by, triggers["HTTP-006"],
            F.concat(F.lit("IP "), ip, F.lit(" accessed sensitive path: "), path60), 0.87,
        ),
    }
    fired = F.array_compact(F.array(*[alerts[r] for r in wanted]))
    # Most lines fire no rule: they go before any alert is put together.
    some = reduce(Column.__or__, [F.coalesce(triggers[r], F.lit(False)) for r in wanted], F.lit(False))
    return lines.filter(some).select(F.explode(fired).alias("__alert")).select("__alert.*")


def first_alerts_of(alerts: DataFrame, rule_id: str, n: int = 10) -> DataFrame:
    """The first alerts of a rule in line order, for display."""
    return alerts.filter(F.col("rule_id") == rule_id).orderBy("first_key").limit(n)


def evaluate_rules(
    lines: DataFrame,
    rules: Sequence[str] | None = None,
    by: Sequence[str] = (),
    fixed: bool = False,
) -> DataFrame:
    """Alerts of the chosen rules (default: all) over parsed lines.

    ``by`` names columns that cut the lines into independent batches. Sort by ``rule_ord`` and
    ``first_key`` for the order in which alerts are reported. Lines are read by up to four
    branches; materialise them first when parsing is not trivial.
    """
    wanted = [r.rule_id for r in fv.LINE_RULES if rules is None or r.rule_id in rules]
    by = list(by)
    grouped = [r for r in wanted if r in GROUPED_RULES]
    single = [r for r in wanted if r not in GROUPED_RULES]
    parts = [_grouped_alerts(lines, grouped, by, fixed)] if grouped else []
    if single or not parts:
        parts.append(_single_alerts(lines, single, by, fixed))
    return reduce(DataFrame.unionByName, parts)
