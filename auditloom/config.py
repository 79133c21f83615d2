"""Rule settings. Lists and limits are data: a JSON file can replace any of them between batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

# Keyword and name lists of the default rule set.
SQLI_KEYWORDS = (
    "UNION SELECT", "UNION ALL SELECT", "SLEEP(", "BENCHMARK(", "OR 1=1", "DROP TABLE", "--", "#",
    "INFORMATION_SCHEMA", "UPDATEXML", "EXTRACTVALUE", "WHERE 1=1", "GTID_SUBSET", "JSON_KEYS", "NAME_CONST",
    "UUID_TO_BIN", "LOAD_FILE", "INTO OUTFILE", "INTO DUMPFILE", "mysql.innodb_table_stats", "JSON_ARRAYAGG",
    "MAKE_SET", "EXPORT_SET", "/*!", "1.e(",
)
ADMIN_KEYWORDS = ("GRANT ALL", "CREATE USER", "DROP USER", "UPDATE mysql.user", "SET GLOBAL")
SENSITIVE_NAMES = ("inventory_db", "finance_db", "hr_db", "admin_db")
DUMP_TABLES = ("customers", "employees", "salaries")
DISALLOWED_PROGRAMS = ("sqlmap", "nmap", "python-requests", "curl", "perl")
RESTRICTED_USERS = ("root", "admin")


@dataclass(frozen=True)
class ServiceAccount:
    allowed_ips: tuple[str, ...] = ()
    allowed_hours: tuple[int, ...] = ()


@dataclass(frozen=True)
class RuleConfig:
    # access
    concurrent_ips_limit: int = 1
    concurrent_window: str = "5 minutes"
    brute_force_attempts: int = 5
    brute_force_window: str = "1 minute"
    connect_events: tuple[str, ...] = ("connect", "statement/com/Connect")
    impossible_travel_speed_kmh: float = 800.0
    impossible_travel_min_km: float = 50.0
    # insider
    service_accounts: dict[str, ServiceAccount] = field(default_factory=dict)
    admin_keywords: tuple[str, ...] = ADMIN_KEYWORDS
    admin_exempt_user: str = "root"
    sensitive_tables: tuple[str, ...] = SENSITIVE_NAMES
    sensitive_allowed_users: tuple[str, ...] = ()
    sensitive_safe_hours_start: int = 8
    sensitive_safe_hours_end: int = 17
    late_night_start: str = "22:00:00"
    late_night_end: str = "05:00:00"
    hr_authorized_users: tuple[str, ...] = ()
    restricted_connection_users: tuple[str, ...] = RESTRICTED_USERS
    # technical
    sqli_keywords: tuple[str, ...] = SQLI_KEYWORDS
    execution_time_limit_ms: float = 5000.0
    cpu_time_limit_ms: float = 1000.0
    scan_efficiency_min: float = 0.01
    scan_efficiency_min_rows: int = 1000
    max_query_entropy: float = 4.8
    disallowed_programs: tuple[str, ...] = DISALLOWED_PROGRAMS
    index_evasion_min_rows: int = 1000
    lock_time_limit_ms: float = 500.0
    warning_count_threshold: int = 5
    # destruction
    mass_deletion_rows: int = 500
    old_data_years: tuple[str, ...] = ("2019", "2020", "2021")
    large_dump_tables: tuple[str, ...] = DUMP_TABLES
    large_dump_rows: int = 1000
    # multi-table
    multi_table_window_minutes: int = 4
    multi_table_min_count: int = 3
    session_window_minutes: int = 5
    session_min_tables: int = 2
    # profile
    min_occurrences_threshold: int = 5
    profile_ttl_days: int = 30
    # response
    max_violation_threshold: int = 3
    response_enabled: bool = True
    admin_user: str = ""
    alert_cooldown_seconds: int = 180

    def merged(self, doc: dict) -> "RuleConfig":
        """Settings with every known key found anywhere in ``doc`` replaced (deep merge)."""
        known = {f.name: f for f in fields(self)}
        found: dict = {}

        def walk(node: dict) -> None:
            for k, v in node.items():
                if k == "service_accounts" and isinstance(v, dict):
                    found[k] = {u: ServiceAccount(tuple(c.get("allowed_ips", ())), tuple(c.get("allowed_hours", ())))
                                for u, c in v.items()}
                elif k in known:
                    found[k] = tuple(v) if isinstance(v, list) else v
                elif isinstance(v, dict):
                    walk(v)

        walk(doc)
        return replace(self, **found)

    @classmethod
    def from_json(cls, path: str) -> "RuleConfig":
        with open(path, encoding="utf-8") as fh:
            return cls().merged(json.load(fh))
