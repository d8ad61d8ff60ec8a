"""Small fixed dimensions.

Every table here is a literal of known size.  ``frame`` turns one into an inline
relation, so Catalyst knows its size and decides about broadcasting by itself;
``values`` gives the same rows as SQL text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# These must equal the published behaviour for results to agree.
# ---------------------------------------------------------------------------

SOURCE_WEIGHTS = [
    ("mitre", 3.0),
    ("mitre-attack-evals", 3.0),
    ("av-test", 2.5),
    ("selabs", 2.5),
    ("cisa-kev", 2.0),
    ("community", 1.5),
    ("reddit", 1.0),
    ("hackernews", 1.0),
    ("g2", 0.8),
    ("gartner", 0.8),
    ("forrester", 0.8),
]

# Spellings that feeds emit for sources that carry a weight under another name.
SOURCE_ALIASES = [
    ("reddit-community", "reddit"),
    ("hackernews-community", "hackernews"),
    ("gartner-peer-insights", "gartner"),
    ("cisa-kev-vendors", "cisa-kev"),
]

INDUSTRY_BASELINES = [
    # vertical, spearphishing, vpn, rdp, dwell days, recovery weeks, with backups, ransom paid, exfiltrated, double extortion
    ("healthcare", 89.0, 23.0, 15.0, 4.2, 2.1, 0.4, 12.0, 67.0, 72.0),
    ("financial", 78.0, 31.0, 8.0, 28.0, 1.5, 0.3, 8.0, 82.0, 45.0),
    ("energy", 62.0, 45.0, 28.0, 56.0, 3.2, 0.8, 18.0, 54.0, 38.0),
    ("government", 85.0, 19.0, 5.0, 78.0, 2.8, 0.5, 4.0, 91.0, 22.0),
]
BASELINE_COLUMNS = [
    "vertical",
    "spearphishing_pct",
    "vpn_exploit_pct",
    "rdp_exposed_pct",
    "avg_dwell_time_days",
    "avg_recovery_weeks",
    "avg_recovery_with_backups_weeks",
    "ransom_paid_pct",
    "data_exfiltrated_pct",
    "double_extortion_pct",
]

ATTACK_CHAINS = {
    ("healthcare", "Classic Ransomware"): ["T1566.001", "T1059.001", "T1021.001", "T1003.001", "T1490", "T1486"],
    ("healthcare", "Double Extortion"): ["T1566.001", "T1059.001", "T1003.001", "T1048", "T1486"],
    ("financial", "APT Credential Harvest"): ["T1566.001", "T1204", "T1059.001", "T1003.001", "T1055", "T1048"],
    ("financial", "BEC Wire Fraud"): ["T1566.001", "T1078", "T1114", "T1048"],
    ("energy", "ICS/OT Pivot"): ["T1190", "T1059.001", "T1021.001", "T1562.001", "T0855"],
    ("energy", "Ransomware (IT-side)"): ["T1566.001", "T1059.001", "T1021.001", "T1490", "T1486"],
    ("government", "Supply Chain Compromise"): ["T1195", "T1059.001", "T1003.001", "T1048"],
    ("government", "Diplomatic Phishing"): ["T1566.001", "T1204", "T1059.001", "T1003.001", "T1055", "T1048"],
}

PRIORITY_TECHNIQUES = {
    "healthcare": ["T1486", "T1490", "T1566.001", "T1021.001", "T1059.001", "T1070.001", "T1562.001", "T1048"],
    "financial": ["T1566.001", "T1003.001", "T1055", "T1048", "T1059.001", "T1021.001", "T1486", "T1053.005"],
    "energy": ["T0855", "T1190", "T1059.001", "T1021.001", "T1486", "T1562.001", "T1048", "T1070.001"],
    "government": ["T1195.002", "T1566.001", "T1003.001", "T1059.001", "T1021.001", "T1048", "T1055", "T1070.001"],
}

VERTICAL_COMPLIANCE = {
    "healthcare": ["HIPAA", "HITECH", "FDA 21 CFR Part 11", "NIST CSF"],
    "financial": ["PCI DSS", "SOX", "GLBA", "FFIEC", "DORA", "NIST CSF"],
    "energy": ["NERC CIP", "TSA Security Directives", "IEC 62443", "NIST SP 800-82"],
    "government": ["FedRAMP", "FISMA", "NIST 800-53", "CMMC", "CISA BOD"],
}

TACTIC_RATES = {
    "initial-access": {"email": 0.85, "iam": 0.80, "ztna": 0.75, "waf": 0.70, "vm": 0.60, "edr": 0.40, "ndr": 0.30},
    "execution": {"edr": 0.90, "siem": 0.50, "ndr": 0.30},
    "lateral-movement": {"ndr": 0.80, "edr": 0.75, "pam": 0.70, "ztna": 0.65, "siem": 0.50},
    "credential-access": {"edr": 0.85, "pam": 0.80, "iam": 0.60, "siem": 0.50},
    "defense-evasion": {"edr": 0.70, "siem": 0.40, "ndr": 0.35},
    "exfiltration": {"ndr": 0.75, "dlp": 0.70, "ztna": 0.60, "siem": 0.50, "edr": 0.40},
    "impact": {"edr": 0.85, "siem": 0.60},
    "persistence": {"edr": 0.80, "siem": 0.55, "iam": 0.50},
    "privilege-escalation": {"edr": 0.80, "pam": 0.75, "siem": 0.45},
    "discovery": {"edr": 0.65, "ndr": 0.60, "siem": 0.45},
    "collection": {"edr": 0.60, "dlp": 0.70, "ndr": 0.50},
    "command-and-control": {"ndr": 0.80, "ztna": 0.65, "edr": 0.50, "siem": 0.40},
}

TACTICS = [
    "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access",
    "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]

REMEDIATION_PHASES = [
    ("containment", "Containment (NIST SP 800-61r2 §3.3)"),
    ("detection", "Detection & Analysis (NIST SP 800-61r2 §3.2)"),
    ("eradication", "Eradication (NIST SP 800-61r2 §3.4)"),
    ("recovery", "Recovery (NIST SP 800-61r2 §3.4)"),
    ("prevention", "Preparation (NIST SP 800-61r2 §3.1)"),
]

STRENGTH_CATEGORIES = [
    "detection_quality", "response_speed", "low_false_positives", "threat_coverage", "deployment_ease",
    "integration_quality", "support_quality", "reporting", "automation", "cost_value",
]
FRICTION_CATEGORIES = [
    "high_false_positives", "deployment_difficulty", "poor_documentation", "performance_impact",
    "integration_issues", "support_quality", "cost", "complexity", "alert_fatigue", "missing_features",
]
DECISION_FACTORS = [
    "price", "detection", "support", "integration", "compliance", "executive_mandate", "peer_recommendation",
    "analyst_report",
]
REMEDIATION_CATEGORIES = ["containment", "detection", "eradication", "recovery", "prevention"]
EFFECTIVENESS_LEVELS = ["stopped_attack", "slowed_attack", "no_effect", "made_worse"]
TIME_BUCKETS = ["minutes", "hours", "days", "weeks"]
SEVERITY_LEVELS = ["critical", "high", "medium", "low"]

NUMERIC_FIELDS = [
    "overall_score", "detection_rate", "fp_rate", "deploy_days", "cpu_overhead", "ttfv_hours", "eval_duration_days",
    "annual_cost", "per_seat_cost", "contract_length_months", "discount_pct",
    "support_sla_hours", "support_quality", "escalation_ease",
    "agent_memory_mb", "scan_latency_ms",
]
BOOL_FIELDS = ["would_buy", "data_exfiltrated", "ransom_paid", "chose_this_vendor"]
CATEGORICAL_FIELDS = [
    "top_strength", "top_friction", "severity", "time_to_detect", "time_to_contain", "time_to_recover",
    "decision_factor",
]

# Field: sensitivity, lowest, highest value
EVAL_SENSITIVITY = {
    "overall_score": (10.0, 0.0, 10.0),
    "detection_rate": (100.0, 0.0, 100.0),
    "fp_rate": (100.0, 0.0, 100.0),
    "deploy_days": (365.0, 0.0, 365.0),
    "cpu_overhead": (100.0, 0.0, 100.0),
    "ttfv_hours": (720.0, 0.0, 720.0),
    "eval_duration_days": (365.0, 0.0, 365.0),
}

# Weights of the six behavioural features, in feature order.
FEATURE_WEIGHTS = [0.10, 0.10, 0.10, 0.30, 0.25, 0.15]

# ---------------------------------------------------------------------------
# Tables over the values above
# ---------------------------------------------------------------------------


def chain_steps() -> list[tuple]:
    return [
        (vertical, chain, step, technique)
        for (vertical, chain), steps in ATTACK_CHAINS.items()
        for step, technique in enumerate(steps, 1)
    ]


def priority_rows() -> list[tuple]:
    return [(v, rank, t) for v, techniques in PRIORITY_TECHNIQUES.items() for rank, t in enumerate(techniques)]


def compliance_rows() -> list[tuple]:
    return [(v, f) for v, frameworks in VERTICAL_COMPLIANCE.items() for f in frameworks]


def tactic_rate_rows() -> list[tuple]:
    return [(tactic, category, rate) for tactic, rates in TACTIC_RATES.items() for category, rate in rates.items()]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}E0"
    if isinstance(value, int):
        return str(value)
    if "'" in value or "\\" in value:
        raise ValueError("dimension literals hold no quotes")
    return f"'{value}'"


def values(rows: list[tuple], columns: list[str], alias: str = "t") -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {alias}({', '.join(columns)}))"


def frame(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    return spark.sql("SELECT * FROM " + values(rows, columns))
