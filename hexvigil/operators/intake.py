"""Normalising, validating and enriching records on their way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.bind import once
from hexvigil.functions.phrases import containing
from hexvigil.functions.scrub import strip_html, unescape_html
from hexvigil.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
SCORE_PATTERN = r"(?i)(?:score|rating)[:\s]+([0-9.]+)"
DETECTION_PATTERN = r"(?i)detection[_\s]rate[:\s]+([0-9.]+)%?"
VENDOR_PATTERN = r"(?i)(?:vendor|tool|product)[:\s]+(\S+)"
DEPLOY_PATTERN = r"(?i)deploy(?:ment)?[_\s]days?[:\s]+(\d+)"

TECHNIQUE_KEYWORDS = [
    ("phishing", "T1566"),
    ("spear phishing", "T1566.001"),
    ("ransomware", "T1486"),
    ("encrypted", "T1486"),
    ("data exfiltration", "T1048"),
    ("exfiltrated", "T1048"),
    ("unauthorized access", "T1078"),
    ("credential", "T1078"),
    ("remote access", "T1133"),
    ("vpn", "T1133"),
    ("lateral movement", "T1021"),
    ("rdp", "T1021.001"),
    ("malware", "T1059"),
    ("command and control", "T1071"),
    ("c2", "T1071"),
    ("supply chain", "T1195"),
    ("third-party", "T1195"),
    ("social engineering", "T1566"),
    ("brute force", "T1110"),
    ("vulnerability", "T1190"),
    ("exploit", "T1190"),
    ("zero-day", "T1190"),
    ("privilege escalation", "T1068"),
    ("data destruction", "T1485"),
    ("denial of service", "T1498"),
    ("ddos", "T1498"),
]
REMEDIATION_KEYWORDS = {
    "containment": ["contained", "isolated", "quarantined", "shut down", "disabled", "blocked"],
    "detection": ["detected", "discovered", "identified", "monitoring", "alert"],
    "eradication": ["removed", "eradicated", "eliminated", "cleaned", "patched", "remediated"],
    "recovery": ["restored", "recovered", "rebuilt", "backup", "resumed operations"],
    "prevention": ["implemented", "enhanced", "strengthened", "deployed", "upgraded", "mfa", "multi-factor"],
}
INCIDENT_DATE_PATTERNS = [
    r"(?i)(?:discovered|detected|identified|occurred|began)\s+(?:[\w\s]{0,30}?)(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})",
    r"(?i)(?:on|around|approximately)\s+(\w+\s+\d{1,2},?\s+\d{4})\s*,?\s*(?:the company|we|the registrant)",
]
INCIDENT_DATE_WORDS = [
    ["discovered", "detected", "identified", "occurred", "began"],
    ["the company", "we", "the registrant"],
]
INCIDENT_ITEM_PATTERN = r"(?is)item\s+1\.05(.*?)(?:item\s+\d|signature|$)"

BREACH_TYPE_TECHNIQUES = {
    "Hacking/IT Incident": ["T1190", "T1078"],
    "Unauthorized Access/Disclosure": ["T1078"],
    "Theft": ["T1052"],
    "Loss": [],
    "Improper Disposal": [],
}
LOCATION_TECHNIQUES = {
    "Network Server": ["T1190"],
    "Email": ["T1566"],
    "Electronic Medical Record": ["T1530"],
    "Laptop": ["T1052"],
    "Desktop Computer": ["T1078"],
    "Other Portable Electronic Device": ["T1052"],
    "Paper/Films": [],
}
COURT_CASE_TECHNIQUES = ["T1078", "T1048"]

SUBPROCESSORS = [
    "crowdstrike", "sentinelone", "palo alto", "zscaler", "okta",
    "cloudflare", "datadog", "splunk", "elastic", "snyk",
    "wiz", "orca", "lacework", "aqua", "sysdig",
    "1password", "keeper", "hashicorp vault",
    "aws", "azure", "gcp", "google cloud",
    "mongodb", "snowflake", "databricks",
    "auth0", "ping identity", "cyberark",
    "proofpoint", "mimecast", "abnormal",
]

INDUSTRY_KEYWORDS = {
    "financial": ["bank", "financ", "invest", "insurance", "capital", "asset", "fund", "credit", "trading", "fintech", "hedge"],
    "healthcare": ["health", "hospital", "clinic", "medic", "pharma", "biotech", "patient", "clinical", "ehr"],
    "tech": ["tech", "software", "saas", "cloud", "startup", "platform", "developer", "cyber", "digital", "ai", "data"],
    "government": ["gov", "federal", "state", "municipal", "department of", "dod", "dhs", "agency", "military", "defense", "intel"],
    "energy": ["energy", "utility", "power", "oil", "gas", "electric", "grid", "solar", "nuclear"],
    "retail": ["retail", "e-commerce", "ecommerce", "store", "shop", "consumer", "brand", "d2c"],
    "manufacturing": ["manufactur", "factory", "industrial", "supply chain", "logistics", "production", "auto"],
    "education": ["university", "college", "school", "educat", "academic", "research", "campus"],
    "media": ["media", "entertainment", "broadcast", "publish", "news", "streaming"],
    "telecom": ["telecom", "wireless", "mobile", "carrier", "isp", "telco"],
    "legal": ["law", "legal", "attorney", "firm", "counsel"],
}
ROLE_KEYWORDS = {
    "ciso": ["ciso", "chief information security", "chief security", "cso"],
    "security-director": ["director", "head of security", "vp security", "vp of security"],
    "security-engineer": ["engineer", "architect", "sre", "devops", "developer"],
    "security-analyst": ["analyst", "soc", "incident response", "threat hunter", "threat intel"],
    "it-manager": ["manager", "administrator", "admin", "it lead", "it ops"],
    "compliance": ["compliance", "audit", "grc", "risk", "governance"],
}
ORG_SIZE_BREAKS = [
    (100, "1-100"),
    (500, "100-500"),
    (1000, "500-1000"),
    (5000, "1000-5000"),
    (10000, "5000-10000"),
    (50000, "10000-50000"),
]
LARGEST_ORG = "50000+"
IDENTIFYING_COLUMNS = ["org_name", "organization", "company", "company_name", "org", "employer"]

EVAL_CATEGORIES = [
    "edr", "siem", "cnapp", "xdr", "soar", "casb", "ztna", "ids", "ips", "waf", "dlp", "pam", "mdr", "ndr", "cspm",
    "cwpp", "devsecops", "email-security", "firewall", "vpn",
]
IOC_TYPES = ["domain", "ip", "hash-sha256", "hash-md5", "url", "email"]
TECHNIQUE_ID_PATTERN = r"^T\d{4}(\.\d{3})?$"
WEB_CATEGORIES = [
    "edr", "siem", "cloud_security", "identity", "email_security", "network_security", "vulnerability_management",
    "waf", "ndr", "soar", "compliance", "security_awareness", "mdr", "other", "general",
]
WEB_DECISIONS = [
    "detection_quality", "price", "support", "integration", "compliance", "executive_mandate", "peer_recommendation",
    "analyst_report",
]

TOOL_ALIASES = [
    ("mde", "ms-defender"),
    ("microsoft defender", "ms-defender"),
    ("defender for endpoint", "ms-defender"),
    ("defender atp", "ms-defender"),
    ("windows defender", "ms-defender"),
    ("cs", "crowdstrike"),
    ("falcon", "crowdstrike"),
    ("crowdstrike falcon", "crowdstrike"),
    ("s1", "sentinelone"),
    ("sentinel one", "sentinelone"),
    ("palo alto", "cortex-xdr"),
    ("cortex", "cortex-xdr"),
    ("pan cortex", "cortex-xdr"),
    ("azure ad", "entra-id"),
    ("aad", "entra-id"),
    ("entra", "entra-id"),
    ("azure active directory", "entra-id"),
    ("sentinel", "ms-sentinel"),
    ("azure sentinel", "ms-sentinel"),
    ("nessus", "tenable"),
    ("insightvm", "rapid7"),
    ("nexpose", "rapid7"),
    ("vault", "hashicorp-vault"),
    ("hashi", "hashicorp-vault"),
    ("hashicorp", "hashicorp-vault"),
    ("cf waf", "cloudflare-waf"),
    ("cf zt", "cloudflare-zt"),
    ("cloudflare access", "cloudflare-zt"),
    ("duo", "cisco-duo"),
    ("prisma", "prisma-cloud"),
    ("prisma cloud", "prisma-cloud"),
    ("rf", "recorded-future"),
    ("qradar", "qradar"),
    ("ibm qradar", "qradar"),
    ("elastic", "elastic-siem"),
    ("elk", "elastic-siem"),
    ("intercept x", "sophos"),
    ("cyberark", "cyberark-pam"),
    ("bt", "beyondtrust"),
]

FRAMEWORK_ALIASES = [
    ("hipaa", "HIPAA"),
    ("hitech", "HITECH"),
    ("pci-dss", "PCI-DSS"),
    ("pci_dss", "PCI-DSS"),
    ("pci dss", "PCI-DSS"),
    ("pcidss", "PCI-DSS"),
    ("soc2", "SOC2"),
    ("soc 2", "SOC2"),
    ("soc2-type2", "SOC2"),
    ("nist csf", "NIST CSF"),
    ("nist-csf", "NIST CSF"),
    ("nist_csf", "NIST CSF"),
    ("nist 800-53", "NIST 800-53"),
    ("nist-800-53", "NIST 800-53"),
    ("nist_800_53", "NIST 800-53"),
    ("fedramp", "FedRAMP"),
    ("fed_ramp", "FedRAMP"),
    ("cmmc", "CMMC"),
    ("cis controls", "CIS Controls"),
    ("cis_controls", "CIS Controls"),
    ("iso27001", "ISO27001"),
    ("iso 27001", "ISO27001"),
    ("iso-27001", "ISO27001"),
    ("nerc cip", "NERC CIP"),
    ("nerc-cip", "NERC CIP"),
    ("nerc_cip", "NERC CIP"),
    ("dora", "DORA"),
    ("glba", "GLBA"),
    ("sox", "SOX"),
    ("fisma", "FISMA"),
    ("iec 62443", "IEC 62443"),
    ("iec-62443", "IEC 62443"),
]
PASSING_STATUSES = ["passing", "pass", "passed", "compliant", "met", "true", "yes", "1"]

# ---------------------------------------------------------------------------


def _literals(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _first_match(text: Column, groups: dict[str, list[str]], default: str) -> Column:
    """Name of the first group with a keyword in the text."""

    def choose(low: Column) -> Column:
        out = None
        for name, words in groups.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(default)

    return once(text, choose)


def bucket_industry(raw: Column) -> Column:
    """T4."""
    return F.when(F.coalesce(raw, F.lit("")) == "", "other").otherwise(
        _first_match(F.lower(raw), INDUSTRY_KEYWORDS, "other")
    )


def bucket_role(raw: Column) -> Column:
    """T4."""
    return F.when(F.coalesce(raw, F.lit("")) == "", "other").otherwise(_first_match(F.lower(raw), ROLE_KEYWORDS, "other"))


def bucket_org_size(raw: Column) -> Column:
    """T4: a bin label stays, else the first number decides; no number gives null."""
    digits = F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"\d+", 0)
    n = F.when(digits != "", digits.cast("decimal(38,0)"))
    out = F.when(raw.isin([label for _, label in ORG_SIZE_BREAKS] + [LARGEST_ORG]), raw)
    for top, label in ORG_SIZE_BREAKS:
        out = out.when(n <= top, label)
    return out.when(n.isNotNull(), LARGEST_ORG)


def bucket_context(df: DataFrame) -> DataFrame:
    """T4: derive industry from the first organisation column, bucket size and role, drop what identifies."""
    orgs = [F.when(F.col(c) != "", F.col(c)) for c in IDENTIFYING_COLUMNS if c in df.columns]
    cols: dict[str, Column] = {}
    if orgs:
        derived = F.coalesce(*orgs)
        guess = F.when(derived.isNotNull(), bucket_industry(derived))
        cols["industry"] = F.coalesce("industry", guess) if "industry" in df.columns else guess
    sizes = [F.col(c).cast("string") for c in ("org_size", "employees") if c in df.columns]
    if sizes:
        raw = F.coalesce(*sizes)
        cols["org_size"] = F.coalesce(bucket_org_size(raw), F.col("org_size").cast("string")) if "org_size" in df.columns else bucket_org_size(raw)
    roles = [F.col(c) for c in ("role", "job_title") if c in df.columns]
    if roles:
        raw = F.coalesce(*roles)
        cols["role_tier"] = F.when(raw != "", bucket_role(raw))
    return df.withColumns(cols).drop(*IDENTIFYING_COLUMNS, "employees", "job_title")


def canonical_vendor(df: DataFrame, names: DataFrame, column: str = "vendor") -> DataFrame:
    """The registered spelling of a vendor whatever its case and padding, else the trimmed input."""
    known = names.select(F.lower("vendor").alias("__k"), F.col("vendor").alias("__canon"))
    return (
        df.join(known, F.lower(F.trim(column)) == F.col("__k"), "left")
        .withColumn(column, F.coalesce("__canon", F.trim(column)))
        .drop("__k", "__canon")
    )


def autocomplete(names: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names that contain the text; nothing below two characters."""
    if len(text) < 2:
        return names.select("vendor").limit(0)
    return names.where(F.lower("vendor").contains(text.lower())).select("vendor").orderBy("vendor").limit(limit)


def competitors(df: DataFrame, categories: DataFrame, market: DataFrame) -> DataFrame:
    """P5: category of a vendor and the ordered competitors of it without the vendor itself.

    ``categories(vendor, category)``, ``market(category, competitors array)``.
    """
    cat = categories.select(F.lower("vendor").alias("__k"), F.col("category").alias("__c"))
    peers = market.select(F.col("category").alias("__pc"), F.col("competitors").alias("__p"))
    return (
        df.join(cat, F.lower(F.trim("vendor")) == F.col("__k"), "left")
        .withColumn("category", F.coalesce("__c", F.lit("other")))
        .join(peers, F.col("category") == F.col("__pc"), "left")
        .withColumn(
            "competitors",
            F.filter(
                F.coalesce("__p", F.array().cast("array<string>")), lambda p: F.lower(p) != F.lower(F.trim("vendor"))
            ),
        )
        .drop("__k", "__c", "__pc", "__p")
    )


def _outside(name: str, low: float, high: float) -> Column:
    return F.when((F.col(name) < low) | (F.col(name) > high), F.lit(f"{name}:range"))


def _too_long(name: str, limit: int) -> Column:
    return F.when(F.length(name) > limit, F.lit(f"{name}:too_long"))


def validate_evals(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """``violations`` of an evaluation; empty when it is valid.  Absent fields are not checked."""
    have = set(df.columns)
    checks: list[Column] = []
    for name, low, high in (
        ("overall_score", 0, 10),
        ("detection_rate", 0, 100),
        ("fp_rate", 0, 100),
        ("cpu_overhead", 0, 100),
        ("deploy_days", 1, 365),
    ):
        if name in have:
            checks.append(_outside(name, low, high))
    for name, limit in (("vendor", 200), ("category", 100), ("notes", 10_000)):
        if name in have:
            checks.append(_too_long(name, limit))
    if "category" in have:
        checks.append(F.when(~F.col("category").isin(categories or EVAL_CATEGORIES), F.lit("category:unknown")))
    if "vendor" in have:
        checks.append(F.when(F.coalesce("vendor", F.lit("")) == "", F.lit("vendor:empty")))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def validate_attack_maps(df: DataFrame, limit: int = 500) -> DataFrame:
    """At least one and at most ``limit`` techniques, every id well formed."""
    ids = F.transform("techniques", lambda t: t.getField("technique_id"))
    n = F.coalesce(F.size("techniques"), F.lit(0))
    bad = F.exists(ids, lambda i: ~F.coalesce(i.rlike(TECHNIQUE_ID_PATTERN), F.lit(False)))
    return df.withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(n <= 0, F.lit("techniques:empty")),
                F.when(n > limit, F.lit("techniques:too_many")),
                F.when(bad, F.lit("technique_id:malformed")),
            )
        ),
    )


def validate_ioc_bundles(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """At least one and at most ``limit`` indicators, known types, 64-digit hashes."""
    n = F.coalesce(F.size("iocs"), F.lit(0))
    bad_type = F.exists("iocs", lambda i: ~F.coalesce(i.getField("ioc_type").isin(IOC_TYPES), F.lit(False)))
    bad_hash = F.exists("iocs", lambda i: F.coalesce(F.length(i.getField("value_hash")), F.lit(0)) != 64)
    return df.withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(n <= 0, F.lit("iocs:empty")),
                F.when(n > limit, F.lit("iocs:too_many")),
                F.when(bad_type, F.lit("ioc_type:unknown")),
                F.when(bad_hash, F.lit("value_hash:length")),
            )
        ),
    )


def match_category(text: Column, categories: list[str]) -> Column:
    """First category that contains the text or is contained in it, with or without underscores; else 'other'."""
    t = F.lower(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", "other")
    for c in categories:
        spaced = c.replace("_", " ")
        hit = F.contains(t, F.lit(c)) | F.contains(t, F.lit(spaced))
        hit = hit | F.contains(F.lit(c), t) | F.contains(F.lit(spaced), t)
        out = out.when(hit, c)
    return out.otherwise("other")


def translate_evals(df: DataFrame) -> DataFrame:
    """Numbers or null, booleans, free text to categories; remaining text is dropped."""
    have = set(df.columns)
    cols: dict[str, Column] = {
        "vendor": F.coalesce("vendor", F.lit("unknown")),
        "category": F.coalesce("category", F.lit("general")),
    }
    for name in dims.NUMERIC_FIELDS:
        if name in have:
            cols[name] = F.col(name).cast("string").try_cast("double")
    for name in dims.BOOL_FIELDS:
        if name in have:
            cols[name] = F.col(name).cast("string").try_cast("boolean")
    for name, values in (
        ("top_strength", dims.STRENGTH_CATEGORIES),
        ("top_friction", dims.FRICTION_CATEGORIES),
        ("decision_factor", dims.DECISION_FACTORS),
    ):
        if name in have:
            cols[name] = F.when(F.col(name) != "", match_category(F.col(name), values))
    keep = [c for c in df.columns if c not in cols and c not in ("notes",)]
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def translate_attack_context(df: DataFrame) -> DataFrame:
    """Severity and times of an attack map to their levels."""
    cols = {}
    for name, levels in (
        ("severity", dims.SEVERITY_LEVELS),
        ("time_to_detect", dims.TIME_BUCKETS),
        ("time_to_contain", dims.TIME_BUCKETS),
    ):
        if name in df.columns:
            cols[name] = F.when(F.col(name) != "", match_category(F.col(name), levels))
    return df.withColumns(cols)


def clean_web_form(df: DataFrame) -> DataFrame:
    """Scores held to 1-10, money marks removed, unknown choices replaced."""

    def held(name: str) -> Column:
        return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col(name).try_cast("double")))

    return df.withColumns(
        {
            "category": F.when(F.col("category").isin(WEB_CATEGORIES), F.col("category")).otherwise("general"),
            "overall_score": F.when(F.col("overall_score").try_cast("double").isNotNull(), held("overall_score")),
            "support_quality": F.when(F.col("support_quality").try_cast("double").isNotNull(), held("support_quality")),
            "annual_cost": F.translate("annual_cost", "$,", "").try_cast("double"),
            "would_buy": F.when(F.col("would_buy") != "", F.col("would_buy") == "yes"),
            "decision_factor": F.when(F.col("decision_factor").isin(WEB_DECISIONS), F.col("decision_factor")),
            "source": F.lit("web"),
        }
    )


def _group(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def text_to_eval(df: DataFrame, text: str = "text", notes_chars: int | None = None) -> DataFrame:
    """IN6: evaluation fields named in free text; texts without a vendor are left out.

    ``notes_chars`` limits the notes (the interactive form keeps 500); by default they stay whole.
    """
    t = F.col(text)
    return (
        df.withColumns(
            {
                "vendor": _group(t, VENDOR_PATTERN),
                "overall_score": _group(t, SCORE_PATTERN).try_cast("double"),
                "detection_rate": _group(t, DETECTION_PATTERN).try_cast("double"),
                "deploy_days": _group(t, DEPLOY_PATTERN).try_cast("int"),
                "category": F.lit("other"),
                "notes": t if notes_chars is None else F.substring(t, 1, notes_chars),
            }
        )
        .where(F.col("vendor").isNotNull())
        .drop(text)
    )


def filing_to_attack_map(df: DataFrame, text: str = "text", description_chars: int | None = None) -> DataFrame:
    """IN16: techniques, remediation categories, incident date and incident section of breach filings.

    The whole filing is searched.  Without a technique keyword the filing counts as T1190.
    """
    t = F.col(text)
    df = df.withColumn("__low", F.lower(t))
    low = F.col("__low")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("t")) for k, i in TECHNIQUE_KEYWORDS])
    found = F.array_distinct(
        F.transform(F.filter(pairs, lambda p: F.contains(low, p.getField("k"))), lambda p: p.getField("t"))
    )
    categories = F.array_compact(
        F.array(
            *[
                F.when(F.exists(_literals(words), lambda w: F.contains(low, w)), F.lit(name))
                for name, words in REMEDIATION_KEYWORDS.items()
            ]
        )
    )
    # The patterns are only tried on texts that hold the words they start with.
    dates = [
        F.when(F.exists(_literals(words), lambda w: F.contains(low, w)), _group(t, pattern))
        for words, pattern in zip(INCIDENT_DATE_WORDS, INCIDENT_DATE_PATTERNS)
    ]
    section = F.when(
        F.contains(low, F.lit("1.05")), strip_html(F.regexp_extract(t, INCIDENT_ITEM_PATTERN, 1))
    ).otherwise("")
    return df.withColumns(
        {
            "techniques": F.sort_array(F.when(F.size(found) > 0, found).otherwise(_literals(["T1190"]))),
            "remediation_categories": F.sort_array(categories),
            "incident_date": F.coalesce(*dates),
            "incident_description": section if description_chars is None else F.substring(section, 1, description_chars),
            "severity": F.lit("high"),
        }
    ).drop(text, "__low")


def _lookup_lists(key: Column, table: dict[str, list[str]]) -> Column:
    out = None
    empty = F.array().cast("array<string>")
    for name, items in table.items():
        value = _literals(items) if items else empty
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(empty)


def breach_to_attack_map(df: DataFrame) -> DataFrame:
    """IN17: techniques by breach type and location, ransomware added to large hacks, severity by size."""
    both = F.array_union(
        _lookup_lists(F.col("breach_type"), BREACH_TYPE_TECHNIQUES), _lookup_lists(F.col("location"), LOCATION_TECHNIQUES)
    )
    large_hack = (F.col("individuals_affected") > 500_000) & (F.col("breach_type") == "Hacking/IT Incident")
    with_ransom = F.when(large_hack, F.array_union(both, _literals(["T1486"]))).otherwise(both)
    return df.withColumns(
        {
            "techniques": F.sort_array(
                F.when(F.size(with_ransom) > 0, with_ransom).otherwise(_literals(["T1078"]))
            ),
            "severity": F.when(F.col("individuals_affected") > 1_000_000, "critical").otherwise("high"),
        }
    )


def court_case_to_attack_map(df: DataFrame) -> DataFrame:
    """IN17: breach lawsuits carry a fixed pair of techniques."""
    return df.withColumns({"techniques": _literals(COURT_CASE_TECHNIQUES), "severity": F.lit("high")})


def subprocessor_evals(
    pages: DataFrame, company: str, html: str = "html", vendors: list[str] | None = None
) -> DataFrame:
    """IN19: one verified-usage evaluation per vendor named anywhere on a page."""
    read = pages.select(F.col(company).alias("company"), F.lower(strip_html(F.col(html))).alias("__clean"))
    named = F.filter(_literals(vendors or SUBPROCESSORS), lambda v: F.contains(F.col("__clean"), v))
    return read.select("company", F.explode(named).alias("__v")).select(
        "company",
        F.initcap("__v").alias("vendor"),
        F.lit("verified_usage").alias("category"),
        F.lit(True).alias("chose_this_vendor"),
        F.concat(F.lit("soc2-subprocessor-"), F.lower("company")).alias("source"),
    )


def _clamp10(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))


# IN20: lab results to 0-10 scores.
LAB_SCORES = {
    "detection_share": lambda rate: rate / 10,
    "points": lambda total, maximum: total / maximum * 10,
    "accuracy": lambda tar: tar / 10,
    "accuracy_fp": lambda lar: (100.0 - lar) / 10,
    "block_rate": lambda block, alarms: _clamp10((block - 98.0) * 5.0 - alarms * 0.1),
    "attack_evaluation": lambda rate: rate / 11.5,
    "protection_tests": lambda protection, performance, usability: (protection + performance + usability) / 18.0 * 10,
    "stars": lambda stars: stars * 2,
}


def lab_score(kind: str, *columns: Column) -> Column:
    """IN20: score of a lab result; displayed with one digit by the reports."""
    return LAB_SCORES[kind](*columns)


def catalogue_risk(vulnerabilities: DataFrame, keywords: list[tuple[str, str]], excluded: list[str] = ()) -> DataFrame:
    """IN21: risk score per vendor from a vulnerability catalogue; the first keyword of the list wins.

    ``keywords(keyword, vendor_id)``; the first ten ids are kept in catalogue order.
    """
    usable = [(k, v) for k, v in keywords if k not in excluded]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in usable])
    combined = F.concat_ws(" ", F.lower(F.coalesce("vendor_project", F.lit(""))), F.lower(F.coalesce("product", F.lit(""))))
    hits = F.filter(pairs, lambda p: F.contains(F.col("__both"), p.getField("k")))
    matched = (
        vulnerabilities.withColumn("__both", combined)
        .withColumn("vendor_id", F.try_element_at(hits, F.lit(1)).getField("v"))
        .where(F.col("vendor_id").isNotNull())
        .select("vendor_id", "cve_id", "ransomware", "date_added")
    )
    stats = matched.groupBy("vendor_id").agg(
        F.count("*").alias("cve_count"),
        F.count(F.when(F.col("ransomware") == "Known", 1)).alias("ransomware_count"),
        F.max("date_added").alias("latest"),
    )
    order = Window.partitionBy("vendor_id").orderBy("cve_id")
    first = (
        matched.withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= 10)
        .groupBy("vendor_id")
        .agg(F.sort_array(F.collect_list("cve_id")).alias("first_cves"))
    )
    score = _clamp10(10 - F.col("cve_count") * 1.5)
    return stats.join(first, "vendor_id").withColumn("risk_score", score)


def repository_popularity(repos: DataFrame, top: int | None = None) -> DataFrame:
    """IN22: stars, forks, issues over a vendor's repositories, or its ``top`` most starred; score = min(10, stars / 1000)."""
    if top is not None:
        order = Window.partitionBy("vendor_id").orderBy(F.col("stars").desc(), "repo")
        repos = repos.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top)
    return (
        repos.groupBy("vendor_id")
        .agg(
            F.sum("stars").alias("total_stars"),
            F.sum("forks").alias("total_forks"),
            F.sum("issues").alias("total_issues"),
            F.max("updated_at").alias("latest_update"),
            F.count("*").alias("repos"),
        )
        .withColumn("score", F.least(F.lit(10.0), F.col("total_stars") / 1000.0))
    )


def community_corpus(
    posts: DataFrame,
    top: int | None = None,
    min_chars: int = 0,
    key_chars: int | None = None,
    post_chars: int | None = None,
    separator: str = "\n\n---\n",
) -> DataFrame:
    """IN23: cleaned, deduplicated posts of a vendor joined to one text, best ``rank`` first.

    ``posts(vendor, rank, raw)``.  All posts that say anything are compared and kept whole;
    ``top``, ``min_chars``, ``key_chars`` and ``post_chars`` give the cuts of the scrapers.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(unescape_html(F.col("raw")), r"<[^>]+>", " "), r"\s{2,}", " "))
    texts = posts.select("vendor", "rank", clean.alias("post")).where(F.length("post") > min_chars)
    key = F.sha2(F.col("post") if key_chars is None else F.substring("post", 1, key_chars), 256)
    unique = (
        texts.withColumn("__k", key).groupBy("vendor", "__k").agg(F.min(F.struct("rank", "post")).alias("p"))
    )
    order = Window.partitionBy("vendor").orderBy("__rank")
    post = F.col("p.post") if post_chars is None else F.substring("p.post", 1, post_chars)
    picked = (
        unique.select("vendor", F.col("p.rank").alias("__rank"), post.alias("post"))
        .withColumn("place", F.row_number().over(order))
    )
    if top is not None:
        picked = picked.where(F.col("place") <= top)
    return picked.groupBy("vendor").agg(
        F.count("*").alias("posts"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("place", "post"))), lambda x: x.getField("post")
            ),
            separator,
        ).alias("corpus"),
    )


def match_tools(tools: DataFrame, registry: DataFrame, aliases: list[tuple[str, str]] = TOOL_ALIASES) -> DataFrame:
    """IN24: vendor id and rule of every distinct tool name, by seven rules in order of priority; null where none holds.

    Equal names (rules 1 and 3) and the few aliases (2 and 5) meet in equi-joins and literals.  A display name that holds
    the tool's (4) and ids that the tool's name holds (6, with spaces for dashes 7) are found through an index of
    character n-grams, so work follows the matches and neither table is carried whole.  Of several vendors of a rule the
    smallest id counts, of aliases the first.
    """
    distinct = tools.select("tool").where(F.trim("tool") != "").distinct().withColumn("name", F.lower(F.trim("tool")))
    distinct = cut_lineage(distinct)  # seven rules read the names, the table behind them is read once
    names = distinct.select("name").distinct()
    low = F.lower("vendor_id")
    keyed = registry.select(
        "vendor_id", low.alias("low"), F.replace(low, F.lit("-"), F.lit(" ")).alias("spaced"), F.lower("display_name").alias("display")
    )

    def smallest(column: str) -> DataFrame:
        return keyed.groupBy(F.col(column).alias("key")).agg(F.min("vendor_id").alias("vendor_id"))

    def hits(found: DataFrame, rule: int, place: Column | None = None) -> DataFrame:
        return found.select("name", F.struct(F.lit(rule).alias("rule"), (F.lit(0) if place is None else place).alias("place"), "vendor_id").alias("hit"))

    def by_alias(rule: int, test) -> DataFrame:
        options = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("a"), F.lit(v).alias("vendor_id")) for i, (a, v) in enumerate(aliases)])
        first = F.try_element_at(F.filter(options, lambda e: test(e.getField("a"))), F.lit(1))
        found = names.select("name", first.alias("e")).where("e is not null").select("name", "e.place", "e.vendor_id")
        return hits(found, rule, F.col("place"))

    def equal(column: str) -> DataFrame:
        return names.join(smallest(column).withColumnRenamed("key", "name"), "name")

    inside = containing(keyed.select(F.col("display").alias("long")), names.select(F.col("name").alias("short")))
    inside = inside.withColumnsRenamed({"long": "key", "short": "name"}).join(smallest("display"), "key")
    every = [hits(equal("low"), 1), hits(equal("display"), 3), hits(inside, 4)]
    if aliases:
        name = F.col("name")
        every += [by_alias(2, lambda a: a == name), by_alias(5, lambda a: F.contains(name, a))]
    for rule, column in ((6, "low"), (7, "spaced")):
        part = containing(names.select(F.col("name").alias("long")), keyed.select(F.col(column).alias("short")))
        every.append(hits(part.withColumnsRenamed({"long": "name", "short": "key"}).join(smallest(column), "key"), rule))
    best = reduce(DataFrame.unionByName, every).groupBy("name").agg(F.min("hit").alias("hit"))
    return distinct.join(best, "name", "left").select("tool", F.col("hit.vendor_id"), F.col("hit.rule"))


def framework_coverage(controls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """IN25: a framework is covered when any of its controls passes; spellings are unified."""
    pairs = [F.lit(x) for pair in FRAMEWORK_ALIASES for x in pair]
    known = F.create_map(*pairs)
    name = F.trim("framework")
    canonical = F.coalesce(F.try_element_at(known, F.lower(name)), name)
    passing = F.lower(F.trim(F.col("status").cast("string"))).isin(PASSING_STATUSES)
    return (
        controls.where(F.coalesce(name, F.lit("")) != "")
        .groupBy(*by, canonical.alias("framework"))
        .agg(
            F.coalesce(F.bool_or(passing), F.lit(False)).alias("covered"),
            F.count("*").alias("controls"),
            F.count(F.when(passing, 1)).alias("passing"),
        )
    )
