"""Public indicator feeds from files: plain lists, delimited lines, JSON, RSS.

One description per feed; every parser takes rows with the feed text and gives
``(source, ioc_type, value_raw, threat_actor, campaign)``.  Caps are off: pass the
result through ``limit_per_source`` where one is wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexvigil.sources.intel import mapped

# ---------------------------------------------------------------------------
# What each feed looks like and how it is labelled.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LineFeed:
    ioc_type: str
    threat_actor: str
    campaign: str
    length: int | None = None
    skip_networks: bool = False
    comments: bool = True


LINE_FEEDS = {
    "bazaar": LineFeed("hash-sha256", "malware", "recent-malware", length=64),
    "firehol": LineFeed("ip", "firehol-level1", "blocklist-aggregated", skip_networks=True),
    "openphish": LineFeed("url", "phishing", "openphish-live", comments=False),
    "emergingthreats": LineFeed("ip", "compromised", "emergingthreats-compromised"),
    "digitalside": LineFeed("ip", "malware", "digitalside-feed"),
    "cinsscore": LineFeed("ip", "suspicious", "cinsscore-feed"),
    "bruteforceblocker": LineFeed("ip", "brute-force", "ssh-brute-force"),
}
THREATFOX_TYPES = {
    "domain": "domain",
    "ip:port": "ip",
    "url": "url",
    "md5_hash": "hash-md5",
    "sha256_hash": "hash-sha256",
    "sha1_hash": "hash-sha1",
}
OTX_TYPES = {
    "IPv4": "ip",
    "IPv6": "ip",
    "domain": "domain",
    "hostname": "domain",
    "URL": "url",
    "FileHash-SHA256": "hash-sha256",
    "FileHash-SHA1": "hash-sha1",
    "FileHash-MD5": "hash-md5",
    "email": "email",
}
PULSEDIVE_TYPES = {"ip": "ip", "domain": "domain", "url": "url"}
CVE_PATTERN = r"CVE-\d{4}-\d{4,}"

COLUMNS = ["source", "ioc_type", "value_raw", "threat_actor", "campaign"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _rows(
    df: DataFrame, source: str, ioc_type: Column, value: Column, actor: Column, campaign: Column, *more: Column
) -> DataFrame:
    return df.select(
        F.lit(source).alias("source"),
        ioc_type.alias("ioc_type"),
        value.alias("value_raw"),
        actor.alias("threat_actor"),
        campaign.alias("campaign"),
        *more,
    )


def line_feed(lines: DataFrame, name: str, column: str = "value") -> DataFrame:
    """IN7: one indicator per line."""
    feed = LINE_FEEDS[name]
    text = F.trim(column)
    df = lines.where(text != "")
    if feed.comments:
        df = df.where(~F.startswith(text, F.lit("#")))
    if feed.length:
        df = df.where(F.length(text) == feed.length)
    if feed.skip_networks:
        df = df.where(~F.contains(text, F.lit("/")))
    return _rows(df, name, F.lit(feed.ioc_type), text, F.lit(feed.threat_actor), F.lit(feed.campaign))


def _unquoted(col: Column) -> Column:
    return F.regexp_replace(col, '^"+|"+$', "")


def _or(value: Column, default: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(default)


def _not_comment(text: Column) -> Column:
    return ~(F.startswith(text, F.lit("#")) | F.startswith(text, F.lit('"#')))


def threatfox(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN8: quote-comma-space separated; ports are cut off addresses, the actor falls back to the malware."""
    text = F.col(column)
    df = lines.where(_not_comment(text)).select(F.split(_unquoted(F.trim(text)), '", "').alias("p"))
    df = df.where(F.size("p") >= 8)
    part = lambda i: _unquoted(F.get("p", F.lit(i)))
    kind = F.coalesce(mapped(part(3), THREATFOX_TYPES), part(3))
    value = F.when(kind == "ip", F.substring_index(part(2), ":", 1)).otherwise(part(2))
    actor = F.when((part(7) != "") & (part(7) != "None"), part(7)).otherwise(part(5))
    return _rows(df, "threatfox", kind, value, actor, part(5))


def urlhaus(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN8: every URL gives a second row with its host."""
    text = F.col(column)
    df = lines.where(_not_comment(text)).select(F.split(_unquoted(F.trim(text)), '","').alias("p"))
    df = df.where(F.size("p") >= 7)
    part = lambda i: _unquoted(F.get("p", F.lit(i)))
    host = F.lower(F.regexp_extract(part(2), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    both = F.array_compact(
        F.array(
            F.struct(F.lit("url").alias("t"), part(2).alias("v")),
            F.when(host != "", F.struct(F.lit("domain").alias("t"), host.alias("v"))),
        )
    )
    df = df.select("p", F.explode(both).alias("x"))
    return _rows(df, "urlhaus", F.col("x.t"), F.col("x.v"), _or(part(6), "unknown"), _or(part(5), "malware-distribution"))


def ssl_blacklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN8: certificate fingerprints of 40 digits."""
    df = lines.where(~F.startswith(column, F.lit("#"))).select(F.split(F.trim(column), ",").alias("p"))
    sha1, reason = F.trim(F.get("p", F.lit(1))), F.trim(F.get("p", F.lit(2)))
    df = df.where((F.size("p") >= 3) & (F.length(sha1) == 40))
    return _rows(df, "ssl-blacklist", F.lit("hash-sha1"), sha1, _or(reason, "unknown"), F.lit("ssl-blacklist"))


def ipsum(lines: DataFrame, column: str = "value", minimum: int = 3) -> DataFrame:
    """IN8: tab separated address and number of lists, from ``minimum`` lists on."""
    text = F.trim(column)
    df = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(F.split(text, "\t").alias("p"))
    count = F.trim(F.get("p", F.lit(1))).try_cast("int")
    df = df.where(count >= minimum)
    return _rows(
        df,
        "ipsum",
        F.lit("ip"),
        F.trim(F.get("p", F.lit(0))),
        F.lit("multi-blacklist"),
        F.concat(F.lit("ipsum-score-"), count.cast("string")),
    )


def dataplane(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN8: pipe separated, the address in the third field."""
    text = F.trim(column)
    df = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(F.split(text, r"\|").alias("p"))
    ip = F.trim(F.get("p", F.lit(2)))
    df = df.where((F.size("p") >= 3) & (ip != ""))
    return _rows(df, "dataplane-ssh", F.lit("ip"), ip, F.lit("ssh-bruteforce"), F.lit("dataplane-sshpwauth"))


def spamhaus(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN8: the network part of each range."""
    text = F.trim(column)
    ip = F.trim(F.substring_index(F.substring_index(text, ";", 1), "/", 1))
    df = lines.where((text != "") & ~F.startswith(text, F.lit(";")) & (ip != ""))
    return _rows(df, "spamhaus-drop", F.lit("ip"), ip, F.lit("spamhaus"), F.lit("drop-hijacked"))


DELIMITED = {
    "threatfox": threatfox,
    "urlhaus": urlhaus,
    "ssl-blacklist": ssl_blacklist,
    "ipsum": ipsum,
    "dataplane-ssh": dataplane,
    "spamhaus-drop": spamhaus,
}


def feodo(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: command-and-control addresses."""
    df = _items(documents, column, "array<struct<ip_address: string, malware: string>>", "d")
    malware = F.coalesce("e.malware", F.lit("unknown"))
    return _rows(df, "feodo", F.lit("ip"), F.col("e.ip_address"), malware, F.concat(malware, F.lit("-c2")))


def known_exploited(documents: DataFrame, column: str = "value", last: int | None = None) -> DataFrame:
    """IN9: catalogue entries used in ransomware campaigns, optionally only the last ones."""
    schema = "vulnerabilities array<struct<cveID: string, vendorProject: string, knownRansomwareCampaignUse: string>>"
    known = F.filter("d.vulnerabilities", lambda v: v.getField("knownRansomwareCampaignUse") == "Known")
    if last is not None:
        known = F.slice(known, F.greatest(F.lit(1), F.size(known) - last + 1), F.lit(last))
    df = documents.select(F.from_json(column, schema).alias("d")).select(F.explode(known).alias("e"))
    return _rows(
        df,
        "cisa-kev",
        F.lit("cve"),
        F.col("e.cveID"),
        F.coalesce("e.vendorProject", F.lit("unknown")),
        F.lit("ransomware-kev"),
    )


def nvd(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: vulnerabilities with the base score of the newest metric that has one."""
    metric = "array<struct<cvssData: struct<baseScore: double>>>"
    schema = (
        "vulnerabilities array<struct<cve: struct<id: string, sourceIdentifier: string, metrics: "
        f"struct<cvssMetricV31: {metric}, cvssMetricV30: {metric}, cvssMetricV2: {metric}>>>>"
    )
    df = documents.select(F.from_json(column, schema).alias("d")).select(F.explode("d.vulnerabilities.cve").alias("e"))
    score = F.coalesce(
        *[
            F.try_element_at(f"e.metrics.{m}", F.lit(1)).getField("cvssData").getField("baseScore")
            for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
        ]
    )
    df = df.where("e.id <> ''").withColumn("cvss_score", score)
    actor = F.coalesce("e.sourceIdentifier", F.lit("unknown"))
    return _rows(df, "nvd", F.lit("cve"), F.col("e.id"), actor, F.lit("nvd-recent"), F.col("cvss_score"))


def abuse_reports(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: reported addresses with their confidence in the campaign."""
    df = _items(documents, column, "data array<struct<ipAddress: string, abuseConfidenceScore: int>>", "d.data")
    confidence = F.coalesce("e.abuseConfidenceScore", F.lit(0)).cast("string")
    df = df.where("e.ipAddress <> ''")
    return _rows(
        df, "abuseipdb", F.lit("ip"), F.col("e.ipAddress"), F.lit("abuse-reported"), F.concat(F.lit("abuseipdb-"), confidence)
    )


def otx(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: indicators of every pulse; unknown types are left out."""
    schema = "results array<struct<name: string, indicators: array<struct<type: string, indicator: string>>>>"
    df = (
        documents.select(F.from_json(column, schema).alias("d"))
        .select(F.explode("d.results").alias("p"))
        .select(F.coalesce("p.name", F.lit("unknown-pulse")).alias("pulse"), F.explode("p.indicators").alias("e"))
    )
    kind = mapped(F.col("e.type"), OTX_TYPES)
    df = df.where(kind.isNotNull() & (F.col("e.indicator") != ""))
    return _rows(df, "otx-alienvault", kind, F.col("e.indicator"), F.col("pulse"), F.col("pulse"))


def pulsedive(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: a bare list or one under ``results``."""
    entry = "struct<type: string, indicator: string, risk: string>"
    bare = F.startswith(F.trim(column), F.lit("["))
    df = documents.select(
        F.when(bare, F.from_json(column, f"array<{entry}>"))
        .otherwise(F.from_json(column, f"results array<{entry}>").getField("results"))
        .alias("x")
    ).select(F.explode("x").alias("e"))
    kind = mapped(F.lower("e.type"), PULSEDIVE_TYPES)
    df = df.where(kind.isNotNull() & (F.col("e.indicator") != ""))
    return _rows(
        df, "pulsedive", kind, F.col("e.indicator"), F.coalesce("e.risk", F.lit("unknown")), F.lit("pulsedive-feed")
    )


def hybrid_analysis(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN9: samples judged malicious."""
    df = _items(documents, column, "data array<struct<sha256: string, threat_level_human: string>>", "d.data")
    df = df.where("e.threat_level_human = 'malicious' AND e.sha256 <> ''")
    return _rows(
        df, "hybrid-analysis", F.lit("hash-sha256"), F.col("e.sha256"), F.lit("malicious"), F.lit("hybrid-analysis-daily")
    )


def _items(documents: DataFrame, column: str, schema: str, path: str) -> DataFrame:
    return documents.select(F.from_json(column, schema).alias("d")).select(F.explode(path).alias("e"))


JSON_FEEDS = {
    "feodo": feodo,
    "cisa-kev": known_exploited,
    "nvd": nvd,
    "abuseipdb": abuse_reports,
    "otx-alienvault": otx,
    "pulsedive": pulsedive,
    "hybrid-analysis": hybrid_analysis,
}


def advisories(documents: DataFrame, source: str = "jpcert", default: str = "jpcert-advisory", column: str = "value") -> DataFrame:
    """IN10: items of an RSS feed; the CVE ids of title and description name the campaign."""
    items = F.regexp_extract_all(column, F.lit(r"(?s)<item[^>]*>(.*?)</item>"), 1)
    df = documents.select(F.explode(items).alias("i"))
    tag = lambda t: F.trim(F.regexp_extract("i", f"(?s)<{t}>(.*?)</{t}>", 1))
    link = tag("link")
    cves = F.regexp_extract_all(F.concat_ws(" ", tag("title"), tag("description")), F.lit(CVE_PATTERN), 0)
    campaign = F.when(F.size(cves) > 0, F.array_join(cves, ", ")).otherwise(default)
    return _rows(df.where(link != ""), source, F.lit("advisory"), link, F.lit(source.upper()), campaign)
