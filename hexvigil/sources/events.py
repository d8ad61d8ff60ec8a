"""Security events: CEF lines, EDR detections, webhook bodies.

Every function works on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil import dims
from hexvigil.functions.bind import kept
from hexvigil.functions.hashing import indicator_hash
from hexvigil.operators.intake import match_category
from hexvigil.sources.intel import mapped

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
CEF_HEADER = r"(?s)CEF:(\d+\|.*)"
CEF_FIELDS = {
    "src": "ip",
    "dst": "ip",
    "shost": "domain",
    "dhost": "domain",
    "sourceAddress": "ip",
    "destinationAddress": "ip",
    "sourceHostName": "domain",
    "destinationHostName": "domain",
    "requestUrl": "url",
    "request": "url",
    "fileHash": "hash-sha256",
    "fileHashMd5": "hash-md5",
    "fileHashSha256": "hash-sha256",
    "fileHashSha1": "hash-sha1",
    "cs1": "url",
    "cs2": "domain",
    "fname": "filename",
    "filePath": "filepath",
    "sntdom": "domain",
    "dntdom": "domain",
}
CEF_EMPTY = ["-", "N/A", "none", "null"]
CEF_SKIPPED = ["filename", "filepath"]
DETECTION_SCHEMA = (
    "detection_id string, max_severity_displayname string, device struct<external_ip: string>, "
    "behaviors array<struct<technique_id: string, technique: string, tactic: string, tactic_id: string, "
    "sha256: string, md5: string, filename: string, filepath: string, description: string, scenario: string, "
    "timestamp: string>>"
)
WEBHOOK_SCHEMA = (
    "detection struct<technique: string, tactic: string, severity: string, scenario: string, ioc_type: string, "
    "ioc_value: string>, "
    "properties struct<title: string, severity: string, tactics: array<string>, techniques: array<string>, "
    "entities: array<struct<kind: string, type: string, address: string, hostName: string, hashValue: string, "
    "url: string, properties: struct<address: string, hostName: string, hashValue: string, url: string>>>>, "
    "cef string, source string, "
    "indicators array<struct<type: string, value: string>>, "
    "iocs array<struct<ioc_type: string, value_hash: string, value_raw: string, value: string>>"
)
ENTITY_TYPES = {"ip": "ip", "host": "domain", "filehash": "hash-sha256", "hash": "hash-sha256", "url": "url"}


def parse_cef(lines: DataFrame, column: str = "value") -> DataFrame:
    """IN13: header fields and ``extensions array<struct<key, value>>`` of CEF lines; others are left out."""
    text = F.col(column)
    names = ["version", "device_vendor", "device_product", "device_version", "signature_id", "event_name", "severity"]
    # The header is found once and cut at its seven bars; what follows the last one are the extensions.
    fields = F.split(F.regexp_extract(text, CEF_HEADER, 1), r"\|", len(names) + 1)
    hits = lines.withColumn("__f", fields).where(F.size("__f") == len(names) + 1)
    header = {n: F.get("__f", F.lit(i)) for i, n in enumerate(names)}
    return hits.withColumns(header).withColumn("extensions", cef_extensions(F.get("__f", F.lit(len(names))))).drop("__f")


def cef_extensions(raw: Column) -> Column:
    """key=value pairs in order; pairs without key or value are dropped, a repeated key stays repeated."""
    parts = F.split(F.trim(raw), r"\s+(?=\w+=)")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.regexp_replace(p, "(?s)^[^=]*=?", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: (p.getField("key") != "") & (p.getField("value") != ""))


def cef_iocs(parsed: DataFrame) -> DataFrame:
    """IN13: one hashed indicator per known extension; of a repeated key the last value counts."""
    # Later pairs win: a key of the list is dropped when it comes again further on.
    pairs = F.transform(
        "extensions",
        lambda e, i: F.struct(
            i.alias("i"), e.getField("key").alias("key"), F.trim(e.getField("value")).alias("value")
        ),
    )
    return (
        parsed.withColumn("__pairs", pairs)
        .withColumn(
            "__last",
            F.filter(
                "__pairs",
                lambda p: ~F.exists(
                    "__pairs",
                    lambda o: (o.getField("key") == p.getField("key")) & (o.getField("i") > p.getField("i")),
                ),
            ),
        )
        .withColumn("__e", F.explode("__last"))
        .withColumn("ioc_type", mapped(F.col("__e.key"), CEF_FIELDS))
        .where(
            F.col("ioc_type").isNotNull()
            & ~F.col("ioc_type").isin(CEF_SKIPPED)
            & ~F.col("__e.value").isin(CEF_EMPTY)
        )
        .withColumn("value_hash", F.sha2(F.lower("__e.value"), 256))
        .withColumn("source", F.concat_ws(":", F.lit("cef"), "device_vendor", "device_product"))
        .drop("__pairs", "__last", "__e", "extensions")
    )


def edr_detections(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN14: technique, severity and one indicator of a detection.

    The first behaviour counts; its SHA-256 goes before the device address, its MD5
    only where neither is known.  Detections with neither technique nor indicator are dropped.
    """
    d = documents.withColumn("d", F.from_json(column, DETECTION_SCHEMA)).where(F.size("d.behaviors") > 0)
    d = d.withColumn("b", F.get("d.behaviors", F.lit(0)))

    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    sha, ip, md5 = filled("b.sha256"), filled("d.device.external_ip"), filled("b.md5")
    value = F.coalesce(sha, ip, md5)
    kind = (
        F.when(sha.isNotNull(), "hash-sha256").when(ip.isNotNull(), "ip").when(md5.isNotNull(), "hash-md5")
    )
    technique = F.coalesce(filled("b.technique_id"), filled("b.technique"))
    return d.where(technique.isNotNull() | value.isNotNull()).select(
        *[c for c in documents.columns if c != column],
        F.col("d.detection_id").alias("detection_id"),
        technique.alias("technique_id"),
        F.coalesce(filled("b.tactic"), filled("b.tactic_id")).alias("tactic"),
        F.lower(F.coalesce("d.max_severity_displayname", F.lit("Medium"))).alias("severity"),
        F.col("b.scenario").alias("scenario"),
        kind.alias("ioc_type"),
        F.when(value.isNotNull(), indicator_hash(value)).alias("value_hash"),
    )


def parse_webhooks(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN15: body and ``format`` of webhook calls; the first known key decides."""
    w = documents.withColumn("w", kept(F.from_json(column, WEBHOOK_SCHEMA)))
    fmt = F.when(F.col("w.detection").isNotNull(), "detection")
    for name in ("properties", "cef", "indicators", "iocs"):
        fmt = fmt.when(F.col(f"w.{name}").isNotNull(), name)
    return w.withColumn("format", fmt.otherwise("unknown")).drop(column)


def webhook_techniques(webhooks: DataFrame) -> DataFrame:
    """IN15: attack-map rows of detections and incidents, the severity as a level."""
    det = F.col("w.detection")
    prop = F.col("w.properties")
    item = "struct<technique_id:string,tactic:string,threat_name:string,severity:string,source:string>"
    one = F.when(
        (F.col("format") == "detection") & (F.coalesce(det.getField("technique"), F.lit("")) != ""),
        F.array(
            F.struct(
                det.getField("technique").alias("technique_id"),
                det.getField("tactic").alias("tactic"),
                F.coalesce(det.getField("scenario"), F.lit("EDR Detection")).alias("threat_name"),
                F.coalesce(det.getField("severity"), F.lit("medium")).alias("severity"),
                F.lit("edr").alias("source"),
            )
        ),
    )
    many = F.when(
        F.col("format") == "properties",
        F.transform(
            F.coalesce(prop.getField("techniques"), F.array().cast("array<string>")),
            lambda t: F.struct(
                t.alias("technique_id"),
                F.lit(None).cast("string").alias("tactic"),
                F.coalesce(prop.getField("title"), F.lit("SIEM Incident")).alias("threat_name"),
                F.coalesce(prop.getField("severity"), F.lit("Medium")).alias("severity"),
                F.lit("siem").alias("source"),
            ),
        ),
    )
    rows = F.coalesce(one, many, F.array().cast(f"array<{item}>"))
    keep = [c for c in webhooks.columns if c not in ("w", "format")]
    return webhooks.select(*keep, F.explode(rows).alias("t")).select(
        *keep,
        "t.technique_id",
        "t.tactic",
        "t.threat_name",
        match_category(F.col("t.severity"), dims.SEVERITY_LEVELS).alias("severity"),
        "t.source",
    )


def webhook_iocs(webhooks: DataFrame) -> DataFrame:
    """IN15: hashed indicators of every body shape."""
    item = "array<struct<ioc_type:string,value_hash:string,source:string>>"

    def ioc(kind: Column, value: Column, source: Column, hashed: Column | None = None) -> Column:
        h = F.when(F.coalesce(value, F.lit("")) != "", indicator_hash(value))
        return F.struct(
            kind.alias("ioc_type"),
            (h if hashed is None else F.coalesce(F.when(hashed != "", hashed), h)).alias("value_hash"),
            source.alias("source"),
        )

    det = F.col("w.detection")
    detection = F.when(
        F.coalesce(det.getField("ioc_type"), F.lit("")) != "",
        F.array(ioc(det.getField("ioc_type"), det.getField("ioc_value"), F.lit("edr"))),
    )

    def entity(e: Column) -> Column:
        def either(name: str) -> Column:
            return F.coalesce(
                F.when(e.getField(name) != "", e.getField(name)), e.getField("properties").getField(name)
            )

        kind = F.lower(F.coalesce(e.getField("kind"), e.getField("type"), F.lit("")))
        addr, host, digest, url = either("address"), either("hostName"), either("hashValue"), either("url")
        own = (
            F.when(kind == "ip", addr)
            .when(kind == "host", host)
            .when(kind.isin("filehash", "hash"), digest)
            .when(kind == "url", url)
        )
        label = F.when(own.isNotNull(), mapped(kind, ENTITY_TYPES)).when(addr.isNotNull(), "ip").when(
            host.isNotNull(), "domain"
        )
        return ioc(label, F.coalesce(own, addr, host), F.lit("siem"))

    entities = F.transform(F.col("w.properties.entities"), entity)
    listed = F.transform(
        F.col("w.indicators"),
        lambda i: ioc(
            F.coalesce(i.getField("type"), F.lit("unknown")),
            i.getField("value"),
            F.coalesce(F.col("w.source"), F.lit("indicators")),
        ),
    )
    generic = F.transform(
        F.col("w.iocs"),
        lambda i: ioc(
            F.coalesce(i.getField("ioc_type"), F.lit("unknown")),
            F.coalesce(F.when(i.getField("value_raw") != "", i.getField("value_raw")), i.getField("value")),
            F.coalesce(F.col("w.source"), F.lit("webhook")),
            i.getField("value_hash"),
        ),
    )
    fmt = F.col("format")
    rows = (
        F.when(fmt == "detection", detection)
        .when(fmt == "properties", entities)
        .when(fmt == "indicators", listed)
        .when(fmt == "iocs", generic)
    )
    keep = [c for c in webhooks.columns if c not in ("w", "format")]
    direct = webhooks.select(*keep, F.explode(F.coalesce(rows, F.array().cast(item))).alias("i")).select(
        *keep, "i.ioc_type", "i.value_hash", "i.source"
    )
    cef = cef_iocs(parse_cef(webhooks.where(fmt == "cef").select(*keep, F.col("w.cef").alias("value")))).select(
        *keep, "ioc_type", "value_hash", "source"
    )
    return direct.unionByName(cef).where(F.col("value_hash").isNotNull() & F.col("ioc_type").isNotNull())
