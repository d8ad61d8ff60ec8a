"""Threat-intelligence exchange formats: STIX bundles, MISP events, Navigator layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexvigil.functions.bind import kept
from hexvigil.functions.hashing import indicator_hash
from hexvigil.operators.techniques import technique_lookup

# ---------------------------------------------------------------------------
# Formats and type names
# ---------------------------------------------------------------------------
STIX_PATTERN = r"\[(\S+):value\s*=\s*'([^']+)'"
STIX_TYPES = {
    "domain-name": "domain",
    "ipv4-addr": "ip",
    "ipv6-addr": "ip",
    "url": "url",
    "email-addr": "email",
    "file:hashes.'MD5'": "hash-md5",
    "file:hashes.'SHA-256'": "hash-sha256",
}
MISP_TYPES = {
    "domain": "domain",
    "domain|ip": "domain",
    "ip-dst": "ip",
    "ip-src": "ip",
    "url": "url",
    "email-src": "email",
    "email-dst": "email",
    "md5": "hash-md5",
    "sha256": "hash-sha256",
    "sha1": "hash-sha1",
    "filename|md5": "hash-md5",
    "filename|sha256": "hash-sha256",
}
STIX_SCHEMA = (
    "type string, id string, objects array<struct<type: string, id: string, name: string, pattern: string, "
    "external_references: array<struct<source_name: string, external_id: string>>, "
    "kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>>"
)
MISP_SCHEMA = "Event struct<uuid: string, info: string, Attribute: array<struct<type: string, value: string>>>"
LAYER_SCHEMA = "name string, techniques array<struct<techniqueID: string, score: double, tactic: string, comment: string>>"
ATTACK_SOURCE = "mitre-attack"


def mapped(key: Column, table: dict[str, str]) -> Column:
    """Value of a fixed map, null for other keys."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _first(items: Column, test, field: str) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1)).getField(field)


def parse_stix(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN4: bundles as parsed rows; anything that is no bundle is left out."""
    parsed = documents.withColumn("b", kept(F.from_json(column, STIX_SCHEMA))).where("b.type = 'bundle'")
    actors = F.filter("b.objects", lambda o: o.getField("type") == "threat-actor")
    return parsed.select(
        F.col("b.id").alias("bundle_id"),
        F.try_element_at(actors, F.lit(-1)).getField("name").alias("threat_name"),
        F.col("b.objects").alias("objects"),
    )


def stix_techniques(bundles: DataFrame) -> DataFrame:
    """IN4: attack patterns with their technique id (object id without one) and tactic."""
    o = F.col("o")
    return (
        bundles.select("bundle_id", "threat_name", F.explode("objects").alias("o"))
        .where("o.type = 'attack-pattern'")
        .select(
            "bundle_id",
            "threat_name",
            F.coalesce(
                _first(
                    o.getField("external_references"), lambda r: r.getField("source_name") == ATTACK_SOURCE, "external_id"
                ),
                o.getField("id"),
                F.lit("unknown"),
            ).alias("technique_id"),
            o.getField("name").alias("technique_name"),
            _first(
                o.getField("kill_chain_phases"), lambda p: p.getField("kill_chain_name") == ATTACK_SOURCE, "phase_name"
            ).alias("tactic"),
        )
    )


def stix_iocs(bundles: DataFrame) -> DataFrame:
    """IN4: indicators as hashes; unknown pattern types keep their own name."""
    kind = F.regexp_extract("o.pattern", STIX_PATTERN, 1)
    raw = F.regexp_extract("o.pattern", STIX_PATTERN, 2)
    return (
        bundles.select("bundle_id", "threat_name", F.explode("objects").alias("o"))
        .where("o.type = 'indicator'")
        .select(
            "bundle_id",
            "threat_name",
            F.coalesce(mapped(kind, STIX_TYPES), kind).alias("ioc_type"),
            F.when(raw != "", indicator_hash(raw)).alias("value_hash"),
        )
        .where("value_hash IS NOT NULL")
    )


def misp_iocs(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN5: attributes of the known types as hashes, the event title as note."""
    return (
        documents.select(F.from_json(column, MISP_SCHEMA).alias("d"))
        .select(
            F.col("d.Event.uuid").alias("event_id"),
            F.col("d.Event.info").alias("notes"),
            F.explode("d.Event.Attribute").alias("a"),
        )
        .select(
            "event_id",
            "notes",
            mapped(F.col("a.type"), MISP_TYPES).alias("ioc_type"),
            indicator_hash("a.value").alias("value_hash"),
        )
        .where("ioc_type IS NOT NULL")
    )


def parse_layers(documents: DataFrame, column: str = "value") -> DataFrame:
    """IN26: rows (layer, technique, score, covered); a score above 50 is covered."""
    return (
        documents.select(F.from_json(column, LAYER_SCHEMA).alias("l"))
        .select(F.col("l.name").alias("layer"), F.explode("l.techniques").alias("t"))
        .where("t.techniqueID <> ''")
        .select(
            "layer",
            F.col("t.techniqueID").alias("technique_id"),
            F.coalesce("t.score", F.lit(0.0)).alias("score"),
            (F.coalesce("t.score", F.lit(0.0)) > 50).alias("covered"),
        )
    )


def inferred_stack(layers: DataFrame, technique_map: DataFrame, registry: DataFrame) -> DataFrame:
    """IN26: the tools a layer implies: the first listed vendor of each tool kind per covered technique."""
    techniques = layers.where("covered").select("layer", "technique_id").distinct()
    listed = technique_lookup(techniques, technique_map, ["primary_vendors"]).select(
        "layer", "technique_id", F.posexplode("primary_vendors").alias("pos", "vendor_id")
    )
    order = Window.partitionBy("layer", "technique_id", "kind").orderBy("pos")
    return (
        listed.join(registry.select("vendor_id", "kind"), "vendor_id")
        .withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") == 1)
        .select("layer", F.col("vendor_id").alias("tool"))
        .distinct()
    )
