"""Exports: STIX objects, MISP attributes, flat CSV, Navigator layers, partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexvigil.functions.hashing import uuid5
from hexvigil.sources.intel import mapped

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
PRODUCER = "hexvigil"
STIX_OBJECT = {
    "ip": "ipv4-addr:value",
    "ipv4": "ipv4-addr:value",
    "ipv6": "ipv6-addr:value",
    "domain": "domain-name:value",
    "url": "url:value",
    "hash_md5": "file:hashes.MD5",
    "hash_sha1": "file:hashes.'SHA-1'",
    "hash_sha256": "file:hashes.'SHA-256'",
    "email": "email-addr:value",
}
STIX_OTHER = "artifact:payload_bin"
MISP_TYPE = {
    "ip": "ip-dst",
    "ipv4": "ip-dst",
    "ipv6": "ip-dst",
    "domain": "domain",
    "url": "url",
    "hash_md5": "md5",
    "hash_sha1": "sha1",
    "hash_sha256": "sha256",
    "email": "email-src",
}
MISP_CATEGORY = {
    "ip": "Network activity",
    "ipv4": "Network activity",
    "ipv6": "Network activity",
    "domain": "Network activity",
    "url": "Network activity",
    "hash_md5": "Payload delivery",
    "hash_sha1": "Payload delivery",
    "hash_sha256": "Payload delivery",
    "email": "Payload delivery",
}
COVERED = (100, "#31a354")
GAP = (25, "#de2d26")


def _stix_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), uuid5(DNS_NAMESPACE, name))


def identity_object(spark: SparkSession, as_of: str) -> DataFrame:
    """OUT1: the producer that every exported object refers to."""
    return spark.range(1).select(
        F.to_json(
            F.struct(
                F.lit("identity").alias("type"),
                F.lit("2.1").alias("spec_version"),
                _stix_id("identity", F.lit(PRODUCER)).alias("id"),
                F.lit(as_of).alias("created"),
                F.lit(as_of).alias("modified"),
                F.lit(PRODUCER).alias("name"),
                F.lit("tool").alias("identity_class"),
            )
        ).alias("value")
    )


def stix_objects(
    as_of: str,
    iocs: DataFrame | None = None,
    evals: DataFrame | None = None,
    techniques: DataFrame | None = None,
    name_chars: int | None = None,
) -> DataFrame:
    """OUT1: one STIX object as JSON per row; ids depend on the content only, so exports can be repeated.

    ``name_chars`` cuts the indicator in an object's name.

    ``iocs(ioc_type, value)``, ``evals(vendor, overall_score)``, ``techniques(technique_id, technique_name)``.
    """
    identity = _stix_id("identity", F.lit(PRODUCER))
    stamp = F.lit(as_of)
    parts: list[DataFrame] = []

    def common(kind: str, ident: Column) -> list[Column]:
        return [
            F.lit(kind).alias("type"),
            F.lit("2.1").alias("spec_version"),
            ident.alias("id"),
            stamp.alias("created"),
            stamp.alias("modified"),
            identity.alias("created_by_ref"),
        ]

    if iocs is not None:
        kind, value = F.col("ioc_type"), F.col("value")
        pattern = F.concat(
            F.lit("["),
            F.coalesce(mapped(F.replace(F.lower(kind), F.lit("-"), F.lit("_")), STIX_OBJECT), F.lit(STIX_OTHER)),
            F.lit(" = '"),
            value,
            F.lit("']"),
        )
        parts.append(
            iocs.select(
                F.to_json(
                    F.struct(
                        *common("indicator", _stix_id("indicator", F.concat_ws(":", kind, value))),
                        F.concat(kind, F.lit(": "), value if name_chars is None else F.substring(value, 1, name_chars)).alias("name"),
                        pattern.alias("pattern"),
                        F.lit("stix").alias("pattern_type"),
                        stamp.alias("valid_from"),
                        F.array(F.lit("malicious-activity")).alias("labels"),
                    )
                ).alias("value")
            )
        )
    if evals is not None:
        score = F.col("overall_score").cast("string")
        parts.append(
            evals.select(
                F.to_json(
                    F.struct(
                        *common("note", _stix_id("note", F.concat_ws(":", F.lit("eval"), "vendor", score))),
                        F.concat(F.lit("Vendor evaluation: "), "vendor", F.lit(" scored "), score).alias("content"),
                        F.array(identity).alias("object_refs"),
                    )
                ).alias("value")
            )
        )
    if techniques is not None:
        tid = F.col("technique_id")
        url = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace(tid, F.lit("."), F.lit("/")), F.lit("/"))
        parts.append(
            techniques.select(
                F.to_json(
                    F.struct(
                        *common("attack-pattern", _stix_id("attack-pattern", tid)),
                        F.concat_ws(" ", tid, F.coalesce("technique_name", tid)).alias("name"),
                        F.array(
                            F.struct(
                                F.lit("mitre-attack").alias("source_name"),
                                tid.alias("external_id"),
                                url.alias("url"),
                            )
                        ).alias("external_references"),
                    )
                ).alias("value")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def misp_attributes(as_of: str, iocs: DataFrame | None = None, techniques: DataFrame | None = None) -> DataFrame:
    """OUT2: one MISP attribute per row."""
    parts: list[DataFrame] = []
    if iocs is not None:
        key = F.replace(F.lower("ioc_type"), F.lit("-"), F.lit("_"))
        parts.append(
            iocs.select(
                F.coalesce(mapped(key, MISP_TYPE), F.lit("text")).alias("type"),
                F.coalesce(mapped(key, MISP_CATEGORY), F.lit("Other")).alias("category"),
                F.col("value"),
                F.lit(True).alias("to_ids"),
                F.lit(as_of).alias("timestamp"),
            )
        )
    if techniques is not None:
        parts.append(
            techniques.select(
                F.lit("text").alias("type"),
                F.lit("External analysis").alias("category"),
                F.concat(F.lit("MITRE ATT&CK: "), "technique_id").alias("value"),
                F.lit(False).alias("to_ids"),
                F.lit(as_of).alias("timestamp"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn(
        "uuid", uuid5(DNS_NAMESPACE, F.concat_ws(":", F.lit("attribute"), "type", "value"))
    )


def flat_rows(
    iocs: DataFrame | None = None, evals: DataFrame | None = None, techniques: DataFrame | None = None
) -> DataFrame:
    """OUT3: all record kinds under (type, value, category, source, timestamp, extra)."""
    blank = F.lit("")

    def rows(df: DataFrame, kind, value, category, source, extra) -> DataFrame:
        return df.select(
            kind.alias("type"),
            value.alias("value"),
            category.alias("category"),
            source.alias("source"),
            blank.alias("timestamp"),
            extra.alias("extra"),
        )

    parts: list[DataFrame] = []
    if iocs is not None:
        source = F.col("source") if "source" in iocs.columns else blank
        context = F.col("context") if "context" in iocs.columns else blank
        parts.append(rows(iocs, F.col("ioc_type"), F.col("value"), F.lit("ioc"), source, context))
    if evals is not None:
        source = F.col("source") if "source" in evals.columns else blank
        extra = F.concat(F.lit("score="), F.coalesce(F.col("overall_score").cast("string"), blank))
        parts.append(rows(evals, F.lit("eval"), F.col("vendor"), F.col("category"), source, extra))
    if techniques is not None:
        parts.append(
            rows(
                techniques,
                F.lit("technique"),
                F.col("technique_id"),
                F.lit("attack-map"),
                blank,
                F.coalesce("technique_name", blank),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def navigator_layers(gap_rows: DataFrame, domain: str = "enterprise-attack", most: int | None = None) -> DataFrame:
    """OUT4: one layer as JSON per stack, covered techniques green and gaps red.

    ``gap_rows`` come from the market-gap operator; a layer holds the priority
    techniques of one vertical, so its list is short.  ``most`` cuts the categories that a
    comment suggests.
    """
    suggested = F.col("suggested_categories") if most is None else F.slice("suggested_categories", 1, most)
    covered = F.col("covered")
    note = F.when(covered, F.concat(F.lit("Covered by: "), F.array_join("covering_tools", ", "))).otherwise(
        F.concat(F.lit("Suggested: "), F.array_join(suggested, ", "))
    )
    entry = F.struct(
        "rank",
        F.struct(
            F.col("technique_id").alias("techniqueID"),
            F.when(covered, COVERED[0]).otherwise(GAP[0]).alias("score"),
            F.when(covered, COVERED[1]).otherwise(GAP[1]).alias("color"),
            note.alias("comment"),
            F.lit(True).alias("enabled"),
        ).alias("t"),
    )
    per = gap_rows.groupBy("stack_id", "vertical").agg(F.sort_array(F.collect_list(entry)).alias("__t"))
    return per.select(
        "stack_id",
        F.to_json(
            F.struct(
                F.concat_ws(" ", F.col("stack_id").cast("string"), "vertical", F.lit("coverage")).alias("name"),
                F.struct(F.lit("4.5").alias("layer"), F.lit("14").alias("attack")).alias("versions"),
                F.lit(domain).alias("domain"),
                F.transform("__t", lambda x: x.getField("t")).alias("techniques"),
                F.struct(
                    F.array(F.lit(GAP[1]), F.lit("#fee08b"), F.lit(COVERED[1])).alias("colors"),
                    F.lit(0).alias("minValue"),
                    F.lit(100).alias("maxValue"),
                ).alias("gradient"),
            )
        ).alias("value"),
    )


def save_tables(path: str, evals: DataFrame, attack_maps: DataFrame, bundles: DataFrame) -> None:
    """OUT5: contributions by type, and the techniques and indicators as child tables.

    Nested lists are exploded once, when they are stored; a reader of one kind touches
    only its partition, and hashes are sorted inside files so their ranges prune.
    """
    all_kinds = (
        evals.withColumn("contrib_type", F.lit("eval"))
        .unionByName(attack_maps.drop("techniques").withColumn("contrib_type", F.lit("attack_map")), True)
        .unionByName(bundles.drop("iocs").withColumn("contrib_type", F.lit("ioc_bundle")), True)
    )
    all_kinds.write.mode("overwrite").partitionBy("contrib_type").parquet(f"{path}/contribution")
    techniques = attack_maps.select("contribution_id", F.explode("techniques").alias("t")).select("contribution_id", "t.*")
    techniques.write.mode("overwrite").parquet(f"{path}/technique")
    iocs = bundles.select("contribution_id", F.explode("iocs").alias("i")).select("contribution_id", "i.*")
    iocs.sortWithinPartitions("value_hash").write.mode("overwrite").parquet(f"{path}/ioc")


def load_table(spark: SparkSession, path: str, name: str, contrib_type: str | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")
    return df if contrib_type is None else df.where(F.col("contrib_type") == contrib_type)
