"""Security-data views over the supplied test tables.

Each view exists twice: as a DataFrame that joins only what the requested
columns need, and as SQL text for the oracle.  Foreign keys in the tables are
complete, so leaving out an unneeded join leaves the rows unchanged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexvigil import dims

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TOOL_KINDS = ["edr", "siem", "ndr", "iam", "email", "pam", "ztna", "waf"]
CERTS = ["SOC2-Type2", "ISO27001", "PCI-DSS", "HIPAA-BAA", "FedRAMP-Moderate", "FIPS-140-2", "StateRAMP"]
FRAMEWORKS = ["NIST CSF", "PCI DSS", "HIPAA", "CMMC", "FedRAMP", "NERC CIP"]
CARRIERS = ["Coalition", "Corvus", "At-Bay", "Beazley", "Chubb"]
ISSUES = ["", "Data breach disclosed in 2023", "Import ban in one market", "Complex licensing tiers"]
WORDS_A = ["the", "and", "that", "with", "from", "this", "are", "for"]
WORDS_B = ["thereon", "heating", "nation", "ration", "station", "edition", "notion", "motion", "lotion", "potion"]
VERTICALS = ["healthcare", "financial", "energy", "government"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _arr(items):
    return F.array(*[F.lit(i) for i in items])


SQL = {
    "evals": """SELECT s.s_name AS vendor, p.p_type AS category, l.l_quantity/5 AS overall_score, l.l_discount*1000 AS detection_rate,
 l.l_tax*100 AS fp_rate, l.l_linenumber AS deploy_days, l.l_extendedprice AS annual_cost,
 CASE l.l_returnflag WHEN 'N' THEN true WHEN 'A' THEN false END AS would_buy, l.l_linestatus='F' AS chose_this_vendor,
 o.o_orderpriority AS source, c.c_mktsegment AS industry, o.o_custkey AS submitter, l.l_shipdate AS received_at
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
 JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN part p ON l.l_partkey=p.p_partkey""",
    "technique_obs": """SELECT l.l_orderkey AS contribution_id, concat('T', CAST(1000 + l.l_partkey % 200 AS VARCHAR)) AS technique_id,
 p.p_type AS tactic, l.l_linestatus='F' AS observed, s.s_name AS tool,
 CASE l.l_returnflag WHEN 'A' THEN 'detected' WHEN 'R' THEN 'missed' END AS outcome, l.l_shipdate AS ts
 FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey JOIN supplier s ON l.l_suppkey=s.s_suppkey""",
    "incidents": """SELECT o_orderkey AS contribution_id, c_mktsegment AS industry, o_orderpriority AS severity,
 CASE o_orderstatus WHEN 'F' THEN 'hours' WHEN 'O' THEN 'days' ELSE 'minutes' END AS time_to_detect,
 o_totalprice > 400000 AS ransom_paid, o_orderdate AS received_at, o_custkey AS org
 FROM orders JOIN customer ON o_custkey=c_custkey""",
    "remediation": """SELECT l_orderkey AS contribution_id, CASE l_linenumber % 5 WHEN 0 THEN 'containment' WHEN 1 THEN 'detection'
 WHEN 2 THEN 'eradication' WHEN 3 THEN 'recovery' ELSE 'prevention' END AS category,
 CASE l_returnflag WHEN 'A' THEN 'stopped_attack' WHEN 'N' THEN 'slowed_attack' ELSE 'no_effect' END AS effectiveness,
 concat('action-', CAST(l_partkey % 97 AS VARCHAR)) AS action, l_shipdate AS ts FROM lineitem""",
    "ioc": """SELECT DISTINCT o.o_custkey AS org, l.l_partkey AS ioc_key, p.p_type AS ioc_type, p.p_brand AS campaign,
 p.p_size < 10 AS in_public_feed FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey""",
    "bundle_ioc": """SELECT l.l_orderkey AS contribution_id, sha256(CAST(l.l_partkey AS VARCHAR)) AS value_hash,
 CASE p.p_type WHEN 'ECONOMY' THEN 'domain' WHEN 'LARGE' THEN 'ip' WHEN 'MEDIUM' THEN 'hash-sha256'
 WHEN 'PROMO' THEN 'hash-md5' WHEN 'SMALL' THEN 'url' ELSE 'email' END AS ioc_type, p.p_brand AS campaign
 FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey""",
    "request_log": """SELECT event_id, user_id, ts, concat('/', CASE event_type WHEN 'view' THEN 'query/vendor'
 WHEN 'click' THEN 'intelligence/market' ELSE event_type END) AS endpoint, value FROM events""",
    "api_user": """SELECT user_id, min(ts) AS created_at, max(ts) AS last_used, count(*) AS request_count FROM events GROUP BY user_id""",
    "members": """SELECT user_id, min(ts) AS created_at, max(ts) AS last_used, count(*) AS request_count,
 CASE user_id % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier,
 CASE WHEN user_id % 10 = 0 THEN 9 ELSE 0 END AS invite_count, CASE WHEN user_id % 10 <> 0 THEN user_id - user_id % 10 END AS invited_by,
 user_id % 4 <> 0 AS verified FROM events GROUP BY user_id""",
    "registry": f"""SELECT s_name AS vendor_id, replace(s_name, '#', ' ') AS display_name,
 {_list(CATEGORIES)}[CAST(s_suppkey % 6 AS INTEGER) + 1] AS category,
 {_list(TOOL_KINDS)}[CAST(s_suppkey % 8 AS INTEGER) + 1] AS kind,
 {_list(CERTS)}[1:CAST(s_suppkey % 8 AS INTEGER)] AS certifications,
 {_list(FRAMEWORKS)}[1:CAST(s_suppkey % 7 AS INTEGER)] AS compliance_frameworks,
 {_list(CARRIERS)}[1:CAST(s_suppkey % 6 AS INTEGER)] AS insurance_carriers,
 {_list(ISSUES)}[CAST(s_suppkey % 4 AS INTEGER) + 1] AS known_issues,
 CAST(1 + s_suppkey % 30 AS INTEGER) AS typical_deploy_days FROM supplier""",
    "technique_map": f"""SELECT concat('T', CAST(1000 + i AS VARCHAR)) AS technique_id,
 concat({_list(WORDS_A)}[CAST(i % 8 AS INTEGER) + 1], ' ', {_list(WORDS_B)}[CAST((i // 8) % 10 AS INTEGER) + 1]) AS name,
 {_list(dims.TACTICS)}[CAST(i % 12 AS INTEGER) + 1] AS tactic, CAST(i % 12 AS INTEGER) AS tactic_order,
 [{_list(TOOL_KINDS)}[CAST(i % 8 AS INTEGER) + 1], {_list(TOOL_KINDS)}[CAST((i + 1 + (i // 8) % 7) % 8 AS INTEGER) + 1]] AS categories,
 [concat('Supplier#', lpad(CAST(i * 7 % 100 AS VARCHAR), 9, '0')), concat('Supplier#', lpad(CAST((i * 7 + 13) % 100 AS VARCHAR), 9, '0')),
  concat('Supplier#', lpad(CAST((i * 7 + 37) % 100 AS VARCHAR), 9, '0'))] AS primary_vendors,
 concat({_list(WORDS_B)}[CAST(i % 10 AS INTEGER) + 1], ' erthe ', {_list(WORDS_B)}[CAST((i // 10) % 10 AS INTEGER) + 1]) AS description
 FROM (SELECT unnest(range(200)) AS i)""",
    "org_vertical": f"""SELECT c_custkey AS org, {_list(VERTICALS)}[CAST(c_custkey % 4 AS INTEGER) + 1] AS vertical FROM customer""",
    "stack": """SELECT DISTINCT submitter AS stack_id, vendor AS tool FROM evals WHERE chose_this_vendor AND overall_score >= 9.0""",
}

DEPENDS = {"stack": ("evals",)}


def with_views(views: tuple[str, ...], sql: str) -> str:
    """Prepend the named views (and what they need) as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in DEPENDS.get(name, ()):
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ctes + ",\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ctes + ",\n" + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ctes + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table by name; its schema is looked up once per path, not for every plan that reads it."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_SCHEMAS: dict = {}


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan spread over the cluster when its files give too few input splits.

    One small file with one row group is one task however many cores there are; a larger one is still one, beside splits
    that hold no rows.  With enough splits that share the rows nothing is moved.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits * 2 <= slots:
        return df.repartition(slots, key)
    if _lopsided(df, slots):
        return df.repartition(max(4 * slots, splits), key)
    return df


def _lopsided(df: DataFrame, slots: int) -> bool:
    """Whether one split holds more than twice a slot's share of the rows, by the files' row counts."""
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return (held["most"] or 0) * slots > 2 * (held["rows"] or 0)


def texts(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table whose rows take long to work on: texts, documents, anything hashed or parsed per row."""
    return spread(table(spark, sf, name), key)


def evals(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    need = set(cols)
    df = table(spark, sf, "lineitem")
    if need & {"source", "submitter", "industry"}:
        df = df.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "industry" in need:
        df = df.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if "vendor" in need:
        df = df.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "category" in need:
        df = df.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    exprs = {
        "vendor": "s_name",
        "category": "p_type",
        "overall_score": "l_quantity / 5",
        "detection_rate": "l_discount * 1000",
        "fp_rate": "l_tax * 100",
        "deploy_days": "l_linenumber",
        "annual_cost": "l_extendedprice",
        "would_buy": "CASE l_returnflag WHEN 'N' THEN true WHEN 'A' THEN false END",
        "chose_this_vendor": "l_linestatus = 'F'",
        "source": "o_orderpriority",
        "industry": "c_mktsegment",
        "submitter": "o_custkey",
        "received_at": "l_shipdate",
        "contribution_id": "l_orderkey",
    }
    return df.select(*[F.expr(exprs[c]).alias(c) for c in cols])


def technique_obs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    need = set(cols)
    df = table(spark, sf, "lineitem")
    if "tactic" in need:
        df = df.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "tool" in need:
        df = df.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if need & {"org", "industry"}:
        df = df.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "industry" in need:
        df = df.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    exprs = {
        "contribution_id": "l_orderkey",
        "technique_id": "concat('T', cast(1000 + l_partkey % 200 AS string))",
        "tactic": "p_type",
        "observed": "l_linestatus = 'F'",
        "tool": "s_name",
        "outcome": "CASE l_returnflag WHEN 'A' THEN 'detected' WHEN 'R' THEN 'missed' END",
        "ts": "l_shipdate",
        "org": "o_custkey",
        "industry": "c_mktsegment",
    }
    return df.select(*[F.expr(exprs[c]).alias(c) for c in cols])


def incidents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    df = table(spark, sf, "orders")
    if "industry" in cols:
        df = df.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    exprs = {
        "contribution_id": "o_orderkey",
        "industry": "c_mktsegment",
        "severity": "o_orderpriority",
        "time_to_detect": "CASE o_orderstatus WHEN 'F' THEN 'hours' WHEN 'O' THEN 'days' ELSE 'minutes' END",
        "ransom_paid": "o_totalprice > 400000",
        "received_at": "o_orderdate",
        "org": "o_custkey",
    }
    return df.select(*[F.expr(exprs[c]).alias(c) for c in cols])


def remediation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("contribution_id"),
        F.expr(
            "CASE l_linenumber % 5 WHEN 0 THEN 'containment' WHEN 1 THEN 'detection' WHEN 2 THEN 'eradication' "
            "WHEN 3 THEN 'recovery' ELSE 'prevention' END"
        ).alias("category"),
        F.expr(
            "CASE l_returnflag WHEN 'A' THEN 'stopped_attack' WHEN 'N' THEN 'slowed_attack' ELSE 'no_effect' END"
        ).alias("effectiveness"),
        F.expr("concat('action-', cast(l_partkey % 97 AS string))").alias("action"),
        F.col("l_shipdate").alias("ts"),
    )


def ioc(spark: SparkSession, sf: str) -> DataFrame:
    l, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    pairs = (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .select(F.col("o_custkey").alias("org"), F.col("l_partkey").alias("ioc_key"))
        .distinct()
    )
    return pairs.join(p, pairs.ioc_key == p.p_partkey).select(
        "org",
        "ioc_key",
        F.col("p_type").alias("ioc_type"),
        F.col("p_brand").alias("campaign"),
        (F.col("p_size") < 10).alias("in_public_feed"),
    )


def bundle_ioc(spark: SparkSession, sf: str) -> DataFrame:
    l, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("contribution_id"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("value_hash"),
        F.expr(
            "CASE p_type WHEN 'ECONOMY' THEN 'domain' WHEN 'LARGE' THEN 'ip' WHEN 'MEDIUM' THEN 'hash-sha256' "
            "WHEN 'PROMO' THEN 'hash-md5' WHEN 'SMALL' THEN 'url' ELSE 'email' END"
        ).alias("ioc_type"),
        F.col("p_brand").alias("campaign"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.expr(
            "concat('/', CASE event_type WHEN 'view' THEN 'query/vendor' WHEN 'click' THEN 'intelligence/market' "
            "ELSE event_type END)"
        ).alias("endpoint"),
        "value",
    )


def api_user(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_used"), F.count("*").alias("request_count"))
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    uid = F.col("user_id")
    return api_user(spark, sf).select(
        "*",
        F.expr("CASE user_id % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'pro' ELSE 'enterprise' END").alias("tier"),
        F.when(uid % 10 == 0, 9).otherwise(0).alias("invite_count"),
        F.when(uid % 10 != 0, uid - uid % 10).alias("invited_by"),
        (uid % 4 != 0).alias("verified"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("vendor_id"),
        F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")).alias("display_name"),
        F.element_at(_arr(CATEGORIES), key % 6 + 1).alias("category"),
        F.element_at(_arr(TOOL_KINDS), key % 8 + 1).alias("kind"),
        F.slice(_arr(CERTS), F.lit(1), key % 8).alias("certifications"),
        F.slice(_arr(FRAMEWORKS), F.lit(1), key % 7).alias("compliance_frameworks"),
        F.slice(_arr(CARRIERS), F.lit(1), key % 6).alias("insurance_carriers"),
        F.element_at(_arr(ISSUES), key % 4 + 1).alias("known_issues"),
        (1 + key % 30).alias("typical_deploy_days"),
    )


def technique_map(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("int")

    def idiv(n: int):
        return F.floor(F.col("id") / n).cast("int")

    def vendor(shift: int):
        return F.concat(F.lit("Supplier#"), F.lpad(((i * 7 + shift) % 100).cast("string"), 9, "0"))

    kinds, b = _arr(TOOL_KINDS), _arr(WORDS_B)
    return spark.range(200).select(
        F.concat(F.lit("T"), (1000 + i).cast("string")).alias("technique_id"),
        F.concat_ws(" ", F.element_at(_arr(WORDS_A), i % 8 + 1), F.element_at(b, idiv(8) % 10 + 1)).alias("name"),
        F.element_at(_arr(dims.TACTICS), i % 12 + 1).alias("tactic"),
        (i % 12).alias("tactic_order"),
        F.array(F.element_at(kinds, i % 8 + 1), F.element_at(kinds, (i + 1 + idiv(8) % 7) % 8 + 1)).alias("categories"),
        F.array(vendor(0), vendor(13), vendor(37)).alias("primary_vendors"),
        F.concat(F.element_at(b, i % 10 + 1), F.lit(" erthe "), F.element_at(b, idiv(10) % 10 + 1)).alias("description"),
    )


def org_vertical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("org"),
        F.element_at(_arr(VERTICALS), (F.col("c_custkey") % 4).cast("int") + 1).alias("vertical"),
    )


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """Tools an organisation bought and rated 9 or better."""
    return (
        evals(spark, sf, "submitter", "vendor", "chose_this_vendor", "overall_score")
        .where("chose_this_vendor AND overall_score >= 9.0")
        .select(F.col("submitter").alias("stack_id"), F.col("vendor").alias("tool"))
        .distinct()
    )
