"""Digests, proofs and lineage of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge
from hexvigil.functions import scrub, tables
from hexvigil.functions.hashing import indicator_hash, row_hash
from hexvigil.operators import commitments as log, digest
from hexvigil.plans.registry import R, query, rounded
from hexvigil.session import cut_lineage
from hexvigil.plans.text import NOTES, CLEAN_SQL, hmac_row_sql, hmac_sql, with_sentence

KEY = b"receipt-demo-key"
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def row_sql(status="o_orderstatus"):
    return f"sha256(CAST(json_object('o_custkey', o_custkey, 'o_orderkey', o_orderkey, 'o_orderpriority', o_orderpriority, 'o_orderstatus', {status}) AS VARCHAR))"


@query("h01_row_hash", f"SELECT o_orderkey, {row_sql()} AS row_hash FROM orders")
def hashed(spark, sf):
    return digest.hashed_rows(bridge.table(spark, sf, "orders").select(*COLUMNS)).select("o_orderkey", "row_hash")


CHANGED = "CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END"


@query(
    "h01_compare_tables",
    f"""SELECT coalesce(l.h, r.h) AS row_hash, coalesce(l.n, 0) AS left_copies, coalesce(r.n, 0) AS right_copies FROM (SELECT {row_sql()} AS h, count(*) AS n FROM orders GROUP BY 1) l
 FULL OUTER JOIN (SELECT {row_sql(CHANGED)} AS h, count(*) AS n FROM orders GROUP BY 1) r ON l.h = r.h WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""",
)
def compare_tables(spark, sf):
    left = bridge.table(spark, sf, "orders").select(*COLUMNS)
    return digest.compare_tables(left, left.withColumn("o_orderstatus", F.expr(CHANGED)), COLUMNS)


def leaves(spark, sf):
    """Orders in order of day, then hash: a day, and within it the first hash digits, are the numbering buckets."""
    rows = digest.hashed_rows(
        bridge.table(spark, sf, "orders").select("o_orderdate", *COLUMNS), COLUMNS, "leaf_hash"
    ).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "leaf_hash")
    bucket = F.concat_ws("/", F.date_format("day", "yyyy-MM-dd"), F.substring("leaf_hash", 1, 3))
    return digest.leaf_order(rows, "leaf_hash", bucket, ["day", "leaf_hash"])


LEVELS = 24
LEAF_SQL = f"lf AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), h) - 1 AS i, h FROM (SELECT *, {row_sql()} AS h FROM orders)), nn AS (SELECT count(*) AS n FROM lf), sz AS (SELECT CAST(pow(2, ceil(log2(n))) AS BIGINT) AS s FROM nn), t0 AS (SELECT i, h FROM lf UNION ALL SELECT n + unnest(range(s - n)), sha256('pad') FROM nn, sz)"
for _k in range(1, LEVELS + 1):
    LEAF_SQL += f", t{_k} AS MATERIALIZED (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM t{_k - 1} GROUP BY i // 2)"


@query(
    "h02_merkle_root",
    f"WITH {LEAF_SQL} SELECT h AS root, n AS leaf_count, CAST(ceil(log2(n)) AS INTEGER) AS depth FROM t{LEVELS}, nn",
)
def merkle_root(spark, sf):
    return digest.merkle_root(leaves(spark, sf).select("leaf_index", "leaf_hash"))


PATH_JOINS = " ".join(f"LEFT JOIN t{k} s{k} ON s{k}.i = xor(lf.i >> {k}, 1)" for k in range(LEVELS))
PATH_COLS = ", ".join(f"s{k}.h" for k in range(LEVELS))


@query(
    "h03_inclusion_proofs",
    f"""WITH {LEAF_SQL} SELECT o_orderkey, lf.i AS leaf_index, CAST(ceil(log2(n)) AS BIGINT) AS path_length, sha256(concat_ws('', {PATH_COLS})) AS path_digest, true AS valid FROM lf, nn {PATH_JOINS}""".replace(
        "FROM lf, nn", "FROM lf CROSS JOIN nn"
    ),
)
def inclusion_proofs(spark, sf):
    lf = leaves(spark, sf)
    proofs = digest.verify_proofs(digest.inclusion_proofs(lf.select("leaf_index", "leaf_hash", "o_orderkey")))
    return proofs.select(
        "o_orderkey",
        "leaf_index",
        F.size("path").cast("long").alias("path_length"),
        F.sha2(F.array_join("path", ""), 256).alias("path_digest"),
        "valid",
    )


@query(
    "h04_receipts",
    f"""WITH {LEAF_SQL}, r AS (SELECT h AS root FROM t{LEVELS}), q AS (SELECT i, h, substr(sha256(concat(h, ':', CAST(i AS VARCHAR))), 1, 16) AS receipt_id, root FROM lf, r)
 SELECT i AS leaf_index, h AS leaf_hash, receipt_id, root AS merkle_root, {hmac_sql(KEY, "concat(receipt_id, ':', h, ':', root)")} AS signature FROM q""",
)
def receipts(spark, sf):
    lf = leaves(spark, sf).select(F.col("leaf_index").cast("long").alias("leaf_index"), "leaf_hash")
    return digest.receipts(lf, digest.merkle_root(lf), KEY)


GROUP_SQL = "gm AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY h) - 1 AS i, h FROM lf), gs AS (SELECT o_custkey, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS s FROM gm GROUP BY 1), g0 AS (SELECT o_custkey, i, h FROM gm UNION ALL SELECT o_custkey, unnest(range(n, s)), sha256('pad') FROM gs)"
for _k in range(1, 13):
    GROUP_SQL += f", g{_k} AS MATERIALIZED (SELECT o_custkey, i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM g{_k - 1} GROUP BY o_custkey, i // 2)"


@query(
    "h05_aggregate_proofs",
    f"""WITH {LEAF_SQL}, {GROUP_SQL}, a AS (SELECT o_custkey, count(*) AS contributor_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1),
 m AS (SELECT gs.o_custkey, gs.n AS member_count, g12.h AS member_root FROM gs JOIN g12 ON g12.o_custkey = gs.o_custkey), r AS (SELECT h AS merkle_root FROM t{LEVELS})
 SELECT a.o_custkey, contributor_count, key_sum, member_count, member_root, merkle_root,
 {hmac_sql(KEY, "CAST(json_object('o_custkey', a.o_custkey, 'contributor_count', contributor_count, 'merkle_root', merkle_root, 'key_sum', key_sum) AS VARCHAR)")} AS signature,
 member_count = contributor_count AS commitment_count_matches, true AS merkle_root_present, true AS signature_present, member_count = contributor_count AS valid FROM a JOIN m ON m.o_custkey = a.o_custkey, r""",
)
def aggregate_proofs(spark, sf):
    lf = leaves(spark, sf)
    aggs = (
        bridge.table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("contributor_count"), F.sum("o_orderkey").alias("key_sum"))
    )
    root = digest.merkle_root(lf.select("leaf_index", "leaf_hash"))
    return digest.aggregate_proofs(aggs, lf.select("o_custkey", "leaf_hash"), root, ["o_custkey"], ["key_sum"], KEY)


def _stage_sql(name, before, after, evidence):
    return f"CAST(json_object('stage_id', '{name}', 'input_hash', {before}, 'output_hash', {after}, 'evidence', {evidence}) AS VARCHAR)"


def chained(spark, sf):
    """Documents through extraction, scrubbing and submission, chained."""
    docs = with_sentence(spark, sf, NOTES).select(
        "doc_id",
        F.sha2("text", 256).alias("file_hash"),
        F.sha2(scrub.scrub(F.col("text")), 256).alias("clean_hash"),
        F.length("text").alias("size"),
    )

    def stage(name, before, after, evidence):
        return F.struct(
            F.lit(name).alias("stage_id"),
            F.col(before).alias("input_hash"),
            F.col(after).alias("output_hash"),
            evidence.alias("evidence"),
        )

    records = docs.withColumn(
        "stages",
        F.array(
            stage("extract", "file_hash", "file_hash", F.col("size").cast("string")),
            stage("anonymize", "file_hash", "clean_hash", F.lit("scrub")),
            stage("submit", "clean_hash", "clean_hash", F.lit("batch")),
        ),
    )
    return digest.chain_lineage(records, KEY)


@query(
    "h06_lineage",
    f"""WITH d AS MATERIALIZED (SELECT doc_id, sha256(text) AS f, sha256(clean) AS c, CAST(length(text) AS VARCHAR) AS n FROM ({CLEAN_SQL})),
 l0 AS MATERIALIZED (SELECT *, {hmac_sql(KEY, 'f')} AS k0 FROM d), l1 AS MATERIALIZED (SELECT *, {hmac_row_sql('k0', _stage_sql('extract', 'f', 'f', 'n'))} AS k1 FROM l0),
 l2 AS MATERIALIZED (SELECT *, {hmac_row_sql('k1', _stage_sql('anonymize', 'f', 'c', "'scrub'"))} AS k2 FROM l1)
 SELECT doc_id, k0 AS root_link, {hmac_row_sql('k2', _stage_sql('submit', 'c', 'c', "'batch'"))} AS last_link, true AS chain_intact, true AS continuous, true AS valid FROM l2""",
)
def lineage(spark, sf):
    out = digest.verify_lineage(chained(spark, sf))
    return out.select(
        "doc_id", F.element_at("links", 1).alias("root_link"), F.element_at("links", -1).alias("last_link"),
        "chain_intact", "continuous", "valid",
    )


@query(
    "h07_stage_evidence",
    f"""SELECT doc_id, concat_ws(',', 'n_chars', 'notes', CASE WHEN doc_id % 2 = 0 THEN 'top_strength' END) AS fields_present,
 CASE WHEN clean <> text THEN 'notes' ELSE '' END AS fields_modified, true AS numeric_unchanged FROM ({CLEAN_SQL})""",
)
def stage_evidence(spark, sf):
    before = with_sentence(spark, sf, NOTES).select(
        "doc_id",
        F.col("text").alias("notes"),
        F.when(F.col("doc_id") % 2 == 0, "fast").alias("top_strength"),
        F.length("text").alias("n_chars"),
    )
    after = before.withColumn("notes", scrub.scrub(F.col("notes")))
    out = digest.stage_evidence(before, after, ["doc_id"], ["notes", "top_strength"], ["n_chars"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("fields_present", "fields_modified")})


@query(
    "h07_hashing_evidence",
    """SELECT ioc_type, count(*) AS ioc_count, true AS all_hashed, ioc_type <> 'url' AS all_raw_stripped FROM bundle_ioc GROUP BY ioc_type""",
    ("bundle_ioc",),
)
def hashing_evidence(spark, sf):
    rows = bridge.bundle_ioc(spark, sf).withColumn("value_raw", F.when(F.col("ioc_type") == "url", F.lit("left")))
    return digest.hashing_evidence(rows, ("ioc_type",))


def _salt(field):
    return F.sha2(F.concat_ws(":", F.lit("salt"), F.col("o_orderkey").cast("string"), F.lit(field)), 256)


def _commit_sql(field, value):
    salt = f"sha256(concat('salt:', CAST(o_orderkey AS VARCHAR), ':{field}'))"
    return f"sha256(encode(concat('{field}:', CAST({value} AS VARCHAR))) || unhex({salt}))"


@query(
    "h08_commitments",
    f"""SELECT o_orderkey, commit_deploy_days, commit_score, sha256(concat('deploy_days:', commit_deploy_days, '|score:', commit_score)) AS batch_hash, true AS valid FROM
 (SELECT o_orderkey, {_commit_sql('score', 'o_custkey % 11')} AS commit_score, {_commit_sql('deploy_days', 'o_orderkey % 365')} AS commit_deploy_days FROM orders)""",
)
def commitments(spark, sf):
    rows = bridge.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 11).alias("score"),
        (F.col("o_orderkey") % 365).alias("deploy_days"),
        _salt("score").alias("salt_score"),
        _salt("deploy_days").alias("salt_deploy_days"),
    )
    fields = ["score", "deploy_days"]
    out = digest.verify_commitments(digest.commit_fields(rows, fields), fields)
    return out.select("o_orderkey", "commit_deploy_days", "commit_score", "batch_hash", "valid")


@query(
    "h09_attest_table",
    f"""WITH {LEAF_SQL}, r AS (SELECT h AS merkle_root FROM t{LEVELS}), s AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS orgs, CAST(greatest(5, least(95, round_even(avg((o_custkey % 90) / 100.0 + 0.05) * 100, 0))) AS INTEGER) AS credibility_score FROM orders)
 SELECT n, orgs, credibility_score, merkle_root, n AS leaf_count, true AS counts_agree, {hmac_sql(KEY, "concat_ws('|', merkle_root, CAST(n AS VARCHAR), CAST(n AS VARCHAR), CAST(orgs AS VARCHAR), CAST(credibility_score AS VARCHAR))")} AS signature FROM s, r""",
)
def attest_table(spark, sf):
    lf = leaves(spark, sf)
    stats = lf.agg(
        F.count("*").alias("n"),
        F.count_distinct("o_custkey").alias("orgs"),
        F.avg((F.col("o_custkey") % 90) / 100.0 + 0.05).alias("credibility"),
    )
    return digest.attest_table(stats, digest.merkle_root(lf.select("leaf_index", "leaf_hash")), KEY)


PARTS = 3  # appends of the orders, in the order of their leaves


def appended(spark, sf):
    """The orders' leaves, committed in three appends: the nodes and the frontier after each."""
    lf = cut_lineage(leaves(spark, sf).select(F.col("leaf_index").cast("long").alias("leaf_index"), "leaf_hash"))
    total, frontier, nodes, seen = lf.count(), log.Frontier(), None, []
    for part in range(PARTS):
        low, high = total * part // PARTS, total * (part + 1) // PARTS
        batch = lf.where((F.col("leaf_index") >= low) & (F.col("leaf_index") < high))
        fresh, frontier = log.append_leaves(frontier, batch.select((F.col("leaf_index") - low).alias("place"), "leaf_hash"))
        nodes = fresh if nodes is None else nodes.unionByName(fresh)
        seen.append(frontier)
    return nodes, seen


PREFIX_SQL = LEAF_SQL.split(", nn AS")[0] + f""", cuts AS (SELECT p, (SELECT count(*) FROM orders) * p // {PARTS} AS n FROM range(1, {PARTS + 1}) r(p)),
 sz AS (SELECT p, n, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS s FROM cuts), t0 AS (SELECT p, i, h FROM lf JOIN cuts ON i < n UNION ALL SELECT p, unnest(range(n, s)), sha256('pad') FROM sz)"""
for _k in range(1, LEVELS + 1):
    PREFIX_SQL += f", t{_k} AS MATERIALIZED (SELECT p, i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM t{_k - 1} GROUP BY p, i // 2)"


@query(
    "h02_appended_roots",
    f"""WITH {PREFIX_SQL} SELECT n AS leaf_count, h AS root, lag(h) OVER (ORDER BY n) AS earlier_root, CASE WHEN p > 1 THEN true END AS consistent FROM t{LEVELS} JOIN cuts USING (p)""",
)
def appended_roots(spark, sf):
    """The root after each append, and whether the proof that it continues the one before holds."""
    nodes, seen = appended(spark, sf)
    rows = []
    for old, new in zip([None, *seen], seen):
        holds = None
        if old is not None:
            holds = log.is_consistent(log.consistency(old, new, nodes), old.count, old.root(), new.root())
        rows.append((new.count, new.root(), old.root() if old else None, holds))
    return spark.createDataFrame(rows, "leaf_count long, root string, earlier_root string, consistent boolean")


@query(
    "h03_appended_proofs",
    f"""WITH {LEAF_SQL} SELECT lf.i AS leaf_index, h AS leaf_hash, CAST(ceil(log2(n)) AS BIGINT) AS path_length, sha256(concat_ws('', {PATH_COLS})) AS path_digest, true AS valid FROM (SELECT i, h FROM lf) lf CROSS JOIN nn {PATH_JOINS}""".replace(
        "h AS leaf_hash", "lf.h AS leaf_hash"
    ),
)
def appended_proofs(spark, sf):
    """Proofs from the stored nodes of three appends are those of the tree built at once."""
    nodes, seen = appended(spark, sf)
    proofs = digest.verify_proofs(log.inclusion(seen[-1], nodes))
    return proofs.select(
        "leaf_index", "leaf_hash", F.size("path").cast("long").alias("path_length"),
        F.sha2(F.array_join("path", ""), 256).alias("path_digest"), "valid",
    )


@query(
    "h06_lineage_in_sql",
    f"""WITH d AS MATERIALIZED (SELECT doc_id, sha256(text) AS f, sha256(clean) AS c, CAST(length(text) AS VARCHAR) AS n FROM ({CLEAN_SQL})),
 l0 AS MATERIALIZED (SELECT *, {hmac_sql(KEY, 'f')} AS k0 FROM d), l1 AS MATERIALIZED (SELECT *, {hmac_row_sql('k0', _stage_sql('extract', 'f', 'f', 'n'))} AS k1 FROM l0),
 l2 AS MATERIALIZED (SELECT *, {hmac_row_sql('k1', _stage_sql('anonymize', 'f', 'c', "'scrub'"))} AS k2 FROM l1)
 SELECT CAST(doc_id AS VARCHAR) AS record, 3 AS steps, {hmac_row_sql('k2', _stage_sql('submit', 'c', 'c', "'batch'"))} AS last_link, true AS chain_intact, true AS continuous, true AS valid FROM l2""",
)
def lineage_in_sql(spark, sf):
    """The chains verified link by link by a table function."""
    tables.register(spark)
    links = tables.link_rows(chained(spark, sf), "doc_id")
    return spark.sql("SELECT * FROM verify_links(TABLE(SELECT * FROM {links}) PARTITION BY record ORDER BY step)", links=links)
