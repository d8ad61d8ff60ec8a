"""Graph and vector operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge
from hexvigil.functions.vectors import as_double, cosine, norm
from hexvigil.operators import graph, secure, vectors
from hexvigil.plans.registry import R, query, rounded
from hexvigil.session import stored



def _none():
    return F.array().cast("array<string>")


def entries(spark, sf):
    obs = bridge.technique_obs(spark, sf, "org", "technique_id", "tactic", "tool", "outcome")
    tool = F.replace(F.lower("tool"), F.lit(" "), F.lit("_"))
    return obs.select(
        F.concat(F.lit("Org "), F.col("org").cast("string")).alias("threat_name"),
        "technique_id",
        F.lit(None).cast("string").alias("technique_name"),
        "tactic",
        F.when(F.col("outcome") == "detected", F.array(tool)).otherwise(_none()).alias("detected_by"),
        F.when(F.col("outcome") == "missed", F.array(tool)).otherwise(_none()).alias("missed_by"),
    )


def iocs(spark, sf):
    return bridge.bundle_ioc(spark, sf).select(
        "value_hash",
        "ioc_type",
        F.when(F.col("ioc_type") != "url", F.col("campaign")).alias("campaign"),
        F.when(F.col("ioc_type").isin("url", "ip"), F.concat(F.lit("Group "), "ioc_type")).alias("threat_actor"),
        _none().alias("detected_by"),
        _none().alias("missed_by"),
    )


def parts(spark, sf):
    n1, e1 = graph.attack_map_graph(entries(spark, sf))
    n2, e2 = graph.ioc_graph(iocs(spark, sf))
    n3 = graph.eval_nodes(bridge.evals(spark, sf, "vendor", "category"))
    return (n1, n2, n3), e1.unionByName(e2)


GRAPH_SQL = """e AS (SELECT concat('org_', CAST(o_custkey AS VARCHAR)) AS actor, concat('Org ', CAST(o_custkey AS VARCHAR)) AS actor_name, technique_id, tactic, lower(tool) AS tool, outcome FROM technique_obs JOIN orders ON o_orderkey = contribution_id),
 i AS (SELECT value_hash, ioc_type, CASE WHEN ioc_type <> 'url' THEN campaign END AS campaign, CASE WHEN ioc_type IN ('url', 'ip') THEN concat('Group ', ioc_type) END AS ta FROM bundle_ioc),
 ed AS (SELECT concat('actor:', actor) AS source_id, concat('technique:', technique_id) AS target_id, 'uses' AS edge_type FROM e
  UNION ALL SELECT concat('technique:', technique_id), concat('tool:', tool), CASE outcome WHEN 'detected' THEN 'detected_by' ELSE 'missed_by' END FROM e WHERE outcome IS NOT NULL
  UNION ALL SELECT concat('ioc:', value_hash), concat('campaign:', lower(campaign)), 'indicates' FROM i WHERE campaign IS NOT NULL
  UNION ALL SELECT concat('campaign:', lower(campaign)), concat('actor:', replace(lower(ta), ' ', '_')), 'attributed_to' FROM i WHERE campaign IS NOT NULL AND ta IS NOT NULL
  UNION ALL SELECT concat('ioc:', value_hash), concat('actor:', replace(lower(ta), ' ', '_')), 'related_to' FROM i WHERE campaign IS NULL AND ta IS NOT NULL)"""


@query(
    "g01_graph_edges",
    f"WITH {GRAPH_SQL} SELECT source_id, target_id, edge_type, count(*) AS n FROM ed GROUP BY ALL",
    ("technique_obs", "bundle_ioc"),
)
def graph_edges(spark, sf):
    _, edges = parts(spark, sf)
    return edges.groupBy("source_id", "target_id", "edge_type").agg(F.sum("weight").cast("long").alias("n"))


NODE_SQL = """tn AS (SELECT concat('technique:', technique_id) AS node_id, 'technique' AS node_type, technique_id AS label, min(tactic) AS property FROM e GROUP BY technique_id),
 ob AS (SELECT DISTINCT tool FROM e WHERE outcome IS NOT NULL),
 nd AS (SELECT * FROM tn UNION ALL SELECT DISTINCT concat('actor:', actor), 'threat_actor', actor_name, NULL FROM e
 UNION ALL SELECT concat('tool:', tool), 'tool', tool, NULL FROM ob
 UNION ALL SELECT concat('tool:', lower(vendor)), 'tool', vendor, min(category) FROM evals WHERE lower(vendor) NOT IN (SELECT tool FROM ob) GROUP BY vendor
 UNION ALL SELECT concat('ioc:', value_hash), 'ioc', min(ioc_type), NULL FROM i GROUP BY value_hash
 UNION ALL SELECT DISTINCT concat('campaign:', lower(campaign)), 'campaign', campaign, NULL FROM i WHERE campaign IS NOT NULL
 UNION ALL SELECT DISTINCT concat('actor:', replace(lower(ta), ' ', '_')), 'threat_actor', ta, NULL FROM i WHERE ta IS NOT NULL)"""


@query("g02_merged_nodes", f"WITH {GRAPH_SQL}, {NODE_SQL} SELECT * FROM nd", ("technique_obs", "bundle_ioc", "evals"))
def merged_nodes(spark, sf):
    nodes, _ = parts(spark, sf)
    return graph.merge_nodes(*nodes)


@query(
    "g03_degrees",
    f"""WITH {GRAPH_SQL} SELECT node_id, count(*) AS degree, count(DISTINCT other) AS neighbours FROM (SELECT source_id AS node_id, target_id AS other FROM ed UNION ALL SELECT target_id, source_id FROM ed) GROUP BY node_id""",
    ("technique_obs", "bundle_ioc"),
)
def degrees(spark, sf):
    return graph.degrees(parts(spark, sf)[1])


@query(
    "g03_neighbours",
    f"""WITH {GRAPH_SQL} SELECT target_id AS neighbour FROM ed WHERE source_id = 'technique:T1048' UNION SELECT source_id FROM ed WHERE target_id = 'technique:T1048'""",
    ("technique_obs", "bundle_ioc"),
)
def neighbours(spark, sf):
    return graph.neighbours(parts(spark, sf)[1], "technique:T1048")


@query(
    "g04_adjacency",
    f"WITH {GRAPH_SQL} SELECT source_id, target_id, CAST(count(*) AS DOUBLE) AS weight FROM ed GROUP BY 1, 2",
    ("technique_obs", "bundle_ioc"),
)
def adjacency(spark, sf):
    return graph.adjacency(parts(spark, sf)[1])


@query("g05_random_walks")
def random_walks(spark, sf):
    """Twenty walks of ten nodes from every node of the whole graph."""
    return graph.random_walks(parts(spark, sf)[1])


@query(
    "g05_walk_steps",
    f"""WITH {GRAPH_SQL} SELECT start, 20 AS walks, 200 AS nodes, 180 AS along_edges FROM (SELECT source_id AS start FROM ed UNION SELECT target_id FROM ed)""",
    ("technique_obs", "bundle_ioc"),
)
def walk_steps(spark, sf):
    """What the walks must be: twenty of ten nodes from every node, each step along an edge of the graph."""
    edges = parts(spark, sf)[1]
    return graph.walk_steps(graph.random_walks(edges), graph.undirected(edges))


@query("g05_walk_embeddings")
def walk_embeddings(spark, sf):
    return graph.walk_embeddings(graph.random_walks(parts(spark, sf)[1]))


def embedded(spark, sf):
    return bridge.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("g06_campaign_clusters")
def campaign_clusters(spark, sf):
    return graph.campaign_clusters(embedded(spark, sf), 5)


CLUSTER_SQL = f"""WITH {GRAPH_SQL}, {NODE_SQL}, c AS (SELECT node_type AS t, label, CAST(CAST(concat('0x', substr(sha256(node_id), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS cluster_id FROM nd)"""


def hashed_clusters(spark, sf):
    """All nodes of the graph, and clusters by hash of the node, so that both engines group alike.

    The nodes are merged once and stored: sizes, members and names would each join all tables again.
    """
    nodes = stored(graph.merge_nodes(*parts(spark, sf)[0]), "merged-nodes")
    number = F.conv(F.substring(F.sha2("node_id", 256), 1, 8), 16, 10).cast("long")
    return nodes.select(F.col("node_id").alias("id"), (number % 5).cast("int").alias("cluster_id")), nodes


@query(
    "g07_campaign_summary",
    CLUSTER_SQL + """ SELECT cluster_id, count(*) AS node_count, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t = 'technique'), '') AS techniques, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t = 'tool'), '') AS tools,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t = 'ioc'), '') AS ioc_types, count(DISTINCT label) FILTER (t = 'threat_actor') AS actors, count(DISTINCT label) FILTER (t = 'campaign') AS campaigns FROM c GROUP BY 1""",
    ("technique_obs", "bundle_ioc", "evals"),
)
def campaign_summary(spark, sf):
    out = graph.campaign_summary(*hashed_clusters(spark, sf))
    return out.withColumns({c: F.array_join(c, ",") for c in ("techniques", "ioc_types", "tools")})


@query(
    "g07_campaign_members",
    CLUSTER_SQL + " SELECT DISTINCT cluster_id, t AS node_type, label AS name FROM c",
    ("technique_obs", "bundle_ioc", "evals"),
)
def campaign_members(spark, sf):
    return graph.campaign_members(*hashed_clusters(spark, sf))


@query(
    "g08_cosine_to_first",
    f"""WITH f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS first FROM embeddings GROUP BY label)
 SELECT vec_id, {R('list_cosine_similarity(embedding::DOUBLE[], first)')} AS similarity, {R('sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS norm FROM embeddings e JOIN f ON f.label = e.label""",
)
def cosine_to_first(spark, sf):
    e = bridge.table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    v = as_double("embedding")
    out = e.join(first, "label").select(
        "vec_id", cosine(v, as_double("first")).alias("similarity"), norm(v).alias("norm")
    )
    return rounded(out, "similarity", "norm")


def updates(spark, sf):
    return bridge.table(spark, sf, "embeddings").select(
        F.col("label").alias("group"),
        F.col("vec_id").alias("client"),
        F.col("embedding").alias("vector"),
        (1 + F.col("vec_id") % 7).alias("weight"),
    )


FLAT_SQL = """x AS (SELECT label AS grp, vec_id AS client, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, 1 + vec_id % 7 AS w FROM embeddings)"""


@query(
    "v01_weighted_mean",
    f"""WITH {FLAT_SQL} SELECT grp AS "group", CAST(i AS INTEGER) AS idx, {R('sum(v * w) / sum(w)')} AS value FROM x GROUP BY 1, 2""",
)
def weighted_mean(spark, sf):
    return rounded(vectors.weighted_mean(vectors.matching_shapes(updates(spark, sf))), "value")


@query(
    "v02_trimmed_mean",
    f"""WITH {FLAT_SQL}, r AS (SELECT grp, i, v, row_number() OVER (PARTITION BY grp, i ORDER BY v) AS rn, count(*) OVER (PARTITION BY grp, i) AS n FROM x),
 t AS (SELECT *, CASE WHEN 2 * greatest(1, floor(n * 0.1)) >= n THEN greatest(0, floor((n - 1) / 2)) ELSE greatest(1, floor(n * 0.1)) END AS k FROM r)
 SELECT grp AS "group", CAST(i AS INTEGER) AS idx, {R('avg(v)')} AS value FROM t WHERE rn > k AND rn <= n - k GROUP BY 1, 2""",
)
def trimmed_mean(spark, sf):
    return rounded(vectors.trimmed_mean(updates(spark, sf).drop("weight"), 0.1), "value")


@query(
    "v03_krum",
    f"""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 d AS (SELECT a.label, a.vec_id, a.n, pow(list_distance(a.v, b.v), 2) AS d2, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY list_distance(a.v, b.v)) AS rn FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
 s AS (SELECT label, vec_id, sum(d2) AS score FROM d WHERE rn <= n - 3 GROUP BY 1, 2)
 SELECT label AS "group", vec_id AS client, {R('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(score, 9), vec_id) = 1""",
)
def krum(spark, sf):
    return rounded(vectors.krum(updates(spark, sf)).select("group", "client", "score"), "score")


MEDIAN_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT label AS g, embedding::DOUBLE[] AS x FROM embeddings),
 m AS (SELECT g, 0 AS it, list(a ORDER BY i) AS c, 1e308::DOUBLE AS shift FROM (SELECT g, i, avg(x[i]) AS a FROM v, range(1, len(x) + 1) r(i) GROUP BY g, i) GROUP BY g
  UNION ALL SELECT g, it + 1, n, list_distance(n, c) FROM (SELECT g, it, any_value(c) AS c, list(s ORDER BY i) AS n FROM
   (SELECT g, it, any_value(c) AS c, i, sum(x[i] * w) / sum(w) AS s FROM (SELECT m.g, it, c, x, 1 / greatest(list_distance(x, c), 1e-10) AS w FROM m JOIN v ON v.g = m.g WHERE shift >= 1e-6 AND it < 100) q,
    range(1, len(x) + 1) r(i) GROUP BY g, it, i) GROUP BY g, it) z),
 last AS (SELECT g, arg_max(c, it) AS c FROM m GROUP BY g)"""


@query(
    "v04_geometric_median",
    f"""{MEDIAN_SQL} SELECT g AS "group", CAST(i - 1 AS INTEGER) AS idx, {R('c[i]')} AS value FROM last, range(1, len(c) + 1) r(i)""",
)
def geometric_median(spark, sf):
    median = vectors.geometric_median(updates(spark, sf))
    return rounded(median.select("group", F.posexplode("vector").alias("idx", "value")), "value")


@query(
    "v04_median_pull",
    f"""{MEDIAN_SQL}, u AS (SELECT v.g, i, avg((x[i] - c[i]) / greatest(list_distance(x, c), 1e-12)) AS s FROM v JOIN last ON last.g = v.g, range(1, len(x) + 1) r(i) GROUP BY 1, 2)
 SELECT g AS "group", round(sqrt(sum(s * s)), 4) + 0.0 AS pull, sqrt(sum(s * s)) < 1e-3 AS balanced FROM u GROUP BY g""",
)
def median_pull(spark, sf):
    """How far the unit vectors from the median to all vectors are from cancelling out: the length of their mean."""
    median = vectors.geometric_median(updates(spark, sf)).select("group", F.col("vector").alias("__m"))
    apart = updates(spark, sf).join(median, "group").withColumn(
        "vector", F.zip_with(as_double("vector"), "__m", lambda x, m: x - m)
    )
    unit = apart.withColumn("__n", F.greatest(norm(F.col("vector")), F.lit(1e-12))).select(
        "group", "client", F.transform("vector", lambda x: x / F.col("__n")).alias("vector")
    )
    pull = vectors.weighted_mean(unit.withColumn("weight", F.lit(1.0)))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")))
    return pull.groupBy("group").agg((F.round(length, 4) + 0.0).alias("pull"), (length < 1e-3).alias("balanced"))


@query(
    "v05_norm_outliers",
    f"""WITH e AS (SELECT label, vec_id, sqrt(list_inner_product(v, v)) AS nm FROM (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS v FROM embeddings)),
 s AS (SELECT label, avg(nm) AS m, stddev_pop(nm) AS sd FROM e GROUP BY label)
 SELECT e.label AS "group", vec_id AS client, {R('abs(nm - m) / (sd + 1e-10)')} AS score, abs(nm - m) / (sd + 1e-10) > 1.2 AS flagged FROM e JOIN s ON s.label = e.label""",
)
def norm_outliers(spark, sf):
    scaled = updates(spark, sf).withColumn("__w", F.col("weight").cast("double"))
    scaled = scaled.withColumn("vector", F.transform(as_double("vector"), lambda x: x * F.col("__w")))
    return rounded(vectors.outliers(scaled, "zscore", 1.2), "score")


@query(
    "v05_direction_outliers",
    f"""WITH {FLAT_SQL}, m AS (SELECT grp, list(mv ORDER BY i) AS c FROM (SELECT grp, i, avg(v) AS mv FROM x GROUP BY 1, 2) GROUP BY 1)
 SELECT label AS "group", vec_id AS client, {R('1 - list_cosine_similarity(embedding::DOUBLE[], c)')} AS score, 1 - list_cosine_similarity(embedding::DOUBLE[], c) > 0.9 AS flagged FROM embeddings JOIN m ON grp = label""",
)
def direction_outliers(spark, sf):
    return rounded(vectors.outliers(updates(spark, sf), "cosine", 0.9), "score")


NOISE_SECRET = "vector-demo-secret"
NOISE_U = f"((CAST(concat('0x', substr(sha256(concat_ws(':', '{NOISE_SECRET}', CAST(client AS VARCHAR), CAST(i AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(
    "v06_noised_vectors",
    f"""WITH {FLAT_SQL}, b AS (SELECT *, max(abs(v)) OVER (PARTITION BY grp, client) + 1e-10 AS s, {NOISE_U} AS u FROM x)
 SELECT grp AS "group", client, CAST(i AS INTEGER) AS idx, {R('v - s * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))')} AS value FROM b""",
)
def noised_vectors(spark, sf):
    noised = vectors.noised_vectors(updates(spark, sf), 1.0, NOISE_SECRET)
    return rounded(noised.select("group", "client", F.posexplode("vector").alias("idx", "value")), "value")


@query(
    "v07_aggregate_round",
    f"""WITH {FLAT_SQL}, a AS (SELECT grp, i, sum(v * w) / sum(w) AS mv FROM x GROUP BY 1, 2), c AS (SELECT label AS grp, unnest(first)::DOUBLE AS cv, generate_subscripts(first, 1) - 1 AS i FROM (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)),
 n AS (SELECT label, vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nm FROM embeddings), s AS (SELECT label, avg(nm) AS m, stddev_pop(nm) AS sd FROM n GROUP BY label),
 f AS (SELECT n.label, count(*) AS n_contributors, avg((vec_id % 10) / 10.0) AS loss FROM n GROUP BY 1)
 SELECT a.grp AS "group", CAST(a.i AS INTEGER) AS idx, {R('cv + mv')} AS value, n_contributors, {R('loss')} AS loss FROM a JOIN c ON c.grp = a.grp AND c.i = a.i JOIN f ON f.label = a.grp""",
)
def aggregate_round(spark, sf):
    up = updates(spark, sf)
    current = up.groupBy("group").agg(F.min_by("vector", "client").alias("vector"))
    losses = up.select("group", "client", ((F.col("client") % 10) / 10.0).alias("loss"))
    out = vectors.aggregate_round(up, current, losses, "fedavg")
    flat = out.select("group", F.posexplode("global").alias("idx", "value"), "n_contributors", "loss")
    return rounded(flat, "value", "loss")


@query(
    "v08_prediction_metrics",
    f"""WITH r AS (SELECT category, CASE WHEN chose_this_vendor THEN 1.0 ELSE 0 END AS y, detection_rate / 100 * 0.98 + 0.01 AS p FROM evals)
 SELECT category, {R('avg(CASE WHEN (p > 0.5) = (y > 0.5) THEN 1.0 ELSE 0 END)')} AS accuracy, {R('-avg(y * ln(p + 1e-8) + (1 - y) * ln(1 - p + 1e-8))')} AS log_loss, {R('avg((p - y) * (p - y))')} AS mse, {R('avg(abs(p - y))')} AS mae,
 {R('max(abs(p - y))')} AS max_error, count(*) AS n FROM r GROUP BY 1""",
    ("evals",),
)
def prediction_metrics(spark, sf):
    rows = bridge.evals(spark, sf, "category", "chose_this_vendor", "detection_rate").select(
        "category",
        F.when(F.col("chose_this_vendor"), 1.0).otherwise(0.0).alias("y"),
        (F.col("detection_rate") / 100 * 0.98 + 0.01).alias("p"),
    )
    out = vectors.prediction_metrics(rows, ("category",))
    return rounded(out, "accuracy", "log_loss", "mse", "mae", "max_error")


SIMILAR_SQL = """s AS (SELECT a.vec_id AS our_node, b.vec_id AS their_node, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b
 ON a.label % 2 = 0 AND b.label % 2 = 1 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)"""


def similar(spark, sf):
    e = bridge.table(spark, sf, "embeddings")
    cols = [F.col("vec_id").alias("id"), F.col("embedding").alias("vector")]
    return vectors.similar_nodes(
        e.where("label % 2 = 0").select(*cols), e.where("label % 2 = 1").select(*cols), threshold=0.3
    )


@query(
    "j12_similar_nodes",
    f"WITH {SIMILAR_SQL} SELECT our_node, their_node, {R('similarity')} AS similarity FROM s",
)
def similar_nodes(spark, sf):
    return rounded(similar(spark, sf), "similarity")


@query(
    "j13_shared_campaigns",
    f"""WITH {SIMILAR_SQL}, t AS (SELECT s.*, CASE our_node % 3 WHEN 0 THEN 'technique' WHEN 1 THEN 'ioc' ELSE 'tool' END AS k, concat('n', CAST(our_node % 50 AS VARCHAR)) AS label FROM s),
 b AS (SELECT string_agg(label, ',' ORDER BY similarity DESC, label) AS techniques FROM (SELECT label, {R('similarity')} AS similarity FROM t WHERE k = 'technique' ORDER BY {R('similarity')} DESC, our_node, their_node LIMIT 10))
 SELECT count(*) FILTER (k = 'technique') AS shared_technique_count, count(*) FILTER (k = 'ioc') AS shared_ioc_count, count(DISTINCT label) FILTER (k = 'tool') AS shared_tools, {R('avg(similarity)')} AS confidence, count(*) AS total_matches, any_value(techniques) AS techniques FROM t, b""",
)
def shared_campaigns(spark, sf):
    nodes = bridge.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.expr("CASE vec_id % 3 WHEN 0 THEN 'technique' WHEN 1 THEN 'ioc' ELSE 'tool' END").alias("node_type"),
        F.concat(F.lit("n"), (F.col("vec_id") % 50).cast("string")).alias("label"),
    )
    out = vectors.shared_campaigns(rounded(similar(spark, sf), "similarity"), nodes)
    return rounded(out.withColumn("techniques", F.array_join("techniques", ",")), "confidence")


@query(
    "a34_secure_sum",
    f"""SELECT industry AS session, 'overall_score' AS field, {R('sum(overall_score)')} AS total, 3 AS parties FROM evals WHERE industry <> 'BUILDING' GROUP BY 1
 UNION ALL SELECT industry, 'detection_rate', {R('sum(detection_rate)')}, 3 FROM evals WHERE industry <> 'BUILDING' GROUP BY 1""",
    ("evals",),
)
def secure_sum(spark, sf):
    """Shares for three collectors; the third never reports for one industry, so its sums stay closed."""
    l, o, c = (bridge.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    values = rows.select(
        F.col("c_mktsegment").alias("session"),
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        (F.col("l_quantity") / 5).alias("overall_score"),
        (F.col("l_discount") * 1000).alias("detection_rate"),
    ).unpivot(
        ["session", "l_orderkey", "l_partkey", "l_linenumber"], ["overall_score", "detection_rate"], "field", "value"
    )
    shares = secure.make_shares(values, 3, "share-demo", ["l_orderkey", "l_partkey", "l_linenumber"], spread=1e3)
    arrived = shares.where(~((F.col("session") == "BUILDING") & (F.col("party") == 2)))
    out = secure.secure_sum(arrived, 3).select("session", "field", "total", F.col("parties").cast("int").alias("parties"))
    return rounded(out, "total")


def proposals_and_votes(spark, sf):
    salt = F.concat_ws("-", (F.col("user_id") % 7).cast("string"), (F.col("event_id") % 40).cast("string"))
    ev = bridge.table(spark, sf, "events").select(
        secure.category_hash(F.col("event_type"), salt).alias("category_hash"),
        F.lit("malware").alias("category_type"),
        F.when(F.col("event_id") % 5 == 0, "wrong").otherwise(F.upper("event_type")).alias("plaintext"),
        salt.alias("salt"),
        F.col("user_id").cast("string").alias("proposer"),
        "ts",
        "value",
    )
    proposals = ev.where("value <= 20").select("category_hash", "category_type", "proposer", "ts")
    votes = ev.where("value > 20").select("category_hash", "plaintext", "salt", "proposer", "ts")
    return proposals, votes


BLIND_SQL = """WITH ev AS (SELECT sha256(concat(lower(event_type), ':', CAST(user_id % 7 AS VARCHAR), '-', CAST(event_id % 40 AS VARCHAR))) AS h, CAST(user_id AS VARCHAR) AS p, ts, value, event_id % 5 <> 0 AS genuine, event_type FROM events),
 f AS (SELECT h, p, min(ts) AS joined FROM ev WHERE value <= 20 GROUP BY 1, 2),
 m AS (SELECT h, joined AS met_at FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY joined, p) AS rn FROM f) WHERE rn = 3),
 g AS (SELECT ev.h, ev.p, min(ev.ts) AS voted, any_value(event_type) AS name FROM ev JOIN m ON m.h = ev.h JOIN f ON f.h = ev.h AND f.p = ev.p WHERE value > 20 AND genuine AND ev.ts >= met_at AND ev.ts >= joined GROUP BY 1, 2),
 r AS (SELECT h, count(*) AS votes, max(voted) AS revealed_at, any_value(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY voted, p) AS rn FROM g) WHERE rn <= 2 GROUP BY h),
 s AS (SELECT f.h, count(*) AS supporters FROM f LEFT JOIN r ON r.h = f.h AND votes >= 2 WHERE revealed_at IS NULL OR joined <= revealed_at GROUP BY 1)
 SELECT s.h AS category_hash, 'malware' AS category_type, supporters, CASE WHEN votes >= 2 THEN 'revealed' WHEN met_at IS NOT NULL THEN 'threshold_met' ELSE 'pending' END AS status, coalesce(votes, 0) AS reveal_votes,
 CASE WHEN votes >= 2 THEN name END AS revealed_name FROM s LEFT JOIN m ON m.h = s.h LEFT JOIN r ON r.h = s.h"""


@query("a36_blind_categories", BLIND_SQL)
def blind_categories(spark, sf):
    return secure.blind_categories(*proposals_and_votes(spark, sf))


@query(
    "a36_pending_categories",
    f"SELECT * FROM ({BLIND_SQL}) WHERE status <> 'revealed' AND supporters >= 2",
)
def pending_categories(spark, sf):
    return secure.pending_categories(secure.blind_categories(*proposals_and_votes(spark, sf)), 2)
