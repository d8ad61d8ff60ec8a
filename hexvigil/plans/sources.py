"""Connectors on files and documents that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexvigil import bridge
from hexvigil.operators.techniques import observations
from hexvigil.plans import techniques as tplans
from hexvigil.plans.registry import R, query, r6, rounded
from hexvigil.session import scratch_path
from hexvigil.sources import contributions as con
from hexvigil.sources import events as evt
from hexvigil.sources import exports, feeds, intel

AS_OF = "2024-01-31T00:00:00.000Z"


def eval_json(spark, sf):
    """Evaluations as JSON: even orders flat with alias names, odd ones enveloped; one in eleven is no contribution."""
    e = bridge.evals(spark, sf, "contribution_id", "vendor", "category", "overall_score", "detection_rate", "fp_rate")
    cid = F.col("contribution_id").cast("string").alias("contribution_id")
    flat = F.to_json(
        F.struct(
            cid,
            "vendor",
            F.col("category").alias("type"),
            F.col("overall_score").alias("score"),
            "detection_rate",
            F.col("fp_rate").alias("false_positive_rate"),
            F.lit("ok").alias("pros"),
        )
    )
    wired = F.to_json(
        F.struct(cid, F.struct("vendor", "category", "overall_score", "detection_rate", "fp_rate").alias("data"))
    )
    broken = F.concat(F.lit('{"contribution_id": '), F.col("contribution_id").cast("string"))
    value = (
        F.when(F.col("contribution_id") % 11 == 0, broken)
        .when(F.col("contribution_id") % 2 == 0, flat)
        .otherwise(wired)
    )
    return e.select(value.alias("value"))


def map_json(spark, sf):
    obs = bridge.technique_obs(spark, sf, "contribution_id", "technique_id", "tactic", "observed", "tool", "outcome")
    empty = F.array().cast("array<string>")
    entry = F.struct(
        F.col("technique_id").alias("id"),
        "tactic",
        "observed",
        F.when(F.col("outcome") == "detected", F.array("tool")).otherwise(empty).alias("detected_by"),
        F.when(F.col("outcome") == "missed", F.array("tool")).otherwise(empty).alias("missed_by"),
    )
    maps = obs.groupBy("contribution_id").agg(F.collect_list(entry).alias("techniques"))
    return maps.select(
        F.to_json(
            F.struct(
                F.col("contribution_id").cast("string").alias("contribution_id"),
                F.lit("Campaign").alias("threat"),
                "techniques",
            )
        ).alias("value")
    )


def bundle_json(spark, sf):
    l = bridge.table(spark, sf, "lineitem")
    entry = F.struct(F.lit("domain").alias("ioc_type"), F.concat(F.lit(" Host"), F.col("l_partkey").cast("string")).alias("value_raw"))
    bundles = l.groupBy("l_orderkey").agg(F.collect_list(entry).alias("iocs"))
    return bundles.select(
        F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("contribution_id"), "iocs")).alias("value")
    )


def text_folder(documents, name):
    """A folder of text files, compressed: JSON repeats its keys in every line."""
    path = scratch_path(documents.sparkSession, name)
    documents.write.text(path, compression="gzip")
    return path


def mixed_files(spark, sf):
    """All kinds in one folder of JSON lines, read back through the file reader."""
    every = eval_json(spark, sf).unionAll(map_json(spark, sf)).unionAll(bundle_json(spark, sf))
    path = text_folder(every, "contributions")
    return con.parse_contributions(con.read_documents(spark, path))


@query(
    "in01_contribution_kinds",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 11 = 0 THEN 'rejected' ELSE 'eval' END AS kind FROM lineitem
 UNION ALL SELECT 'attack_map' FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT 'ioc_bundle' FROM (SELECT DISTINCT l_orderkey FROM lineitem)) GROUP BY kind""",
)
def contribution_kinds(spark, sf):
    return mixed_files(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


def array_json(spark, sf):
    """One JSON array of quoted evaluations per order."""
    e = bridge.evals(spark, sf, "contribution_id", "vendor", "overall_score", "deploy_days", "would_buy")
    flag = F.when(F.col("would_buy"), F.lit("yes")).when(~F.col("would_buy"), F.lit("no"))
    entry = F.struct(
        F.col("contribution_id").cast("string").alias("contribution_id"),
        "vendor",
        F.when(F.col("deploy_days") == 7, F.lit("n/a")).otherwise(F.col("overall_score").cast("string")).alias("overall_score"),
        F.concat(F.lit(" "), F.col("deploy_days").cast("string")).alias("deploy_days"),
        flag.alias("would_buy"),
    )
    return e.groupBy("contribution_id").agg(F.to_json(F.collect_list(entry)).alias("value")).select("value")


ORDERS_SQL = "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem"


@query(
    "in01_mixed_shapes",
    f"""SELECT 'eval' AS kind, '' AS reason, CAST(count(*) + count(*) FILTER (l_orderkey % 11 <> 0) AS BIGINT) AS n FROM lineitem
 UNION ALL SELECT 'rejected', 'no JSON', count(*) FROM lineitem WHERE l_orderkey % 11 = 0
 UNION ALL SELECT 'rejected', 'unknown kind', n FROM ({ORDERS_SQL}) UNION ALL SELECT 'attack_map', '', n FROM ({ORDERS_SQL}) UNION ALL SELECT 'ioc_bundle', '', n FROM ({ORDERS_SQL})
 UNION ALL SELECT 'stix', '', n FROM ({ORDERS_SQL}) UNION ALL SELECT 'misp', '', n FROM ({ORDERS_SQL})""",
)
def mixed_shapes(spark, sf):
    """Every shape in one folder: lines and arrays of evaluations, maps, bundles, exchange formats, and what is none of them."""
    stray = array_json(spark, sf).select(F.lit('{"note": "nothing"}').alias("value"))
    every = eval_json(spark, sf).unionAll(array_json(spark, sf)).unionAll(map_json(spark, sf)).unionAll(bundle_json(spark, sf))
    every = every.unionAll(stix_documents(spark, sf)).unionAll(misp_documents(spark, sf)).unionAll(stray)
    path = text_folder(every, "mixed")
    parsed = con.parse_contributions(con.read_documents(spark, path))
    return parsed.groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(
    "in02_lenient_values",
    f"""SELECT contribution_id, vendor, CASE WHEN deploy_days <> 7 THEN {R('overall_score')} END AS overall_score, deploy_days, would_buy, count(*) AS n,
 CASE WHEN deploy_days = 7 THEN 'overall_score=n/a' ELSE '' END AS unreadable FROM
 (SELECT CAST(l_orderkey AS VARCHAR) AS contribution_id, s_name AS vendor, l_quantity / 5 AS overall_score, CAST(l_linenumber AS INTEGER) AS deploy_days, CASE l_returnflag WHEN 'N' THEN true WHEN 'A' THEN false END AS would_buy
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""",
)
def lenient_values(spark, sf):
    """Quoted numbers and words for yes and no are read; what is no number is named."""
    parsed = con.parse_contributions(array_json(spark, sf))
    ev = rounded(con.evaluations(parsed).select("contribution_id", "vendor", "overall_score", "deploy_days", "would_buy"), "overall_score")
    bad = con.unreadable_values(parsed).select(
        F.col("contribution_id").alias("__c"), F.concat_ws("=", "field", "value").alias("unreadable")
    ).distinct()
    missing = (F.col("contribution_id") == F.col("__c")) & F.col("overall_score").isNull()
    named = ev.join(bad, missing, "left").drop("__c").withColumn("unreadable", F.coalesce("unreadable", F.lit("")))
    return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


@query(
    "in02_normalised_evals",
    f"""SELECT CAST(l_orderkey AS VARCHAR) AS contribution_id, s_name AS vendor, p_type AS category, {R('l_quantity / 5')} AS overall_score, {R('l_discount * 1000')} AS detection_rate, {R('l_tax * 100')} AS fp_rate,
 CASE WHEN l_orderkey % 2 = 0 THEN 'ok' END AS top_strength, 'api' AS source, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 11 <> 0 GROUP BY ALL""",
)
def normalised_evals(spark, sf):
    ev = con.evaluations(con.parse_contributions(eval_json(spark, sf))).select(
        "contribution_id", "vendor", "category", "overall_score", "detection_rate", "fp_rate", "top_strength", "source"
    )
    out = rounded(ev, "overall_score", "detection_rate", "fp_rate")
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(
    "in01_observations",
    """SELECT CAST(contribution_id AS VARCHAR) AS contribution_id, technique_id, CASE WHEN outcome IS NOT NULL THEN tool END AS tool, outcome, observed, count(*) AS n FROM technique_obs GROUP BY ALL""",
    ("technique_obs",),
)
def parsed_observations(spark, sf):
    maps = con.attack_maps(con.parse_contributions(map_json(spark, sf)))
    keys = ["contribution_id", "technique_id", "tool", "outcome", "observed"]
    return observations(maps).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "in01_bundle_hashes",
    "SELECT sha256(concat('host', CAST(l_partkey AS VARCHAR))) AS value_hash, count(*) AS n FROM lineitem GROUP BY 1",
)
def parsed_bundles(spark, sf):
    bundles = con.ioc_bundles(con.parse_contributions(bundle_json(spark, sf)))
    return (
        bundles.select(F.explode("iocs").alias("i"))
        .groupBy(F.col("i.value_hash").alias("value_hash"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "in03_csv_evals",
    f"""SELECT s_name AS vendor, {R('avg(l_quantity / 5)')} AS avg_score, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <> 7 GROUP BY 1""",
)
def csv_evals(spark, sf):
    """Evaluations out to CSV with untidy headers and back; rows without a vendor disappear."""
    path = scratch_path(spark, "csv")
    e = bridge.evals(spark, sf, "vendor", "overall_score", "detection_rate", "deploy_days")
    e.select(
        F.when(F.col("deploy_days") != 7, F.col("vendor")).alias(" Product "),
        F.col("overall_score").alias("Overall Score"),
        F.col("detection_rate").alias("Detection Rate"),
    ).write.csv(path, header=True)
    out = con.csv_evaluations(spark, path)
    return rounded(
        out.groupBy("vendor").agg(F.avg("overall_score").alias("avg_score"), F.count("*").alias("n")), "avg_score"
    )


STIX_KINDS = ["domain-name", "ipv4-addr", "url", "email-addr", "mutex"]


def stix_documents(spark, sf):
    l = bridge.texts(spark, sf, "lineitem", "l_orderkey")
    number = F.concat(F.lit("T"), (1000 + F.col("l_partkey") % 200).cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in STIX_KINDS]), (F.col("l_partkey") % 5).cast("int") + 1)

    def obj(type_, ident, name, pattern, refs, phases):
        return F.struct(
            F.lit(type_).alias("type"),
            ident.alias("id"),
            name.alias("name"),
            pattern.alias("pattern"),
            refs.alias("external_references"),
            phases.alias("kill_chain_phases"),
        )

    none = F.lit(None).cast("string")
    ref = F.array(
        F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")),
        F.struct(F.lit("mitre-attack").alias("source_name"), number.alias("external_id")),
    )
    no_ref = F.get(ref, F.lit(0))
    phase = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lit("impact").alias("phase_name")))
    technique = obj("attack-pattern", F.lit("p"), number, none, ref, phase)
    indicator = obj(
        "indicator",
        F.lit("i"),
        none,
        F.concat(F.lit("["), kind, F.lit(":value = 'V"), F.col("l_partkey").cast("string"), F.lit("']")),
        F.array(no_ref),
        phase,
    )
    actor = obj("threat-actor", F.lit("a"), F.concat(F.lit("Actor "), F.col("l_suppkey").cast("string")), none, F.array(no_ref), phase)
    grouped = l.groupBy("l_orderkey").agg(
        F.array_sort(F.flatten(F.collect_list(F.array(technique, indicator)))).alias("o"), F.max(actor).alias("a")
    )
    return grouped.select(
        F.to_json(
            F.struct(
                F.lit("bundle").alias("type"),
                F.concat(F.lit("bundle--"), F.col("l_orderkey").cast("string")).alias("id"),
                F.concat("o", F.array("a")).alias("objects"),
            )
        ).alias("value")
    )


@query(
    "in04_stix_techniques",
    """SELECT concat('bundle--', CAST(l_orderkey AS VARCHAR)) AS bundle_id, concat('Actor ', supplier) AS threat_name, technique_id, 'impact' AS tactic, count(*) AS n FROM
 (SELECT l_orderkey, concat('T', CAST(1000 + l_partkey % 200 AS VARCHAR)) AS technique_id, max(CAST(l_suppkey AS VARCHAR)) OVER (PARTITION BY l_orderkey) AS supplier FROM lineitem) GROUP BY ALL""",
)
def stix_techniques(spark, sf):
    t = intel.stix_techniques(intel.parse_stix(stix_documents(spark, sf)))
    return t.groupBy("bundle_id", "threat_name", "technique_id", "tactic").agg(F.count("*").alias("n"))


@query(
    "in04_stix_iocs",
    """SELECT ['domain', 'ip', 'url', 'email', 'mutex'][CAST(l_partkey % 5 AS INTEGER) + 1] AS ioc_type, sha256(concat('v', CAST(l_partkey AS VARCHAR))) AS value_hash, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def stix_iocs(spark, sf):
    i = intel.stix_iocs(intel.parse_stix(stix_documents(spark, sf)))
    return i.groupBy("ioc_type", "value_hash").agg(F.count("*").alias("n"))


MISP_KINDS = ["domain|ip", "ip-src", "sha1", "filename|sha256", "comment"]


@query(
    "in05_misp_iocs",
    """SELECT CAST(l_orderkey AS VARCHAR) AS event_id, 'info' AS notes, ['domain', 'ip', 'hash-sha1', 'hash-sha256'][CAST(l_partkey % 5 AS INTEGER) + 1] AS ioc_type, sha256(concat('m', CAST(l_partkey AS VARCHAR))) AS value_hash, count(*) AS n FROM lineitem WHERE l_partkey % 5 < 4 GROUP BY ALL""",
)
def misp_iocs(spark, sf):
    iocs = intel.misp_iocs(misp_documents(spark, sf))
    return iocs.groupBy("event_id", "notes", "ioc_type", "value_hash").agg(F.count("*").alias("n"))


def misp_documents(spark, sf):
    l = bridge.texts(spark, sf, "lineitem", "l_orderkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in MISP_KINDS]), (F.col("l_partkey") % 5).cast("int") + 1)
    attr = F.struct(kind.alias("type"), F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("value"))
    return l.groupBy("l_orderkey").agg(F.collect_list(attr).alias("Attribute")).select(
        F.to_json(
            F.struct(F.struct(F.col("l_orderkey").cast("string").alias("uuid"), F.lit("info").alias("info"), "Attribute").alias("Event"))
        ).alias("value")
    )


@query(
    "in07_line_feed",
    """SELECT 'firehol' AS source, 'ip' AS ioc_type, concat('10.', CAST(p_size AS VARCHAR), '.', CAST(p_partkey // 250 AS VARCHAR), '.', CAST(p_partkey % 250 AS VARCHAR)) AS value_raw, 'firehol-level1' AS threat_actor, 'blocklist-aggregated' AS campaign FROM part WHERE p_partkey % 10 > 1""",
)
def line_feed(spark, sf):
    """A list with comments and networks in it, written out and read back as a feed file."""
    p = bridge.table(spark, sf, "part")
    k = F.col("p_partkey")
    ip = F.concat(
        F.lit("10."), F.col("p_size").cast("string"), F.lit("."), F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string")
    )
    line = F.when(k % 10 == 0, F.concat(F.lit("# "), ip)).when(k % 10 == 1, F.concat(ip, F.lit("/24"))).otherwise(
        F.concat(F.lit("  "), ip, F.lit(" "))
    )
    path = scratch_path(spark, "firehol")
    p.select(line.alias("value")).write.text(path)
    return feeds.line_feed(feeds.read_lines(spark, path), "firehol")


def _feed_sql(name: str) -> str:
    feed = feeds.LINE_FEEDS[name]
    kept = "m = 3" if feed.length else "m IN (2, 3)" if feed.skip_networks else "m > 0" if feed.comments else "true"
    return f"SELECT '{name}' AS source, '{feed.ioc_type}' AS ioc_type, v AS value_raw, '{feed.threat_actor}' AS threat_actor, '{feed.campaign}' AS campaign FROM b WHERE {kept}"


@query(
    "in07_all_line_feeds",
    """WITH a AS (SELECT p_partkey, p_partkey % 4 AS m, concat('10.', CAST(p_size AS VARCHAR), '.', CAST(p_partkey // 250 AS VARCHAR), '.', CAST(p_partkey % 250 AS VARCHAR)) AS ip FROM part),
 b AS (SELECT m, CASE m WHEN 0 THEN concat('# ', ip) WHEN 1 THEN concat(ip, '/24') WHEN 2 THEN ip ELSE sha256(CAST(p_partkey AS VARCHAR)) END AS v FROM a) """
    + " UNION ALL ".join(_feed_sql(name) for name in feeds.LINE_FEEDS),
)
def all_line_feeds(spark, sf):
    """One file of comments, networks, addresses and hashes, read as each of the feeds."""
    p = bridge.table(spark, sf, "part")
    k = F.col("p_partkey")
    ip = F.concat(
        F.lit("10."), F.col("p_size").cast("string"), F.lit("."), F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string")
    )
    line = (
        F.when(k % 4 == 0, F.concat(F.lit("# "), ip))
        .when(k % 4 == 1, F.concat(ip, F.lit("/24")))
        .when(k % 4 == 2, F.concat(F.lit("  "), ip, F.lit(" ")))
        .otherwise(F.sha2(k.cast("string"), 256))
    )
    path = scratch_path(spark, "feeds")
    p.select(line.alias("value")).write.text(path)
    lines = feeds.read_lines(spark, path)
    out = None
    for name in feeds.LINE_FEEDS:
        rows = feeds.line_feed(lines, name)
        out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "in08_threatfox",
    """SELECT 'threatfox' AS source, CASE p_partkey % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' ELSE 'hash-md5' END AS ioc_type, CASE p_partkey % 3 WHEN 0 THEN concat('10.0.0.', CAST(p_partkey AS VARCHAR)) ELSE concat('v', CAST(p_partkey AS VARCHAR)) END AS value_raw,
 CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS threat_actor, p_name AS campaign FROM part WHERE p_partkey % 7 <> 0""",
)
def threatfox(spark, sf):
    p = bridge.table(spark, sf, "part")
    k = F.col("p_partkey")
    s = k.cast("string")
    value = F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), s, F.lit(":443"))).otherwise(F.concat(F.lit("v"), s))
    kind = F.when(k % 3 == 0, "ip:port").when(k % 3 == 1, "domain").otherwise("md5_hash")
    actor = F.when(k % 2 == 0, "None").otherwise(F.col("p_brand"))
    fields = [F.lit("2024-01-01"), s, value, kind, F.lit("payload"), F.col("p_name"), F.lit("75"), actor, F.lit("t")]
    line = F.concat(F.lit('"'), F.concat_ws('", "', *fields), F.lit('"'))
    lines = p.select(F.when(k % 7 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return feeds.threatfox(lines)


@query(
    "in08_urlhaus",
    """WITH u AS (SELECT url, lower(regexp_extract(url, '^[^/]+//([^/:?#]+)', 1)) AS host FROM pages)
 SELECT 'urlhaus' AS source, 'url' AS ioc_type, url AS value_raw, 'unknown' AS threat_actor, 'malware_download' AS campaign FROM u UNION ALL SELECT 'urlhaus', 'domain', host, 'unknown', 'malware_download' FROM u""",
)
def urlhaus(spark, sf):
    pages = bridge.table(spark, sf, "pages")
    line = F.concat(
        F.lit('"'),
        F.concat_ws('","', F.col("page_id").cast("string"), F.lit("2024-01-01"), "url", F.lit("online"), F.lit("x"), F.lit("malware_download"), F.lit(""), F.lit("reporter")),
        F.lit('"'),
    )
    return feeds.urlhaus(pages.select(line.alias("value")))


@query(
    "in08_other_delimited",
    """SELECT * FROM (SELECT 'ipsum' AS source, 'ip' AS ioc_type, concat('10.1.', CAST(p_partkey AS VARCHAR)) AS value_raw, 'multi-blacklist' AS threat_actor, concat('ipsum-score-', CAST(p_size % 8 AS VARCHAR)) AS campaign FROM part WHERE p_size % 8 >= 3
 UNION ALL SELECT 'dataplane-ssh', 'ip', concat('10.2.', CAST(p_partkey AS VARCHAR)), 'ssh-bruteforce', 'dataplane-sshpwauth' FROM part
 UNION ALL SELECT 'spamhaus-drop', 'ip', concat('10.3.', CAST(p_partkey AS VARCHAR)), 'spamhaus', 'drop-hijacked' FROM part
 UNION ALL SELECT 'ssl-blacklist', 'hash-sha1', left(sha256(CAST(p_partkey AS VARCHAR)), 40), p_name, 'ssl-blacklist' FROM part WHERE p_partkey % 4 <> 0)""",
)
def other_delimited(spark, sf):
    p = bridge.table(spark, sf, "part")
    s = F.col("p_partkey").cast("string")
    ip = lambda n: F.concat(F.lit(f"10.{n}."), s)
    sha = F.when(F.col("p_partkey") % 4 != 0, F.substring(F.sha2(s, 256), 1, 40)).otherwise("short")
    tabbed = p.select(F.concat_ws("\t", ip(1), (F.col("p_size") % 8).cast("string")).alias("value"))
    piped = p.select(F.concat_ws(" | ", F.lit("1"), F.lit("AS"), ip(2), F.lit("now")).alias("value"))
    ranges = p.select(F.concat(ip(3), F.lit("/20 ; SBL1")).alias("value"))
    certs = p.select(F.concat_ws(",", F.lit("2024"), sha, "p_name").alias("value"))
    return (
        feeds.ipsum(tabbed)
        .unionByName(feeds.dataplane(piped))
        .unionByName(feeds.spamhaus(ranges))
        .unionByName(feeds.ssl_blacklist(certs))
    )


def _documents(rows, group, item, wrap):
    """JSON documents as API pages: the items of one group and at most a hundred keys each."""
    page = F.floor(F.col("p_partkey") / 100)
    return rows.groupBy(group.alias("g"), page.alias("page")).agg(F.collect_list(item).alias("x")).select(F.to_json(wrap(F.col("x"))).alias("value"))


@query(
    "in09_json_feeds",
    """SELECT * FROM (SELECT 'feodo' AS source, 'ip' AS ioc_type, concat('10.4.', CAST(p_partkey AS VARCHAR)) AS value_raw, p_brand AS threat_actor, concat(p_brand, '-c2') AS campaign FROM part
 UNION ALL SELECT 'cisa-kev', 'cve', concat('CVE-2024-', CAST(p_partkey AS VARCHAR)), p_brand, 'ransomware-kev' FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 'abuseipdb', 'ip', concat('10.5.', CAST(p_partkey AS VARCHAR)), 'abuse-reported', concat('abuseipdb-', CAST(p_size AS VARCHAR)) FROM part
 UNION ALL SELECT 'otx-alienvault', CASE p_partkey % 3 WHEN 0 THEN 'ip' ELSE 'domain' END, concat('o', CAST(p_partkey AS VARCHAR)), p_brand, p_brand FROM part WHERE p_partkey % 3 < 2
 UNION ALL SELECT 'pulsedive', 'ip', concat('p', CAST(p_partkey AS VARCHAR)), 'critical', 'pulsedive-feed' FROM part
 UNION ALL SELECT 'hybrid-analysis', 'hash-sha256', sha256(CAST(p_partkey AS VARCHAR)), 'malicious', 'hybrid-analysis-daily' FROM part WHERE p_partkey % 2 = 0)""",
)
def json_feeds(spark, sf):
    p = bridge.table(spark, sf, "part")
    k, s, g = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_brand")
    bare = lambda x: x
    under = lambda name: (lambda x: F.struct(x.alias(name)))
    feodo = _documents(p, g, F.struct(F.concat(F.lit("10.4."), s).alias("ip_address"), g.alias("malware")), bare)
    kev = _documents(
        p,
        g,
        F.struct(
            F.concat(F.lit("CVE-2024-"), s).alias("cveID"),
            g.alias("vendorProject"),
            F.when(k % 3 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
        ),
        under("vulnerabilities"),
    )
    abuse = _documents(
        p, g, F.struct(F.concat(F.lit("10.5."), s).alias("ipAddress"), F.col("p_size").alias("abuseConfidenceScore")), under("data")
    )
    kind = F.when(k % 3 == 0, "IPv4").when(k % 3 == 1, "hostname").otherwise("YARA")
    pulses = _documents(
        p, g, F.struct(kind.alias("type"), F.concat(F.lit("o"), s).alias("indicator"), g.alias("b")), bare
    ).select(F.from_json("value", "array<struct<type:string,indicator:string,b:string>>").alias("i"))
    otx = pulses.select(
        F.to_json(
            F.struct(F.array(F.struct(F.get("i", F.lit(0)).getField("b").alias("name"), F.col("i").alias("indicators"))).alias("results"))
        ).alias("value")
    )
    dive = _documents(
        p, g, F.struct(F.lit("IP").alias("type"), F.concat(F.lit("p"), s).alias("indicator"), F.lit("critical").alias("risk")), under("results")
    )
    hybrid = _documents(
        p,
        g,
        F.struct(F.sha2(s, 256).alias("sha256"), F.when(k % 2 == 0, "malicious").otherwise("clean").alias("threat_level_human")),
        under("data"),
    )
    return (
        feeds.feodo(feodo)
        .unionByName(feeds.known_exploited(kev))
        .unionByName(feeds.abuse_reports(abuse))
        .unionByName(feeds.otx(otx))
        .unionByName(feeds.pulsedive(dive))
        .unionByName(feeds.hybrid_analysis(hybrid))
    )


@query(
    "in09_nvd",
    """SELECT concat('CVE-2023-', CAST(p_partkey AS VARCHAR)) AS value_raw, p_brand AS threat_actor, CASE p_partkey % 4 WHEN 0 THEN 9.8 WHEN 1 THEN 7.5 WHEN 2 THEN 5.0 END AS cvss_score FROM part""".replace(
        "THEN 9.8 WHEN 1 THEN 7.5 WHEN 2 THEN 5.0 END", "THEN 9.8::DOUBLE WHEN 1 THEN 7.5::DOUBLE WHEN 2 THEN 5.0::DOUBLE END"
    ),
)
def nvd(spark, sf):
    p = bridge.table(spark, sf, "part")
    k = F.col("p_partkey")

    def metric(score):
        return F.array(F.struct(F.struct(F.lit(score).alias("baseScore")).alias("cvssData")))

    item = F.struct(
        F.struct(
            F.concat(F.lit("CVE-2023-"), k.cast("string")).alias("id"),
            F.col("p_brand").alias("sourceIdentifier"),
            F.struct(
                F.when(k % 4 == 0, metric(9.8)).alias("cvssMetricV31"),
                F.when(k % 4 == 1, metric(7.5)).alias("cvssMetricV30"),
                F.when(k % 4 < 3, metric(5.0)).alias("cvssMetricV2"),
            ).alias("metrics"),
        ).alias("cve")
    )
    docs = _documents(p, F.col("p_brand"), item, lambda x: F.struct(x.alias("vulnerabilities")))
    return feeds.nvd(docs).select("value_raw", "threat_actor", "cvss_score")


@query(
    "in10_advisories",
    """SELECT 'jpcert' AS source, 'advisory' AS ioc_type, concat('https://a.example/', CAST(p_partkey AS VARCHAR)) AS value_raw, 'JPCERT' AS threat_actor,
 CASE WHEN p_partkey % 2 = 0 THEN concat('CVE-2024-', lpad(CAST(p_partkey AS VARCHAR), 5, '0'), ', CVE-2020-0001') ELSE 'jpcert-advisory' END AS campaign FROM part WHERE p_partkey % 5 <> 0""",
)
def advisories(spark, sf):
    p = bridge.table(spark, sf, "part")
    k = F.col("p_partkey")
    s = k.cast("string")
    title = F.when(k % 2 == 0, F.concat(F.lit("Flaw CVE-2024-"), F.lpad(s, 5, "0"))).otherwise("Notice")
    body = F.when(k % 2 == 0, F.lit("see CVE-2020-0001\nand more")).otherwise("nothing")
    link = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://a.example/"), s))
    item = F.concat(
        F.lit("<item rdf:about='x'>\n<title>"), title, F.lit("</title>\n<link> "), link, F.lit(" </link><description>"), body,
        F.lit("</description></item>"),
    )
    page = F.floor(k / 100)
    docs = p.groupBy(page.alias("page")).agg(F.concat_ws("\n", F.collect_list(item)).alias("value")).select("value")
    return feeds.advisories(docs)


@query(
    "in13_cef_iocs",
    """SELECT signature_id, ioc_type, value_hash FROM (SELECT CAST(event_id AS VARCHAR) AS signature_id, 'ip' AS ioc_type, sha256(concat('10.9.', CAST(user_id AS VARCHAR), '.1')) AS value_hash FROM events
 UNION ALL SELECT CAST(event_id AS VARCHAR), 'domain', sha256(concat('host', CAST(user_id AS VARCHAR), '.example.net')) FROM events
 UNION ALL SELECT CAST(event_id AS VARCHAR), 'url', sha256(concat('http://h', CAST(event_id AS VARCHAR), '.example.org/a b?x=1')) FROM events)""",
)
def cef_iocs(spark, sf):
    from hexvigil.plans.streams import CEF_LINES

    path = scratch_path(spark, "syslog")
    ev = bridge.table(spark, sf, "events")
    ev.select(F.expr(CEF_LINES).alias("value")).write.text(path)
    return evt.cef_iocs(evt.parse_cef(spark.read.text(path))).select("signature_id", "ioc_type", "value_hash")


@query(
    "in14_edr_detections",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS detection_id, CASE WHEN l_linenumber <> 3 THEN concat('T', CAST(1000 + l_partkey % 200 AS VARCHAR)) END AS technique_id,
 CASE l_returnflag WHEN 'A' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN l_linenumber < 3 THEN 'hash-sha256' WHEN l_linenumber < 5 THEN 'ip' WHEN l_linenumber = 5 THEN 'hash-md5' END AS ioc_type,
 CASE WHEN l_linenumber < 3 THEN sha256(concat('s', CAST(l_partkey AS VARCHAR))) WHEN l_linenumber < 5 THEN sha256(concat('10.', CAST(l_suppkey AS VARCHAR))) WHEN l_linenumber = 5 THEN sha256(concat('m', CAST(l_partkey AS VARCHAR))) END AS value_hash FROM lineitem""",
)
def edr_detections(spark, sf):
    l = bridge.texts(spark, sf, "lineitem", "l_orderkey")
    n = F.col("l_linenumber")
    part = F.col("l_partkey").cast("string")
    behaviour = F.struct(
        F.when(n != 3, F.concat(F.lit("T"), (1000 + F.col("l_partkey") % 200).cast("string"))).alias("technique_id"),
        F.when(n < 3, F.concat(F.lit("S"), part)).alias("sha256"),
        F.when((n < 3) | (n == 5), F.concat(F.lit("M"), part)).alias("md5"),
    )
    docs = l.select(
        F.to_json(
            F.struct(
                (F.col("l_orderkey") * 10 + n).cast("string").alias("detection_id"),
                F.when(F.col("l_returnflag") == "A", "High").alias("max_severity_displayname"),
                F.struct(F.when(n < 5, F.concat(F.lit("10."), F.col("l_suppkey").cast("string"))).alias("external_ip")).alias("device"),
                F.array(behaviour).alias("behaviors"),
            )
        ).alias("value")
    )
    return evt.edr_detections(docs).select("detection_id", "technique_id", "severity", "ioc_type", "value_hash")


def webhook_documents(spark, sf):
    """The five body shapes in turn."""
    l = bridge.texts(spark, sf, "lineitem", "l_orderkey")
    part = F.col("l_partkey").cast("string")
    tid = F.concat(F.lit("T"), (1000 + F.col("l_partkey") % 200).cast("string"))
    detection = F.struct(
        F.struct(
            tid.alias("technique"), F.lit("impact").alias("tactic"), F.lit("HIGH").alias("severity"), F.lit("hash-md5").alias("ioc_type"),
            F.concat(F.lit("D"), part).alias("ioc_value"),
        ).alias("detection")
    )
    incident = F.struct(
        F.struct(
            F.lit("Low").alias("severity"),
            F.array(tid, F.lit("T1566")).alias("techniques"),
            F.array(
                F.struct(F.lit("Ip").alias("kind"), F.concat(F.lit("10."), part).alias("address"), F.lit(None).cast("string").alias("hostName")),
                F.struct(F.lit("Account").alias("kind"), F.lit(None).cast("string").alias("address"), F.concat(F.lit("H"), part).alias("hostName")),
            ).alias("entities"),
        ).alias("properties")
    )
    cef = F.struct(F.concat(F.lit("CEF:0|V|P|1|1|n|5|src=C"), part, F.lit(" dst=-")).alias("cef"))
    indicators = F.struct(F.array(F.struct(F.lit("url").alias("type"), F.concat(F.lit("U"), part).alias("value"))).alias("indicators"))
    iocs = F.struct(
        F.array(
            F.struct(F.lit("domain").alias("ioc_type"), F.concat(F.lit("G"), part).alias("value_raw"), F.lit(None).cast("string").alias("value_hash")),
            F.struct(F.lit("domain").alias("ioc_type"), F.lit(None).cast("string").alias("value_raw"), F.sha2(part, 256).alias("value_hash")),
        ).alias("iocs"),
        F.lit("splunk").alias("source"),
    )
    n = F.col("l_partkey") % 5
    body = (
        F.when(n == 0, F.to_json(detection))
        .when(n == 1, F.to_json(incident))
        .when(n == 2, F.to_json(cef))
        .when(n == 3, F.to_json(indicators))
        .otherwise(F.to_json(iocs))
    )
    return l.select(body.alias("value"))


@query(
    "in15_webhook_techniques",
    """WITH l AS (SELECT l_partkey % 5 AS n, concat('T', CAST(1000 + l_partkey % 200 AS VARCHAR)) AS tid FROM lineitem)
 SELECT technique_id, severity, source, count(*) AS n FROM (SELECT tid AS technique_id, 'high' AS severity, 'edr' AS source FROM l WHERE n = 0 UNION ALL SELECT tid, 'low', 'siem' FROM l WHERE n = 1 UNION ALL SELECT 'T1566', 'low', 'siem' FROM l WHERE n = 1) GROUP BY ALL""",
)
def webhook_techniques(spark, sf):
    rows = evt.webhook_techniques(evt.parse_webhooks(webhook_documents(spark, sf)))
    return rows.groupBy("technique_id", "severity", "source").agg(F.count("*").alias("n"))


@query(
    "in15_webhook_iocs",
    """WITH l AS (SELECT l_partkey % 5 AS n, CAST(l_partkey AS VARCHAR) AS p FROM lineitem)
 SELECT ioc_type, value_hash, source, count(*) AS n FROM (SELECT 'hash-md5' AS ioc_type, sha256(concat('d', p)) AS value_hash, 'edr' AS source FROM l WHERE n = 0 UNION ALL SELECT 'ip', sha256(concat('10.', p)), 'siem' FROM l WHERE n = 1
 UNION ALL SELECT 'domain', sha256(concat('h', p)), 'siem' FROM l WHERE n = 1 UNION ALL SELECT 'ip', sha256(concat('c', p)), 'cef:V:P' FROM l WHERE n = 2 UNION ALL SELECT 'url', sha256(concat('u', p)), 'indicators' FROM l WHERE n = 3
 UNION ALL SELECT 'domain', sha256(concat('g', p)), 'splunk' FROM l WHERE n = 4 UNION ALL SELECT 'domain', sha256(p), 'splunk' FROM l WHERE n = 4) GROUP BY ALL""",
)
def webhook_iocs(spark, sf):
    rows = evt.webhook_iocs(evt.parse_webhooks(webhook_documents(spark, sf)))
    return rows.groupBy("ioc_type", "value_hash", "source").agg(F.count("*").alias("n"))


def layer_documents(spark, sf):
    o = bridge.table(spark, sf, "orders")
    entry = F.struct(
        F.concat(F.lit("T"), (1000 + F.col("o_orderkey") % 200).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".002").otherwise("")).alias("techniqueID"),
        F.when(F.col("o_orderkey") % 4 != 0, F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("score"),
    )
    part = F.floor(F.col("o_orderkey") / 1000)
    return o.groupBy("o_custkey", part.alias("part")).agg(F.collect_list(entry).alias("techniques")).select(
        F.to_json(F.struct(F.col("o_custkey").cast("string").alias("name"), "techniques")).alias("value")
    )


LAYER_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS layer, concat('T', CAST(1000 + o_orderkey % 200 AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN '.002' ELSE '' END) AS technique_id,
 CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / 5000) ELSE 0 END AS score FROM orders"""


@query(
    "in26_navigator_layers",
    f"SELECT layer, technique_id, score, score > 50 AS covered, count(*) AS n FROM ({LAYER_SQL}) GROUP BY ALL",
)
def navigator_layers(spark, sf):
    rows = intel.parse_layers(layer_documents(spark, sf))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(
    "in26_inferred_stack",
    f"""WITH c AS (SELECT DISTINCT layer, technique_id FROM ({LAYER_SQL}) WHERE score > 50),
 v AS (SELECT layer, c.technique_id, unnest(m.primary_vendors) AS vendor_id, generate_subscripts(m.primary_vendors, 1) AS pos FROM c JOIN technique_map m ON m.technique_id = split_part(c.technique_id, '.', 1)),
 r AS (SELECT layer, v.vendor_id, row_number() OVER (PARTITION BY layer, technique_id, kind ORDER BY pos) AS rn FROM v JOIN registry g ON g.vendor_id = v.vendor_id) SELECT DISTINCT layer, vendor_id AS tool FROM r WHERE rn = 1""",
    ("technique_map", "registry"),
)
def inferred_stack(spark, sf):
    layers = intel.parse_layers(layer_documents(spark, sf))
    return intel.inferred_stack(layers, bridge.technique_map(spark), bridge.registry(spark, sf))


def export_inputs(spark, sf):
    iocs = bridge.bundle_ioc(spark, sf).select("ioc_type", F.col("value_hash").alias("value")).distinct()
    evals = bridge.evals(spark, sf, "vendor", "category", "overall_score", "source")
    tech = bridge.technique_map(spark).select("technique_id", F.col("name").alias("technique_name"))
    return iocs, evals, tech


def _uuid5_sql(kind: str, name: str) -> str:
    h = f"sha1(unhex('{exports.DNS_NAMESPACE}') || encode({name}))"
    variant = f"['8', '9', 'a', 'b'][CAST(concat('0x', substr({h}, 17, 1)) AS INTEGER) % 4 + 1]"
    return f"concat('{kind}--', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, substr({h}, 18, 3), '-', substr({h}, 21, 12))"


def _object_sql(kind: str, name: str, rest: str) -> str:
    identity = _uuid5_sql("identity", f"'{exports.PRODUCER}'")
    return f"CAST(json_object('type', '{kind}', 'spec_version', '2.1', 'id', {_uuid5_sql(kind, name)}, 'created', '{AS_OF}', 'modified', '{AS_OF}', 'created_by_ref', {identity}, {rest}) AS VARCHAR) AS value"


STIX_OBJECT_SQL = f"""SELECT CAST(json_object('type', 'identity', 'spec_version', '2.1', 'id', {_uuid5_sql("identity", f"'{exports.PRODUCER}'")}, 'created', '{AS_OF}', 'modified', '{AS_OF}', 'name', '{exports.PRODUCER}', 'identity_class', 'tool') AS VARCHAR) AS value
 UNION ALL SELECT {_object_sql('indicator', "concat(ioc_type, ':', v)", f"'name', concat(ioc_type, ': ', v), 'pattern', concat('[', path, ' = ', chr(39), v, chr(39), ']'), 'pattern_type', 'stix', 'valid_from', '{AS_OF}', 'labels', ['malicious-activity']")} FROM
 (SELECT DISTINCT ioc_type, value_hash AS v, CASE ioc_type WHEN 'ip' THEN 'ipv4-addr:value' WHEN 'domain' THEN 'domain-name:value' WHEN 'url' THEN 'url:value' WHEN 'email' THEN 'email-addr:value' WHEN 'hash-md5' THEN 'file:hashes.MD5' WHEN 'hash-sha256' THEN concat('file:hashes.', chr(39), 'SHA-256', chr(39)) END AS path FROM bundle_ioc)
 UNION ALL SELECT {_object_sql('note', "concat('eval:', vendor, ':', CAST(m AS VARCHAR))", f"'content', concat('Vendor evaluation: ', vendor, ' scored ', CAST(m AS VARCHAR)), 'object_refs', [{_uuid5_sql('identity', chr(39) + exports.PRODUCER + chr(39))}]")} FROM (SELECT vendor, {R('avg(overall_score)')} AS m FROM evals GROUP BY vendor)
 UNION ALL SELECT {_object_sql('attack-pattern', 'technique_id', "'name', concat(technique_id, ' ', name), 'external_references', [json_object('source_name', 'mitre-attack', 'external_id', technique_id, 'url', concat('https://attack.mitre.org/techniques/', replace(technique_id, '.', '/'), '/'))]")} FROM technique_map"""


@query("out1_stix_objects", STIX_OBJECT_SQL, ("bundle_ioc", "evals", "technique_map"))
def stix_objects(spark, sf):
    iocs, evals, tech = export_inputs(spark, sf)
    means = rounded(evals.groupBy("vendor").agg(F.avg("overall_score").alias("overall_score")), "overall_score")
    return exports.identity_object(spark, AS_OF).unionByName(exports.stix_objects(AS_OF, iocs, means, tech))


@query(
    "out2_misp_attributes",
    """SELECT CASE ioc_type WHEN 'ip' THEN 'ip-dst' WHEN 'domain' THEN 'domain' WHEN 'url' THEN 'url' WHEN 'email' THEN 'email-src' WHEN 'hash-sha256' THEN 'sha256' WHEN 'hash-md5' THEN 'md5' END AS type,
 CASE WHEN ioc_type IN ('ip', 'domain', 'url') THEN 'Network activity' ELSE 'Payload delivery' END AS category, value_hash AS value, true AS to_ids FROM (SELECT DISTINCT ioc_type, value_hash FROM bundle_ioc)
 UNION ALL SELECT 'text', 'External analysis', concat('MITRE ATT&CK: ', technique_id), false FROM technique_map""",
    ("bundle_ioc", "technique_map"),
)
def misp_attributes(spark, sf):
    iocs, _, tech = export_inputs(spark, sf)
    return exports.misp_attributes(AS_OF, iocs, tech).drop("uuid", "timestamp")


@query(
    "out3_flat_csv",
    f"""SELECT type, value, category, source, timestamp, extra, count(*) AS n FROM (SELECT ioc_type AS type, value_hash AS value, 'ioc' AS category, NULL AS source, NULL AS timestamp, NULL AS extra FROM (SELECT DISTINCT ioc_type, value_hash FROM bundle_ioc)
 UNION ALL SELECT 'eval', vendor, category, source, NULL, concat('score=', CAST(CAST(round(overall_score * 5) AS INTEGER) AS VARCHAR)) FROM evals
 UNION ALL SELECT 'technique', technique_id, 'attack-map', NULL, NULL, name FROM technique_map) GROUP BY ALL""",
    ("bundle_ioc", "evals", "technique_map"),
)
def flat_csv(spark, sf):
    """Written as CSV and read back; scores go out as whole fifths, so that both engines spell them alike."""
    iocs, evals, tech = export_inputs(spark, sf)
    whole = evals.withColumn("overall_score", F.round(F.col("overall_score") * 5).cast("int"))
    path = scratch_path(spark, "flat")
    exports.write_csv(exports.flat_rows(iocs, whole, tech), path)
    back = spark.read.csv(path, header=True)
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


@query(
    "out4_navigator_layers",
    tplans.GAP_SQL + """ SELECT stack_id, CAST(json_object('name', concat_ws(' ', CAST(stack_id AS VARCHAR), vertical, 'coverage'), 'versions', json_object('layer', '4.5', 'attack', '14'), 'domain', 'enterprise-attack',
 'techniques', to_json(list({techniqueID: technique_id, score: CASE WHEN covered THEN 100 ELSE 25 END, color: CASE WHEN covered THEN '#31a354' ELSE '#de2d26' END,
  comment: CASE WHEN covered THEN concat('Covered by: ', replace(covering_tools, ',', ', ')) ELSE concat('Suggested: ', replace(suggested_categories, ',', ', ')) END, enabled: true} ORDER BY rank)),
 'gradient', json_object('colors', ['#de2d26', '#fee08b', '#31a354'], 'minValue', 0, 'maxValue', 100)) AS VARCHAR) AS value FROM gr GROUP BY stack_id, vertical""",
    ("technique_map", "stack", "org_vertical"),
)
def export_layers(spark, sf):
    return exports.navigator_layers(tplans.gap_rows(spark, sf))


@query(
    "out5_saved_tables",
    f"""SELECT 'contribution:eval' AS part, count(*) AS n, {R('sum(l_quantity / 5)')} AS total FROM lineitem UNION ALL SELECT 'contribution:attack_map', count(DISTINCT l_orderkey), NULL FROM lineitem
 UNION ALL SELECT 'contribution:ioc_bundle', count(DISTINCT l_orderkey), NULL FROM lineitem UNION ALL SELECT 'technique', count(*), NULL FROM lineitem UNION ALL SELECT 'ioc', count(*), NULL FROM lineitem""",
)
def saved_tables(spark, sf):
    """All kinds stored by type with child tables, and read back part by part."""
    path = scratch_path(spark, "store")
    ev = bridge.evals(spark, sf, "contribution_id", "vendor", "category", "overall_score").withColumn(
        "contribution_id", F.col("contribution_id").cast("string")
    )
    maps = con.attack_maps(con.parse_contributions(map_json(spark, sf)))
    bundles = con.ioc_bundles(con.parse_contributions(bundle_json(spark, sf)))
    exports.save_tables(path, ev, maps, bundles)

    def size(name, kind=None):
        df = exports.load_table(spark, path, name, kind)
        total = F.sum("overall_score") if kind == "eval" else F.lit(None).cast("double")
        label = name if kind is None else f"{name}:{kind}"
        return df.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(label).alias("part"), "n", r6("total").alias("total"))

    out = size("contribution", "eval")
    for part in (size("contribution", "attack_map"), size("contribution", "ioc_bundle"), size("technique"), size("ioc")):
        out = out.unionByName(part)
    return out
