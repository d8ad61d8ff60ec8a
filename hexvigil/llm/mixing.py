"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Each document has a 60-bit hash of its id.  A source's share of one more copy goes to the documents whose hash lies
below a threshold, so a larger budget takes a superset of a smaller one and nothing is sorted.  The threshold comes
from histograms: words by source and 12-bit hash bucket give the bucket in which the budget ends; only that bucket is
refined by the next 12 bits, until it holds a single hash.  A hot source is spread over its buckets by map-side sums,
and over salts when its threshold is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexvigil.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
SALTS = 64


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the id's md5; of the text's where the id is null."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_hash": document_hash(),
        "_named": F.col("source").isNotNull(),
        "_source": F.coalesce("source", F.lit("")),
    })


def _numbered(sources: DataFrame) -> DataFrame:
    """Rank of each source by code point, null last, from 0: by range partition, so that no task sees all sources."""
    parts = cut_lineage(
        sources.repartitionByRange(F.desc("_named"), "_source").withColumn("_part", F.spark_partition_id())
    )
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(F.desc("_named"), "_source")) - 1
    return parts.join(before, "_part").withColumn("rank", nth + F.col("_before")).drop("_part", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds rank, weight and target: shares of all words by weight, none above ``most`` times its source's words.

    The excess is reshared by weight until no source is above; each round takes one aggregation, of which the driver
    gets two sums.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut_lineage(_numbered(sources).withColumn("weight", weight))
    total, level, seen = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while True:
        full = (F.col("weight") * F.lit(level) >= most * F.col("source_size")) & F.lit(seen is not None)
        capped, open_weight, n = sources.agg(
            F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if n == seen or not open_weight or not total:
            break
        level, seen = float(total - most * (capped or 0)) / open_weight, n
    top = most * F.col("source_size")
    return sources.withColumn(
        "target", F.when(F.col("weight") * F.lit(level) >= top, top.cast("double")).otherwise(F.col("weight") * F.lit(level))
    )


def _thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds times (whole copies of every document) and threshold (one more copy for hashes below it)."""
    key = ["_named", "_source"]
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = cut_lineage(
        sources.withColumn("times", whole.cast("long")).withColumn(
            "_budget", F.col("target") - F.col("times") * F.col("source_size")
        )
    )
    state = sources.filter("_budget > 0").select(*key, "_budget", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    inside = sized.filter("size > 0").select(*key, "_hash", "size")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            # Only the boundary bucket of each source goes on.
            at = inside.withColumn("_prefix", F.shiftright("_hash", shift + BITS))
            inside = cut_lineage(at.join(state.select(*key, "_prefix"), [*key, "_prefix"], "left_semi").drop("_prefix"))
        bucket = F.shiftright("_hash", shift)
        sums = inside.groupBy(*key, bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
        running = F.sum("_words").over(W.partitionBy(*key).orderBy("_bucket"))
        state = cut_lineage(
            sums.withColumn("_to", running)
            .join(state.select(*key, "_budget", "_before"), key)
            .withColumn("_from", F.col("_before") + F.col("_to") - F.col("_words"))
            .filter((F.col("_from") < F.col("_budget")) & (F.col("_from") + F.col("_words") >= F.col("_budget")))
            .select(*key, "_budget", F.col("_bucket").alias("_prefix"), F.col("_from").alias("_before"), "_words")
        )
    # The hash at which the budget ends is taken if that comes nearer to it.
    nearer = (F.col("_before") + F.col("_words") / 2.0 < F.col("_budget")).cast("long")
    ends = state.select(*key, (F.col("_prefix") + nearer).alias("threshold"))
    return sources.join(ends, key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with size, source_size, target, taken and times.

    ``size`` counts the words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0).  Sources by code point, null last, weigh
    ``weights``, repeating, and share all words; a target stops at ``most`` times its source's words and the excess is
    reshared.  ``times`` is how often the mix takes the document and ``taken`` its words, repeats counted.  A source
    comes within half a document of its target.  Rows that repeat a doc_id share its hash, hence their decision; rows
    with a null doc_id go by their text.  Documents without words have taken 0.  An empty table gives no rows.
    Columns of ``docs`` that have a result's name are replaced; names that begin with ``_`` are reserved.
    """
    keyed = _keyed(docs)
    sized = cut_lineage(keyed.select("_named", "_source", "_hash", "size"))
    sources = sized.groupBy("_named", "_source").agg(F.sum("size").alias("source_size"))
    found = _thresholds(sized, targets(sources, weights, most))
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(
        "_named", "_source", "_salt", "source_size", "target", "times", "threshold"
    )
    drop = ["source_size", "target", "times", "taken", "threshold"]
    return (
        keyed.drop(*drop)
        .withColumn("_salt", F.pmod("_hash", F.lit(SALTS)).cast("int"))
        .join(salted, ["_named", "_source", "_salt"])
        .withColumn("times", F.col("times") + (F.col("_hash") < F.col("threshold")).cast("long"))
        .withColumn("taken", F.col("times") * F.col("size"))
        .drop("_named", "_source", "_salt", "_hash", "threshold")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (
  SELECT *, row_number() OVER r AS k, sum(s) OVER () AS t, sum(s) OVER r - s AS below,
    sum(w) OVER () - sum(w) OVER r + w AS above
  FROM w WINDOW r AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT min_by(CAST(t - 3 * below AS DOUBLE) / above, k) AS level FROM o
  WHERE 3 * s > w * (CAST(t - 3 * below AS DOUBLE) / above)),
g AS (
  SELECT source, s, CASE WHEN w * coalesce(level, 0) >= 3 * s THEN CAST(3 * s AS DOUBLE) ELSE w * level END AS target
  FROM w, l),
c AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS times FROM g),
p AS (
  SELECT d.doc_id, d.size, d.h, c.s, c.target, c.times, c.target - c.times * c.s AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.h) AS here
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (times + CASE WHEN here > 0 AND upto - here / 2.0 < budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
