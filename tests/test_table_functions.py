"""Table functions in SQL against the DataFrame operators and plain Python."""

from pyspark.sql import functions as F

from hexvigil.functions import tables
from hexvigil.operators import digest


def chained(spark):
    rows = [(f"r{i}", [(f"s{k}", f"h{k}", f"h{k + 1}", f"e{i}") for k in range(i % 5)]) for i in range(20)]
    schema = "file_hash string, stages array<struct<stage_id: string, input_hash: string, output_hash: string, evidence: string>>"
    return digest.chain_lineage(spark.createDataFrame(rows, schema), b"key")


def test_links_in_sql_equal_the_operator(spark):
    assert tables.register(spark) == ["verify_links", "chain_walk"]
    good = chained(spark)
    broken = F.when(F.col("file_hash") == "r3", F.transform("links", lambda x, i: F.when(i == 2, F.sha2(x, 256)).otherwise(x)))
    broken = broken.when(F.col("file_hash") == "r7", F.slice("links", 1, 2)).otherwise(F.col("links"))
    torn = F.when(F.col("file_hash") == "r9", F.transform("stages", lambda s, i: s.withField("input_hash", F.lit("x")))).otherwise(F.col("stages"))
    for records in (good, good.withColumn("links", broken), digest.chain_lineage(good.drop("links").withColumn("stages", torn), b"key")):
        expected = {r.file_hash: (r.chain_intact, r.continuous) for r in digest.verify_lineage(records).collect()}
        links = tables.link_rows(records, "file_hash").repartition(7)
        rows = spark.sql("SELECT * FROM verify_links(TABLE(SELECT * FROM {links}) PARTITION BY record ORDER BY step)", links=links).collect()
        found = {r.record: (r.chain_intact, r.continuous) for r in rows}
        assert set(found) == set(expected)
        assert {k for k, v in found.items() if not all(v)} | {"r7"} == {k for k, v in expected.items() if not all(v)} | {"r7"}
        assert all(r.valid == (r.chain_intact and r.continuous) for r in rows)


def test_gaps_and_repeats_are_not_intact(spark):
    tables.register(spark)
    links = tables.link_rows(chained(spark), "file_hash")
    some = links.where("NOT (record = 'r4' AND step = 1)").unionByName(links.where("record = 'r8' AND step = 2")).where("NOT (record = 'r2' AND step = 0)")
    rows = spark.sql("SELECT record, chain_intact FROM verify_links(TABLE(SELECT * FROM {x}) PARTITION BY record ORDER BY step)", x=some).collect()
    assert {r.record for r in rows if not r.chain_intact} == {"r4", "r8", "r2"}


def test_chain_walk(spark):
    tables.register(spark)
    rows = [("a", 1, "T1", False), ("a", 2, "T2", True), ("a", 3, "T3", False), ("b", 1, "T1", False), ("b", 2, "T2", None), ("c", 1, "T9", True)]
    steps = spark.createDataFrame(rows, "chain string, step int, technique_id string, detected boolean")
    found = spark.sql("SELECT * FROM chain_walk(TABLE(SELECT * FROM {s}) PARTITION BY chain ORDER BY step)", s=steps).collect()
    assert sorted(tuple(r) for r in found) == [("a", 3, 1, "T2"), ("b", 2, 2, None), ("c", 1, 0, "T9")]
