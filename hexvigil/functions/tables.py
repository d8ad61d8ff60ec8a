"""Table functions that Spark SQL calls with a TABLE argument, one partition of rows at a time."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class VerifyLinks:
    """H6: one row per record from its links in order of ``step``; holds the last link only, however long the chain.

    ``links(record, step, stage, input_hash, output_hash, link)``: step 0 carries the root link, every other one its stage
    as JSON.  A chain is intact if every link is the keyed hash of its stage under the link before it, continuous if each
    stage takes in what the last gave out.  A record without a root, with a gap or with a step twice isn't intact.
    """

    def __init__(self):
        self.record = self.link = self.output = None
        self.steps, self.intact, self.continuous = -1, True, True

    def eval(self, row: Row):
        self.record = row["record"]
        self.steps += 1
        if row["step"] != self.steps or row["link"] is None:
            self.intact = False
        elif self.steps:
            expected = self.intact and hmac.new(bytes.fromhex(self.link), (row["stage"] or "").encode(), hashlib.sha256).hexdigest()
            self.intact = expected == row["link"]
            self.continuous = self.continuous and (self.steps == 1 or row["input_hash"] == self.output)
        self.link, self.output = row["link"], row["output_hash"]

    def terminate(self):
        if self.steps >= 0:
            yield self.record, self.steps, self.link, self.intact, self.continuous, self.intact and self.continuous


class ChainWalk:
    """How far an attack chain can be walked unseen: one row per chain from its steps in order.

    ``steps(chain, step, technique_id, detected)``: the walk goes on until the first detected step.
    """

    def __init__(self):
        self.chain, self.steps, self.walked, self.stopped = None, 0, 0, None

    def eval(self, row: Row):
        self.chain, self.steps = row["chain"], self.steps + 1
        if self.stopped is None:
            if row["detected"]:
                self.stopped = row["technique_id"]
            else:
                self.walked += 1

    def terminate(self):
        if self.steps:
            yield self.chain, self.steps, self.walked, self.stopped


TABLE_FUNCTIONS = {
    "verify_links": (VerifyLinks, "record string, steps int, last_link string, chain_intact boolean, continuous boolean, valid boolean"),
    "chain_walk": (ChainWalk, "chain string, steps int, walked int, stopped_by string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the table functions for this session; gives their names."""
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
    return list(TABLE_FUNCTIONS)


def link_rows(records: DataFrame, record: str) -> DataFrame:
    """The rows that ``verify_links`` reads from records with ``stages`` and ``links``: one per link, in any order."""
    every = records.select(F.col(record).cast("string").alias("record"), "stages", F.posexplode("links").alias("step", "link"))
    stage = F.get("stages", F.col("step") - 1)
    return every.select(
        "record", "step", F.when(F.col("step") > 0, F.to_json(stage)).alias("stage"),
        stage.getField("input_hash").alias("input_hash"), stage.getField("output_hash").alias("output_hash"), "link",
    )
