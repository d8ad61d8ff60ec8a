"""Verifiable tables: row hashes, Merkle roots and proofs, receipts, lineage, commitments."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexvigil.functions.bind import once
from hexvigil.functions.hashing import hmac_column_key, hmac_sha256, row_hash
from hexvigil.functions.prefix import positions
from hexvigil.session import cut_lineage, stored

EMPTY_ROOT = hashlib.sha256(b"empty").hexdigest()
PAD_LEAF = hashlib.sha256(b"pad").hexdigest()


def hashed_rows(df: DataFrame, columns: list[str] | None = None, name: str = "row_hash") -> DataFrame:
    """H1: the canonical hash of every row beside it."""
    return df.withColumn(name, row_hash(columns or df.columns))


def compare_tables(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """H1: row hashes whose number of copies differs between two tables.

    Copies are counted before the join, so a row repeated a billion times is one row of it.
    """
    l = left.select(row_hash(columns).alias("row_hash")).groupBy("row_hash").agg(F.count("*").alias("left_copies"))
    r = right.select(row_hash(columns).alias("row_hash")).groupBy("row_hash").agg(F.count("*").alias("right_copies"))
    zero = F.lit(0)
    both = l.join(r, "row_hash", "full_outer").select(
        "row_hash",
        F.coalesce("left_copies", zero).alias("left_copies"),
        F.coalesce("right_copies", zero).alias("right_copies"),
    )
    return both.where("left_copies <> right_copies")


def leaf_order(df: DataFrame, leaf: str, bucket: Column, order: list) -> DataFrame:
    """H2: ``leaf_index`` of every row in (bucket, order) order.

    ``bucket`` is a coarse step of the order; only one row per bucket is numbered in
    one task, the rest is numbered inside its bucket.
    """
    return positions(df, [], bucket, order, "leaf_index").withColumnRenamed(leaf, "leaf_hash")


def _pad_hash(height: int) -> str:
    """Root of a perfect subtree of pad leaves."""
    h = PAD_LEAF
    for _ in range(height):
        h = hashlib.sha256((h + h).encode()).hexdigest()
    return h


def _fold_blocks(level: DataFrame, bits: int, pad: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of 2^bits consecutive hashes with all their levels ``__l0`` (leaves) to ``__l<bits>`` (root).

    A block is bounded, so folding it inside one row is safe; each level is a column
    of its own and is computed once.
    """
    blocks = (
        level.groupBy(*keys, F.shiftright("idx", bits).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("__s"))
        .select(*keys, "block", F.transform("__s", lambda x: x.getField("hash")).alias("__raw"))
    )
    return _fold_raw(blocks, bits, pad)


def _fold_raw(blocks: DataFrame, bits: int, pad: str) -> DataFrame:
    """Blocks with up to 2^bits hashes in ``__raw``, padded, beside their levels."""
    size = 1 << bits
    padding = F.array_repeat(F.lit(pad), F.lit(size) - F.size("__raw"))
    blocks = blocks.withColumn("__l0", F.concat("__raw", padding)).drop("__raw")
    for k in range(1, bits + 1):
        blocks = blocks.withColumn(f"__l{k}", _parents(F.col(f"__l{k - 1}"), size >> k))
    return blocks


def _parents(below: Column, count: int) -> Column:
    """The ``count`` hashes above a level of twice as many."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.sha2(F.concat(F.get(below, i * 2), F.get(below, i * 2 + 1)), 256),
    )


def _paths(blocks: DataFrame, bits: int) -> DataFrame:
    """(idx, path) of every position of the blocks: siblings from the bottom to the block root."""
    if bits == 0:
        return blocks.select(F.col("block").alias("idx"), F.array().cast("array<string>").alias("path"))

    def sibling(i: Column, k: int) -> Column:
        at = F.shiftright(i, k)
        return F.get(F.col(f"__l{k}"), at.bitwiseXOR(F.lit(1)))

    numbers = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    items = F.transform(
        numbers, lambda i: F.struct(i.alias("i"), F.array(*[sibling(i, k) for k in range(bits)]).alias("path"))
    )
    return blocks.select("block", F.explode(items).alias("x")).select(
        (F.shiftleft("block", bits) + F.col("x.i")).alias("idx"), F.col("x.path").alias("path")
    )


def _depth(n: int) -> int:
    return max(0, (n - 1).bit_length())


def merkle_root(leaves: DataFrame, block_bits: int = 10) -> DataFrame:
    """H2: one row (root, leaf_count, depth) over ``leaves(leaf_index, leaf_hash)``.

    Leaves are padded to a power of two.  Each round folds blocks of 2^block_bits hashes
    in parallel; a billion leaves take three rounds, and only the last is one task.
    """
    leaves = cut_lineage(leaves.select("leaf_index", "leaf_hash"))
    n = leaves.count()
    spark = leaves.sparkSession
    if n == 0:
        return spark.range(1).select(
            F.lit(EMPTY_ROOT).alias("root"), F.lit(0).cast("long").alias("leaf_count"), F.lit(0).alias("depth")
        )
    depth = _depth(n)
    level = leaves.select(F.col("leaf_index").cast("long").alias("idx"), F.col("leaf_hash").alias("hash"))
    height = 0
    while height < depth:
        bits = min(block_bits, depth - height)
        blocks = _fold_blocks(level, bits, _pad_hash(height))
        level = blocks.select(F.col("block").alias("idx"), F.get(f"__l{bits}", F.lit(0)).alias("hash"))
        height += bits
    return level.select(
        F.col("hash").alias("root"), F.lit(n).cast("long").alias("leaf_count"), F.lit(depth).alias("depth")
    )


def inclusion_proofs(leaves: DataFrame, block_bits: int = 10) -> DataFrame:
    """H3: (leaf_index, leaf_hash, path, root) for every leaf; ``path`` holds the siblings from the bottom up.

    The side of a sibling is the bit of the leaf index at its level.  Other columns of ``leaves`` stay beside the proof.
    A block's own path is found first, block by block from the top, and meets the block's leaves before they leave it,
    so no leaf's path is moved.
    """
    more = [c for c in leaves.columns if c not in ("leaf_index", "leaf_hash")]
    base = stored(leaves.select(F.col("leaf_index").cast("long").alias("leaf_index"), "leaf_hash", *more), "leaves")
    depth = _depth(base.count())
    if depth == 0:
        return base.select(
            "leaf_index", "leaf_hash", F.array().cast("array<string>").alias("path"), F.col("leaf_hash").alias("root"), *more
        )
    low = min(block_bits, depth)
    level = base.select(F.col("leaf_index").alias("idx"), F.col("leaf_hash").alias("hash"))
    tops = stored(_fold_blocks(level, low, _pad_hash(0)).select("block", F.get(f"__l{low}", F.lit(0)).alias("hash")), "tops")
    level, rounds, height = tops.select(F.col("block").alias("idx"), "hash"), [], low
    while height < depth:
        bits = min(block_bits, depth - height)
        blocks = stored(_fold_blocks(level, bits, _pad_hash(height)), "blocks")
        rounds.append((bits, _paths(blocks, bits)))
        level = blocks.select(F.col("block").alias("idx"), F.get(f"__l{bits}", F.lit(0)).alias("hash"))
        height += bits
    root = level.select("hash").scalar()
    above = level.select("idx", F.array().cast("array<string>").alias("path"))
    for bits, paths in reversed(rounds):
        higher = above.select(F.col("idx").alias("__b"), F.col("path").alias("__p"))
        above = (
            paths.join(higher, F.shiftright("idx", bits) == F.col("__b"))
            .select("idx", F.concat("path", "__p").alias("path"))
        )
    kept = F.struct(F.col("leaf_index").alias("idx"), F.col("leaf_hash").alias("hash"), *more)
    held = base.groupBy(F.shiftright("leaf_index", low).alias("block")).agg(F.array_sort(F.collect_list(kept)).alias("__leaves"))
    blocks = _fold_raw(held.withColumn("__raw", F.transform("__leaves", lambda x: x.getField("hash"))), low, _pad_hash(0))
    blocks = blocks.join(above.select(F.col("idx").alias("block"), F.col("path").alias("__up")), "block")
    each = blocks.select(*[f"__l{k}" for k in range(low)], "__up", F.posexplode("__leaves").alias("__i", "x"))
    own = F.array(*[F.get(f"__l{k}", F.shiftright("__i", k).bitwiseXOR(F.lit(1))) for k in range(low)])
    return each.select(
        F.col("x.idx").alias("leaf_index"), F.col("x.hash").alias("leaf_hash"), F.concat(own, "__up").alias("path"),
        root.alias("root"), *[F.col("x").getField(c).alias(c) for c in more],
    )


def verify_proofs(proofs: DataFrame) -> DataFrame:
    """H3: fold every path and compare with the root the receipt names."""
    steps = F.zip_with(
        "path", F.sequence(F.lit(0), F.size("path") - 1), lambda s, k: F.struct(s.alias("s"), k.alias("k"))
    )
    held = proofs.withColumn(
        "__steps",
        F.when(F.size("path") > 0, steps).otherwise(F.array().cast("array<struct<s:string,k:int>>")),
    ).withColumn(
        "__sided",
        F.transform(
            "__steps",
            lambda x: F.struct(
                x.getField("s").alias("s"),
                F.pmod(F.floor(F.col("leaf_index") / F.pow(F.lit(2.0), x.getField("k"))), F.lit(2)).alias("right"),
            ),
        ),
    )
    folded = F.aggregate(
        "__sided",
        F.col("leaf_hash"),
        lambda acc, x: F.when(x.getField("right") == 1, F.sha2(F.concat(x.getField("s"), acc), 256)).otherwise(
            F.sha2(F.concat(acc, x.getField("s")), 256)
        ),
    )
    return held.withColumn("valid", folded == F.col("root")).drop("__steps", "__sided")


def receipts(leaves: DataFrame, root: DataFrame, key: bytes) -> DataFrame:
    """H4: receipt id, root and signature of every committed leaf.

    ``root`` is the one-row result of ``merkle_root``.
    """
    rid = F.substring(F.sha2(F.concat_ws(":", "leaf_hash", F.col("leaf_index").cast("string")), 256), 1, 16)
    return (
        leaves.withColumn("receipt_id", rid)
        .withColumn("merkle_root", root.select("root").scalar())
        .withColumn("signature", hmac_sha256(key, F.concat_ws(":", "receipt_id", "leaf_hash", "merkle_root")))
    )


def member_roots(members: DataFrame, keys: list[str], block_bits: int = 10) -> DataFrame:
    """(*keys, member_count, member_root): the Merkle root of each group's hashes, in hash order.

    Numbering goes by the first digits of the hash and folding by blocks, so a large group
    is spread; a group is done at its own depth, padded as ``merkle_root`` pads.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("member_count"))
    depth = F.when(F.col("member_count") > 1, F.length(F.bin(F.col("member_count") - 1))).otherwise(0)
    sizes = cut_lineage(sizes.withColumn("__depth", depth))
    deepest = sizes.agg(F.max("__depth")).first()[0] or 0
    numbered = positions(members.select(*keys, "leaf_hash"), keys, F.substring("leaf_hash", 1, 3), ["leaf_hash"], "idx")
    level = numbered.join(sizes.drop("member_count"), keys).withColumnRenamed("leaf_hash", "hash")
    height, done = 0, level.where("__depth = 0").select(*keys, F.col("hash").alias("member_root"))
    while height < deepest:
        bits = min(block_bits, deepest - height)
        level = level.where(F.col("__depth") > height)
        tops = _fold_blocks(level, bits, _pad_hash(height), (*keys, "__depth"))
        reached = F.least(F.col("__depth") - height, F.lit(bits))
        top = F.get(F.array(*[F.get(f"__l{k}", F.lit(0)) for k in range(1, bits + 1)]), reached - 1)
        height += bits
        level = tops.select(*keys, "__depth", F.col("block").alias("idx"), top.alias("hash"))
        done = done.unionByName(level.where(F.col("__depth") <= height).select(*keys, F.col("hash").alias("member_root")))
    return sizes.drop("__depth").join(done, keys)


def aggregate_proofs(
    aggregates: DataFrame, members: DataFrame, root: DataFrame, keys: list[str], value_columns: list[str], key: bytes
) -> DataFrame:
    """H5: each aggregate with its root, signature and the checks on them.

    ``members(*keys, leaf_hash)`` stays a table of its own: the member hashes of one
    aggregate may be a third of all rows, so the proof carries their number and the Merkle
    root over them in hash order, against which any member list can be checked.
    """
    counted = member_roots(members, keys)
    body = F.to_json(F.struct(*[F.col(c) for c in [*keys, "contributor_count", "merkle_root", *sorted(value_columns)]]))
    out = (
        aggregates.join(counted, keys, "left")
        .withColumn("merkle_root", root.select("root").scalar())
        .withColumn("signature", hmac_sha256(key, body))
    )
    return verify_aggregate_proofs(out)


def verify_aggregate_proofs(proofs: DataFrame, expected_root: str | None = None) -> DataFrame:
    """H5: member count, root and signature checks of every proof."""
    rooted = F.coalesce(F.length("merkle_root") == 64, F.lit(False))
    if expected_root is not None:
        rooted = rooted & (F.col("merkle_root") == expected_root)
    counted = F.coalesce(F.col("member_count") == F.col("contributor_count"), F.lit(False))
    signed = F.coalesce(F.length("signature") == 64, F.lit(False))
    return proofs.withColumns(
        {
            "commitment_count_matches": counted,
            "merkle_root_present": rooted,
            "signature_present": signed,
            "valid": counted & rooted & signed,
        }
    )


def chain_lineage(records: DataFrame, secret: bytes) -> DataFrame:
    """H6: link hashes of a record through its stages.

    ``records(file_hash, stages array<struct<stage_id, input_hash, output_hash, evidence>>)``;
    the root is HMAC(secret, file hash), every link HMAC(previous link, stage as JSON).
    ``links`` starts with the root.
    """
    start = F.array(hmac_sha256(secret, F.col("file_hash")))

    def link(acc: Column, stage: Column) -> Column:
        return F.concat(acc, F.array(hmac_column_key(F.element_at(acc, -1), F.to_json(stage))))

    return records.withColumn("links", once(F.col("stages"), lambda stages: F.aggregate(stages, start, link)))


def verify_lineage(records: DataFrame) -> DataFrame:
    """H6: every link follows from the one before, and each stage takes in what the last gave out."""

    def check(r: Column) -> Column:
        stages, links = r.getField("stages"), r.getField("links")
        n = F.size(stages)
        nothing = F.array().cast("array<int>")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(nothing)
        derived = F.forall(
            steps, lambda i: hmac_column_key(F.get(links, i), F.to_json(F.get(stages, i))) == F.get(links, i + 1)
        )
        inner = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(nothing)
        continuous = F.forall(
            inner,
            lambda i: F.get(stages, i).getField("input_hash") == F.get(stages, i - 1).getField("output_hash"),
        )
        return F.struct(
            (derived & (F.size(links) == n + 1)).alias("chain_intact"), continuous.alias("continuous")
        )

    # One lambda over both lists: a filter on the outcome must not evaluate them again for every step.
    checked = records.withColumn("__c", once(F.struct("stages", "links"), check))
    return checked.withColumns(
        {
            "chain_intact": F.col("__c.chain_intact"),
            "continuous": F.col("__c.continuous"),
            "valid": F.col("__c.chain_intact") & F.col("__c.continuous"),
        }
    ).drop("__c")


def stage_evidence(before: DataFrame, after: DataFrame, key: list[str], text: list[str], numeric: list[str]) -> DataFrame:
    """H7: per record the fields present before, the text fields changed, and whether the numbers stayed."""
    b = before.select(*key, *[F.col(c).alias(f"__b_{c}") for c in [*text, *numeric]])
    joined = b.join(after, key)
    present = F.array_compact(
        F.array(*[F.when(F.col(f"__b_{c}").isNotNull(), F.lit(c)) for c in [*numeric, *text]])
    )
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"__b_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in text])
    )
    same = F.lit(True)
    for c in numeric:
        same = same & (F.col(f"__b_{c}").isNull() | F.col(f"__b_{c}").eqNullSafe(F.col(c)))
    return joined.select(
        *key, present.alias("fields_present"), changed.alias("fields_modified"), same.alias("numeric_unchanged")
    )


def hashing_evidence(iocs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """H7: every indicator hashed, no raw value left."""
    raw = F.col("value_raw").isNull() if "value_raw" in iocs.columns else F.lit(True)
    return iocs.groupBy(*by).agg(
        F.count("*").alias("ioc_count"),
        F.bool_and(F.coalesce(F.length("value_hash") == 64, F.lit(False))).alias("all_hashed"),
        F.bool_and(raw).alias("all_raw_stripped"),
    )


def commit_fields(df: DataFrame, fields: list[str], salt_prefix: str = "salt_") -> DataFrame:
    """H8: salted commitment of each field and the hash that binds them.

    ``salt_<field>`` columns hold hex randomness; a commitment is
    SHA-256("field:value" + salt bytes).
    """
    cols = {
        f"commit_{f}": F.sha2(
            F.concat(
                F.encode(F.concat(F.lit(f"{f}:"), F.col(f).cast("string")), "UTF-8"), F.unhex(f"{salt_prefix}{f}")
            ),
            256,
        )
        for f in fields
    }
    joined = F.concat_ws("|", *[F.concat(F.lit(f"{f}:"), F.col(f"commit_{f}")) for f in sorted(fields)])
    return df.withColumns(cols).withColumn("batch_hash", F.sha2(joined, 256))


def verify_commitments(opened: DataFrame, fields: list[str], salt_prefix: str = "salt_") -> DataFrame:
    """H8: recompute every commitment and the batch hash of opened rows."""
    fresh = commit_fields(
        opened.withColumnsRenamed({f"commit_{f}": f"__c_{f}" for f in fields} | {"batch_hash": "__batch"}),
        fields,
        salt_prefix,
    )
    good = F.col("__batch") == F.col("batch_hash")
    for f in fields:
        good = good & (F.col(f"__c_{f}") == F.col(f"commit_{f}"))
    return fresh.withColumn("valid", good).drop("__batch", *[f"__c_{f}" for f in fields])


def attest_table(stats: DataFrame, root: DataFrame, key: bytes) -> DataFrame:
    """H9: contributions, distinct organisations and mean credibility (5-95) bound to the root by a signature.

    ``stats`` has one row (n, orgs, credibility), ``root`` is the result of ``merkle_root``.
    """
    score = F.least(F.lit(95), F.greatest(F.lit(5), F.bround(F.col("credibility") * 100, 0).cast("int")))
    out = (
        stats.withColumn("credibility_score", score)
        .withColumn("merkle_root", root.select("root").scalar())
        .withColumn("leaf_count", root.select("leaf_count").scalar())
    )
    message = F.concat_ws(
        "|",
        "merkle_root",
        F.col("leaf_count").cast("string"),
        F.col("n").cast("string"),
        F.col("orgs").cast("string"),
        F.col("credibility_score").cast("string"),
    )
    return out.select(
        "n",
        "orgs",
        "credibility_score",
        "merkle_root",
        "leaf_count",
        (F.col("leaf_count") == F.col("n")).alias("counts_agree"),
        hmac_sha256(key, message).alias("signature"),
    )
