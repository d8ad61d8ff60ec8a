"""Attack technique frequency, detection matrices, coverage and remediation.

The working shape is long: one row per technique entry and tool, with
``outcome`` 'detected' / 'missed' / null.  ``observations`` makes it from nested
attack maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(col: Column | str) -> Column:
    """Lower case, spaces to dashes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def observations(attack_maps: DataFrame) -> DataFrame:
    """Explode nested attack maps to (contribution, technique, tool, outcome) rows."""
    entry = attack_maps.select("contribution_id", F.explode("techniques").alias("t"))
    tools = F.concat(
        F.transform(F.coalesce("t.detected_by", F.array()), lambda v: F.struct(v.alias("tool"), F.lit("detected").alias("outcome"))),
        F.transform(F.coalesce("t.missed_by", F.array()), lambda v: F.struct(v.alias("tool"), F.lit("missed").alias("outcome"))),
    )
    return entry.where("t.technique_id != ''").select(
        "contribution_id",
        F.col("t.technique_id").alias("technique_id"),
        F.coalesce("t.observed", F.lit(True)).alias("observed"),
        F.explode_outer(tools).alias("x"),
    ).select("contribution_id", "technique_id", "observed", "x.tool", "x.outcome")


def technique_lookup(rows: DataFrame, technique_map: DataFrame, columns: list[str]) -> DataFrame:
    """Attach map columns by exact id, else by the id before the dot."""
    exact = technique_map.select(F.col("technique_id").alias("__e"), *[F.col(c).alias(f"__e_{c}") for c in columns])
    parent = technique_map.select(F.col("technique_id").alias("__p"), *[F.col(c).alias(f"__p_{c}") for c in columns])
    out = rows.join(exact, F.col("technique_id") == F.col("__e"), "left").join(
        parent, F.col("__e").isNull() & (F.substring_index("technique_id", ".", 1) == F.col("__p")), "left"
    )
    keep = [rows[c] for c in rows.columns if c not in columns]
    return out.select(
        *keep,
        *[F.coalesce(f"__e_{c}", f"__p_{c}").alias(c) for c in columns],
        F.coalesce("__e", "__p").alias("matched_id"),
    )


def technique_frequency(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """A10: observed entries per technique, and their share of the attack maps."""
    maps = entries.agg(F.count_distinct("contribution_id")).scalar()
    out = (
        entries.where("observed AND technique_id != ''")
        .groupBy("technique_id")
        .agg(F.count("*").alias("count"))
        .withColumn("pct", 100.0 * F.col("count") / F.greatest(maps, F.lit(1)))
    )
    return out if limit is None else out.orderBy(F.col("count").desc(), "technique_id").limit(limit)


def technique_frequency_named(entries: DataFrame, technique_map: DataFrame) -> DataFrame:
    """All entries per technique as a share of technique *rows*; tactic of the earliest entry, else of the map."""
    total = entries.agg(F.count("*")).scalar()
    first = F.min(F.when(F.col("tactic").isNotNull(), F.struct("ts", "tactic")))
    freq = (
        entries.where("technique_id != ''")
        .groupBy("technique_id")
        .agg(F.count("*").alias("count"), first.getField("tactic").alias("seen_tactic"))
        .withColumn("pct", 100.0 * F.col("count") / F.greatest(total, F.lit(1)))
    )
    named = technique_lookup(freq, technique_map, ["name", "tactic"])
    return named.select(
        "technique_id",
        "count",
        "pct",
        F.coalesce("name", "technique_id").alias("name"),
        F.coalesce("seen_tactic", "tactic", F.lit("unknown")).alias("tactic"),
    )


def detection_matrix(obs: DataFrame, tool: Column | None = None) -> DataFrame:
    """Detected and missed counts per technique and tool."""
    name = slug("tool") if tool is None else tool
    return (
        obs.where("outcome IS NOT NULL AND technique_id != ''")
        .groupBy("technique_id", name.alias("vendor"))
        .agg(
            F.count(F.when(F.col("outcome") == "detected", 1)).alias("detected"),
            F.count(F.when(F.col("outcome") == "missed", 1)).alias("missed"),
        )
    )


def detection_rates(matrix: DataFrame) -> DataFrame:
    """Rate per (vendor, technique) and, with a null technique, per vendor."""
    v, t = F.col("vendor"), F.col("technique_id")
    out = matrix.groupingSets([[v, t], [v]], v, t).agg(
        F.sum("detected").alias("detected"),
        F.sum(F.col("detected") + F.col("missed")).alias("evaluated"),
        F.grouping("technique_id").alias("__all"),
    )
    return out.select(
        "vendor",
        F.when(F.col("__all") == 0, F.col("technique_id")).alias("technique_id"),
        "detected",
        "evaluated",
        F.when(F.col("evaluated") > 0, F.col("detected") / F.col("evaluated")).otherwise(0.0).alias("rate"),
    )


def compare_detection(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overall rates of two vendors side by side, for every pair asked for."""
    overall = matrix.groupBy("vendor").agg(
        F.sum("detected").alias("detected"), F.sum(F.col("detected") + F.col("missed")).alias("evaluated")
    )
    a = overall.select(F.col("vendor").alias("vendor_a"), (F.col("detected") / F.col("evaluated")).alias("rate_a"))
    b = overall.select(F.col("vendor").alias("vendor_b"), (F.col("detected") / F.col("evaluated")).alias("rate_b"))
    return pairs.join(a, "vendor_a", "left").join(b, "vendor_b", "left")


def vendor_gaps(matrix: DataFrame) -> DataFrame:
    """Techniques a vendor missed at least once."""
    return matrix.where("missed > 0").select("vendor", "technique_id")


def missed_by_tools(entries: DataFrame, tools: list[str]) -> DataFrame:
    """Nested technique entries that any of ``tools`` missed, whatever the case."""
    wanted = F.array(*[F.lit(t.lower()) for t in tools])
    return entries.where(F.exists("missed_by", lambda m: F.array_contains(wanted, F.lower(m))))


def missed_by_stack(stacks: DataFrame, obs: DataFrame) -> DataFrame:
    """J3 for every stack: techniques its tools missed at *other* organisations.

    Misses are counted per (tool, technique) first and the own ones subtracted, so a
    widely used tool never multiplies its raw rows with its users.
    """
    missed = obs.where("outcome = 'missed'").select("org", F.lower("tool").alias("tool"), "technique_id")
    own = missed.groupBy("org", "tool", "technique_id").agg(F.count("*").alias("own"))
    everyone = own.groupBy("tool", "technique_id").agg(F.sum("own").alias("seen"))
    s = stacks.select("stack_id", F.lower("tool").alias("tool"))
    mine = own.withColumnRenamed("org", "stack_id")
    return (
        s.join(everyone, "tool")
        .join(mine, ["stack_id", "tool", "technique_id"], "left")
        .withColumn("missed", F.col("seen") - F.coalesce("own", F.lit(0)))
        .where("missed > 0")
        .groupBy("stack_id", "technique_id")
        .agg(F.sum("missed").alias("missed"), F.count("*").alias("tools_missing"))
    )


def stack_coverage(stacks: DataFrame, matrix: DataFrame, frequency: DataFrame) -> DataFrame:
    """A14 per stack: techniques covered, observed gaps, share of all known techniques.

    Gaps come from observed techniques only, so covered + gaps can stay below the total.
    What a tool covers travels as bit words, so a stack meets a few rows per tool.
    """
    known = matrix.select("technique_id").union(frequency.select("technique_id")).distinct()
    ids = known.agg(F.sort_array(F.collect_set("technique_id"))).scalar()
    observed = frequency.agg(F.count("*")).scalar()
    tool_words = _technique_words(matrix.where("detected > 0"), ids, ["vendor"])
    seen = _technique_words(frequency, ids, []).select("word", F.col("bits").alias("__seen"))
    per_stack = (
        stacks.select("stack_id", slug("tool").alias("vendor"))
        .join(tool_words, "vendor")
        .groupBy("stack_id", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .join(seen, "word", "left")
        .groupBy("stack_id")
        .agg(
            F.sum(F.bit_count("bits")).alias("covered"),
            F.sum(F.bit_count(F.col("bits").bitwiseAND(F.coalesce("__seen", F.lit(0).cast("long"))))).alias(
                "covered_observed"
            ),
        )
    )
    total = F.size(ids).cast("long")
    return (
        stacks.select("stack_id")
        .distinct()
        .join(per_stack, "stack_id", "left")
        .select(
            "stack_id",
            total.alias("total_techniques"),
            F.coalesce("covered", F.lit(0)).alias("covered"),
            (observed - F.coalesce("covered_observed", F.lit(0))).alias("gaps"),
            (100.0 * F.coalesce("covered", F.lit(0)) / F.greatest(total, F.lit(1))).alias("coverage_pct"),
        )
    )


def _technique_words(rows: DataFrame, ids: Column, by: list[str]) -> DataFrame:
    """Sets of techniques as 63-bit words: a few rows per group instead of one per technique.

    A bit is the place of the technique in the sorted dictionary ``ids``.
    """
    placed = rows.select(*by, (F.array_position(ids, F.col("technique_id")) - 1).alias("__at"))
    return (
        placed.withColumn("word", F.floor(F.col("__at") / 63))
        .groupBy(*by, "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 63 as int))")).alias("bits"))
    )


def _covered(stacks: DataFrame, matrix: DataFrame) -> DataFrame:
    s = stacks.select("stack_id", slug("tool").alias("vendor"))
    return s.join(matrix.where("detected > 0").select("vendor", "technique_id"), "vendor").select(
        "stack_id", "technique_id"
    ).distinct()


def stack_gaps(stacks: DataFrame, matrix: DataFrame, frequency: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` most frequent observed techniques a stack lacks, with the tools that catch them.

    None of the stack's own tools can be among those, or the technique were covered.  Arrays hold technique or tool names of one dictionary each, so their length is
    bounded by that dictionary, not by the data.
    """
    ranked = frequency.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "technique_id"))),
            lambda x: x.getField("technique_id"),
        )
    ).scalar()
    covered = _covered(stacks, matrix).groupBy("stack_id").agg(F.collect_set("technique_id").alias("__cov"))
    catchers = (
        matrix.where("detected > 0").groupBy("technique_id").agg(F.sort_array(F.collect_set("vendor")).alias("__by"))
    )
    base = stacks.select("stack_id").distinct().join(covered, "stack_id", "left")
    missing = F.slice(F.array_except(ranked, F.coalesce("__cov", F.array().cast("array<string>"))), 1, top)
    gaps = base.select("stack_id", F.posexplode(missing).alias("pos", "technique_id"))
    return (
        gaps.join(frequency.select("technique_id", F.col("count").alias("frequency")), "technique_id")
        .join(catchers, "technique_id", "left")
        .select(
            "stack_id",
            (F.col("pos") + 1).alias("gap_rank"),
            "technique_id",
            "frequency",
            F.coalesce("__by", F.array().cast("array<string>")).alias("caught_by"),
        )
    )


def tool_effectiveness(obs: DataFrame, registry: DataFrame) -> DataFrame:
    """Detections, misses, share, the techniques missed, and the usual detection time of the tool kind."""
    matrix = detection_matrix(obs, F.lower("tool"))
    per_tool = matrix.groupBy("vendor").agg(
        F.sum("detected").alias("detections"),
        F.sum("missed").alias("misses"),
        F.sort_array(F.collect_set(F.when(F.col("missed") > 0, F.col("technique_id")))).alias("missed_techniques"),
    )
    kinds = registry.select(F.lower("vendor_id").alias("__k"), "kind")
    time_class = (
        F.when(F.col("kind").isin("edr", "ndr"), "minutes-hours")
        .when(F.col("kind").isin("iam", "email"), "immediate")
        .otherwise("hours")
    )
    return per_tool.join(kinds, F.col("vendor") == F.col("__k"), "left").select(
        F.col("vendor").alias("tool"),
        "detections",
        "misses",
        (F.col("detections") + F.col("misses")).alias("total_observations"),
        (100.0 * F.col("detections") / (F.col("detections") + F.col("misses"))).alias("detection_pct"),
        "missed_techniques",
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        time_class.alias("avg_detect_time"),
    )


def remediation_histogram(remediation: DataFrame) -> DataFrame:
    """Actions by category and effectiveness, with subtotals (null = all)."""
    return (
        remediation.cube("category", "effectiveness")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
        .select("category", "effectiveness", "n", F.col("level").cast("int").alias("level"))
    )


def remediation_success(remediation: DataFrame, guidance: DataFrame, top: int = 5) -> DataFrame:
    """(stopped + slowed) / total by category, best first, with the framework phase."""
    helped = F.col("effectiveness").isin("stopped_attack", "slowed_attack")
    rates = remediation.groupBy("category").agg(
        F.count("*").alias("total_actions"),
        F.count(F.when(F.col("effectiveness") == "stopped_attack", 1)).alias("stopped"),
        (F.count(F.when(helped, 1)) / F.count("*")).alias("success_rate"),
    )
    return (
        rates.orderBy(F.col("success_rate").desc(), "category").limit(top).join(guidance, "category", "left")
    )


def remediation_for_threat(
    incidents: DataFrame,
    entries: DataFrame,
    remediation: DataFrame,
    threat_name: str | None = None,
    technique_ids: list[str] | None = None,
) -> DataFrame:
    """Actions of incidents whose threat name contains the text or that share a technique; no argument = all."""
    chosen = incidents
    if threat_name or technique_ids:
        cond = F.lit(False)
        if threat_name:
            cond = cond | F.coalesce(F.lower("threat_name").contains(threat_name.lower()), F.lit(False))
        if technique_ids:
            hit = (
                entries.where(F.col("technique_id").isin(technique_ids))
                .select("contribution_id")
                .distinct()
                .withColumn("__hit", F.lit(True))
            )
            chosen = chosen.join(hit, "contribution_id", "left")
            cond = cond | F.coalesce("__hit", F.lit(False))
        chosen = chosen.where(cond).drop("__hit")
    return chosen.join(remediation, "contribution_id")


def remediation_insights(
    incidents: DataFrame, remediation: DataFrame, baselines: DataFrame, by: str = "vertical", top: int = 6
) -> DataFrame:
    """A18 per vertical: the first distinct effective actions, ransom share (baseline below 3 incidents)."""
    per = incidents.groupBy(by).agg(
        F.count("*").alias("incidents_analyzed"), F.count(F.when(F.col("ransom_paid"), 1)).alias("__paid")
    )
    effective = (
        remediation.where(F.col("effectiveness").isin("stopped_attack", "slowed_attack"))
        .join(incidents.select("contribution_id", by), "contribution_id")
        .groupBy(by, "action")
        .agg(F.min("ts").alias("__first"))
    )
    order = Window.partitionBy(by).orderBy("__first", "action")
    first = (
        effective.withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= top)
        .groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("__r", "action"))).alias("__acts"))
        .select(by, F.transform("__acts", lambda x: x.getField("action")).alias("most_effective"))
    )
    base = baselines.select(
        F.col("vertical").alias(by), "ransom_paid_pct", "avg_recovery_weeks", "data_exfiltrated_pct"
    )
    return (
        per.join(base, by, "left")
        .join(first, by, "left")
        .select(
            by,
            "incidents_analyzed",
            F.when(F.col("incidents_analyzed") >= 3, 100.0 * F.col("__paid") / F.col("incidents_analyzed"))
            .otherwise(F.coalesce("ransom_paid_pct", F.lit(12.0)))
            .alias("ransom_paid_pct"),
            F.coalesce("avg_recovery_weeks", F.lit(2.1)).alias("avg_recovery_weeks"),
            F.coalesce("data_exfiltrated_pct", F.lit(67.0)).alias("data_exfiltrated_pct"),
            "most_effective",
        )
    )


def initial_access_mix(entries: DataFrame, baselines: DataFrame, by: str = "vertical") -> DataFrame:
    """Entry routes among initial-access techniques; baseline shares below 5 of them."""
    t = F.col("technique_id")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    counts = (
        entries.where("tactic = 'initial-access'")
        .groupBy(by)
        .agg(
            F.count("*").alias("total_ia"),
            n(t.startswith("T1566")).alias("spearphishing"),
            n(t == "T1190").alias("vpn_exploit"),
            n(t.isin("T1133", "T1021.001")).alias("rdp_exposed"),
            n(t.startswith("T1195")).alias("supply_chain"),
            n(t.startswith("T1078")).alias("valid_accounts"),
        )
    )
    base = baselines.select(F.col("vertical").alias(by), "spearphishing_pct", "vpn_exploit_pct", "rdp_exposed_pct")
    joined = base.join(counts, by, "full_outer")
    total = F.coalesce("total_ia", F.lit(0))
    enough = total >= 5

    def share(count: str, fallback: Column) -> Column:
        return F.when(enough, 100.0 * F.col(count) / total).otherwise(fallback)

    return joined.select(
        by,
        total.alias("total_ia"),
        share("spearphishing", F.coalesce("spearphishing_pct", F.lit(80.0))).alias("spearphishing_pct"),
        share("vpn_exploit", F.coalesce("vpn_exploit_pct", F.lit(20.0))).alias("vpn_exploit_pct"),
        share("rdp_exposed", F.coalesce("rdp_exposed_pct", F.lit(10.0))).alias("rdp_exposed_pct"),
        F.when(
            (F.coalesce("supply_chain", F.lit(0)) > 0) | (F.col(by) == "government"), share("supply_chain", F.lit(23.0))
        ).alias("supply_chain_pct"),
        F.when(
            (F.coalesce("valid_accounts", F.lit(0)) > 0) | (F.col(by) == "financial"),
            share("valid_accounts", F.lit(34.0)),
        ).alias("valid_accounts_pct"),
    )


def chain_coverage(chain_steps: DataFrame, entries: DataFrame, by: str = "vertical") -> DataFrame:
    """Share of the steps of each attack chain seen in the data of its vertical."""
    seen = entries.select(by, "technique_id").distinct().withColumn("__seen", F.lit(1))
    return (
        chain_steps.join(seen, [by, "technique_id"], "left")
        .groupBy(by, "chain")
        .agg(
            F.count("*").alias("steps"),
            F.count("__seen").alias("observed_steps"),
            (100.0 * F.count("__seen") / F.count("*")).alias("data_coverage_pct"),
        )
    )


def minimum_stack(priority: DataFrame, technique_map: DataFrame, goal: float = 0.8) -> DataFrame:
    """Tool kinds in order of techniques covered, taken until ``goal`` of the priority techniques is covered.

    A technique counts for the first kind of the order that has it, so the running
    sum of first-covered techniques is what the kinds taken so far cover together.
    """
    total = priority.groupBy("vertical").agg(F.count_distinct("technique_id").alias("total_priority"))
    kinds = (
        technique_lookup(priority.select("vertical", "technique_id").distinct(), technique_map, ["categories"])
        .select("vertical", "technique_id", F.explode("categories").alias("kind"))
        .distinct()
    )
    sizes = kinds.groupBy("vertical", "kind").agg(F.count("*").alias("techniques"))
    order = Window.partitionBy("vertical").orderBy(F.col("techniques").desc(), "kind")
    ranked = sizes.withColumn("take_order", F.row_number().over(order))
    first = (
        kinds.join(ranked, ["vertical", "kind"])
        .groupBy("vertical", "technique_id")
        .agg(F.min("take_order").alias("take_order"))
        .groupBy("vertical", "take_order")
        .agg(F.count("*").alias("newly"))
    )
    upto = Window.partitionBy("vertical").orderBy("take_order").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.join(first, ["vertical", "take_order"], "left")
        .join(total, "vertical")
        .withColumn("newly", F.coalesce("newly", F.lit(0)))
        .withColumn("covered", F.sum("newly").over(upto))
        .where((F.col("covered") - F.col("newly")) / F.col("total_priority") < goal)
        .select(
            "vertical",
            "take_order",
            "kind",
            "techniques",
            "covered",
            (100.0 * F.col("covered") / F.col("total_priority")).alias("covered_pct"),
        )
    )


def best_tools_per_kind(effectiveness: DataFrame, top: int = 3) -> DataFrame:
    """Strongest tools of each kind."""
    order = Window.partitionBy("kind").orderBy(F.col("detection_pct").desc(), "tool")
    return (
        effectiveness.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .select("kind", "place", "tool", "detection_pct")
    )


def attack_patterns(
    entries: DataFrame,
    obs: DataFrame,
    incidents: DataFrame,
    remediation: DataFrame,
    registry: DataFrame,
    technique_map: DataFrame,
    baselines: DataFrame,
    chain_steps: DataFrame,
    priority: DataFrame,
    top: int = 15,
) -> DataFrame:
    """One row per vertical that brings A11, A15, A18, A19, A20 and A21 together."""
    effect = tool_effectiveness(obs, registry)
    best = (
        best_tools_per_kind(effect)
        .groupBy("kind")
        .agg(F.sort_array(F.collect_list(F.struct("place", "tool"))).alias("t"))
        .select("kind", F.transform("t", lambda x: x.getField("tool")).alias("top_tools"))
    )
    stack = (
        minimum_stack(priority, technique_map)
        .join(best, "kind", "left")
        .groupBy("vertical")
        .agg(
            F.max("covered_pct").alias("stack_coverage_pct"),
            F.sort_array(F.collect_list(F.struct("take_order", "kind", "top_tools"))).alias("minimum_stack"),
        )
    )
    freq = entries.groupBy("vertical", "technique_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("vertical").orderBy(F.col("n").desc(), "technique_id")
    common = (
        technique_lookup(
            freq.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top), technique_map, ["name"]
        )
        .groupBy("vertical")
        .agg(F.sort_array(F.collect_list(F.struct("place", "technique_id", "name", "n"))).alias("top_techniques"))
    )
    chains = (
        chain_coverage(chain_steps, entries)
        .groupBy("vertical")
        .agg(F.sort_array(F.collect_list(F.struct("chain", "data_coverage_pct"))).alias("chains"))
    )
    access = initial_access_mix(entries, baselines)
    fixes = remediation_insights(incidents, remediation, baselines)
    return (
        access.join(chains, "vertical", "left")
        .join(common, "vertical", "left")
        .join(fixes, "vertical", "left")
        .join(stack, "vertical", "left")
    )


def histogram_positions(
    obs: DataFrame, techniques: DataFrame, vendors: DataFrame, n_vendors: int | None = None
) -> DataFrame:
    """(contribution, position) of the binary detection vector, each position once per contribution.

    ``techniques(technique_id, t_idx)`` and ``vendors(vendor, v_idx)`` fix the positions
    ``t_idx * n_vendors * 2 + v_idx * 2 + detected``; unknown names are left out.
    """
    width = F.lit(n_vendors) if n_vendors else vendors.agg(F.count("*")).scalar()
    tagged = obs.where("outcome IS NOT NULL").select(
        "contribution_id", "technique_id", slug("tool").alias("vendor"), (F.col("outcome") == "detected").alias("hit")
    )
    return (
        tagged.join(techniques, "technique_id")
        .join(vendors, "vendor")
        .select(
            "contribution_id",
            (F.col("t_idx") * width * 2 + F.col("v_idx") * 2 + F.col("hit").cast("int")).cast("long").alias("position"),
        )
        .distinct()
    )


def histogram_decode(sums: DataFrame, techniques: DataFrame, vendors: DataFrame) -> DataFrame:
    """Summed positions back to (technique, vendor, detected, missed)."""
    width = vendors.agg(F.count("*")).scalar() * 2
    parts = sums.select(
        F.floor(F.col("position") / width).alias("t_idx"),
        F.floor(F.pmod("position", width) / 2).alias("v_idx"),
        F.pmod("position", F.lit(2)).alias("hit"),
        "n",
    )
    return (
        parts.join(techniques, "t_idx")
        .join(vendors, "v_idx")
        .groupBy("technique_id", "vendor")
        .agg(
            F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("detected"),
            F.sum(F.when(F.col("hit") == 0, F.col("n")).otherwise(0)).alias("missed"),
        )
    )


def histogram_sum(positions: DataFrame) -> DataFrame:
    return positions.groupBy("position").agg(F.count("*").alias("n"))


def market_gap(
    stacks: DataFrame, org_vertical: DataFrame, priority: DataFrame, technique_map: DataFrame, most: int | None = None
) -> DataFrame:
    """Every priority technique of a stack's vertical with the tools that cover it, or what to buy instead.

    ``most`` cuts the suggested vendors, which are those that the stack lacks.
    """
    looked = technique_lookup(priority, technique_map, ["tactic", "categories", "primary_vendors"])
    owned = stacks.groupBy("stack_id").agg(F.collect_set(slug("tool")).alias("__tools"))
    wanted = F.transform(F.coalesce("primary_vendors", F.array().cast("array<string>")), lambda v: F.lower(v))
    missing = F.array_except(wanted, "__tools")
    rank = F.col("rank")
    need = (
        owned.join(org_vertical.withColumnRenamed("org", "stack_id"), "stack_id")
        .join(looked, "vertical")
        .withColumn("covering_tools", F.sort_array(F.array_intersect(wanted, "__tools")))
        .withColumn("covered", F.size("covering_tools") > 0)
    )
    return need.select(
        "stack_id",
        "vertical",
        "rank",
        "technique_id",
        "covered",
        "covering_tools",
        F.when(~F.col("covered"), F.coalesce("categories", F.array().cast("array<string>"))).alias(
            "suggested_categories"
        ),
        F.when(~F.col("covered"), missing if most is None else F.slice(missing, 1, most)).alias("suggested_vendors"),
        F.when(~F.col("covered"), F.when(rank < 2, "critical").when(rank < 5, "high").otherwise("medium")).alias(
            "priority"
        ),
    )


def market_gap_score(gap_rows: DataFrame) -> DataFrame:
    """Covered share and recommendation counts of each stack."""
    return gap_rows.groupBy("stack_id", "vertical").agg(
        F.count("*").alias("techniques"),
        F.count(F.when(F.col("covered"), 1)).alias("covered"),
        (F.count(F.when(F.col("covered"), 1)) / F.count("*")).alias("coverage_score"),
        F.count(F.when(F.col("priority") == "critical", 1)).alias("critical"),
        F.count(F.when(F.col("priority") == "high", 1)).alias("high"),
        F.count(F.when(F.col("priority") == "medium", 1)).alias("medium"),
    )


def stack_compliance(
    stacks: DataFrame, org_vertical: DataFrame, frameworks: DataFrame, registry: DataFrame
) -> DataFrame:
    """Frameworks of the stack's vertical and how many of its tools carry them."""
    carried = registry.select(F.col("vendor_id").alias("tool"), F.explode("compliance_frameworks").alias("framework"))
    have = stacks.join(carried, "tool").groupBy("stack_id", "framework").agg(F.count("*").alias("tools"))
    ids = stacks.select("stack_id").distinct()
    return (
        ids.join(org_vertical.withColumnRenamed("org", "stack_id"), "stack_id")
        .join(frameworks, "vertical")
        .join(have, ["stack_id", "framework"], "left")
        .select(
            "stack_id",
            "vertical",
            "framework",
            F.coalesce("tools", F.lit(0)).alias("tools"),
            F.col("tools").isNotNull().alias("covered"),
        )
    )


def detection_probability(
    chain_steps: DataFrame, technique_map: DataFrame, registry: DataFrame, rates: DataFrame
) -> DataFrame:
    """Chance that a tool catches a chain technique; only (technique, tool) pairs with any."""
    steps = technique_lookup(
        chain_steps.select("technique_id").distinct(), technique_map, ["tactic", "categories", "primary_vendors"]
    ).select(
        "technique_id",
        F.coalesce("tactic", F.lit("unknown")).alias("tactic"),
        "categories",
        F.transform("primary_vendors", lambda v: F.lower(v)).alias("primary_vendors"),
    )
    tools = registry.select(F.lower("vendor_id").alias("tool"), "kind")
    by_vendor = steps.select("technique_id", "tactic", F.explode("primary_vendors").alias("tool")).join(tools, "tool")
    by_kind = (
        steps.select("technique_id", "tactic", "primary_vendors", F.explode("categories").alias("kind"))
        .join(tools, "kind")
        .where(~F.array_contains("primary_vendors", F.col("tool")))
    )
    pairs = (
        by_vendor.select("technique_id", "tactic", "tool", "kind", F.lit(True).alias("primary"))
        .unionByName(by_kind.select("technique_id", "tactic", "tool", "kind", F.lit(False).alias("primary")))
        .distinct()
    )
    chance = F.when(F.col("primary"), F.least(F.coalesce("rate", F.lit(0.60)) + 0.15, F.lit(0.98))).otherwise(
        F.coalesce("rate", F.lit(0.40))
    )
    time = (
        F.when(F.col("kind").isin("email", "iam", "waf"), "immediate")
        .when(F.col("kind") == "edr", "minutes")
        .when(F.col("kind").isin("ndr", "ztna"), "minutes-hours")
        .otherwise("hours")
    )
    r = rates.select("tactic", F.col("category").alias("kind"), "rate")
    return pairs.join(r, ["tactic", "kind"], "left").select(
        "technique_id", "tool", chance.alias("probability"), time.alias("detection_time")
    )


def chain_simulation(
    stacks: DataFrame, org_vertical: DataFrame, chain_steps: DataFrame, probability: DataFrame
) -> DataFrame:
    """Outcome of every step of the vertical's chains against every stack."""
    s = stacks.select("stack_id", F.lower("tool").alias("tool")).distinct()
    best = (
        s.join(probability, "tool")
        .groupBy("stack_id", "technique_id")
        .agg(F.min(F.struct((-F.col("probability")).alias("neg"), "tool", "detection_time")).alias("b"))
    )
    ids = s.select("stack_id").distinct().join(org_vertical.withColumnRenamed("org", "stack_id"), "stack_id")
    p = F.coalesce(-F.col("b.neg"), F.lit(0.0))
    return (
        ids.join(chain_steps, "vertical")
        .join(best, ["stack_id", "technique_id"], "left")
        .select(
            "stack_id",
            "vertical",
            "chain",
            "step",
            "technique_id",
            F.col("b.tool").alias("covering_tool"),
            p.alias("probability"),
            F.col("b.detection_time").alias("detection_time"),
            F.when(F.col("b").isNull(), "PASS_THROUGH").when(p >= 0.70 - 1e-9, "BLOCKED").otherwise("DETECTED").alias("result"),
        )
    )


def chain_summary(steps: DataFrame) -> DataFrame:
    """Where a chain breaks, what passes through, coverage."""
    blocked = F.min(F.when(F.col("result") == "BLOCKED", F.col("step")))
    detected = F.min(F.when(F.col("result") == "DETECTED", F.col("step")))
    grouped = steps.groupBy("stack_id", "vertical", "chain").agg(
        F.count("*").alias("steps"),
        F.count(F.when(F.col("result") == "PASS_THROUGH", 1)).alias("pass_through"),
        blocked.alias("first_block"),
        detected.alias("__d"),
        F.product(1 - F.col("probability")).alias("overall_pass_through"),
    )
    before = F.when(F.col("first_block").isNull() | (F.col("__d") < F.col("first_block")), F.col("__d"))
    return grouped.withColumns(
        {
            "first_detect": before,
            "breaks_at": F.coalesce("first_block", before),
            "coverage_pct": 100.0 * (F.col("steps") - F.col("pass_through")) / F.col("steps"),
        }
    ).drop("__d")
