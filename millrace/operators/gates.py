"""Validation gates over dataset tables: each returns rows (gate, entity_id, code, detail), none if it holds; a driver joins them to a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import rows as W


def finding(gate: str, entity: Column, code: Column | str, detail: Column | str = "") -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(gate).alias("gate"), entity.cast("string").alias("entity_id"), lit(code).alias("code"), F.coalesce(lit(detail).cast("string"), F.lit("")).alias("detail")]


def row_rules(df: DataFrame, gate: str, entity: Column, rules: dict[str, Column], detail: Column | str = "") -> DataFrame:
    """A row per rule that a row breaks; a rule that is null isn't broken."""
    codes = F.array_compact(F.array(*[F.when(r, F.lit(c)) for c, r in rules.items()]))
    return df.withColumn("_code", F.explode(codes)).select(*finding(gate, entity, F.col("_code"), detail))


def expected_counts(df: DataFrame, gate: str, split: str, expected: dict[str, int]) -> DataFrame:
    """Splits whose row count isn't the expected one, missing splits included."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "_split string, _want long")
    have = df.groupBy(F.col(split).alias("_split")).agg(F.count(F.lit(1)).alias("_have"))
    both = want.join(have, "_split", "full").where(~F.coalesce("_want", F.lit(0)).eqNullSafe(F.coalesce("_have", F.lit(0))))
    return both.select(*finding(gate, F.col("_split"), "split_count", F.concat(F.coalesce("_have", F.lit(0)), F.lit(" of "), F.coalesce("_want", F.lit(0)))))


def minimums(df: DataFrame, gate: str, split: str, tags: str, scalars: list[str], table: list[tuple[str, str, int]]) -> DataFrame:
    """(split, tag) pairs found less often than a table of minimums asks; a tag is found as a list element or as a scalar, whichever is oftener."""
    named = F.concat(F.transform(tags, lambda x: F.struct(F.lit("tag").alias("k"), x.alias("v"))), F.array(*[F.struct(F.lit("scalar").alias("k"), F.col(c).cast("string").alias("v")) for c in scalars]))
    counts = df.select(F.col(split).alias("_split"), F.explode(named).alias("p")).groupBy("_split", "p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("_split", "v").agg(F.max("n").alias("_found"))
    want = df.sparkSession.createDataFrame(table, "_split string, v string, _want long")
    both = want.join(found, ["_split", "v"], "left").withColumn("_found", F.coalesce("_found", F.lit(0))).where("_found < _want")
    return both.select(*finding(gate, F.col("_split"), "below_minimum", F.concat_ws(" ", "v", F.concat("_found", F.lit(" < "), "_want"))))


def leaks(df: DataFrame, gate: str, split: str, keys: dict[str, Column], exempt: Column | None = None) -> DataFrame:
    """Values of a key that stand in several splits; rows that are exempt don't count. Keys go by hash, and (key, split) pairs once."""
    rows = df if exempt is None else df.where(~exempt)
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.sha2(k.cast("string"), 256).alias("h")) for n, k in keys.items()])
    each = rows.select(F.col(split).alias("_split"), F.explode(pairs).alias("p")).where("p.h is not null").select("_split", "p.*").distinct()
    several = each.groupBy("n", "h").agg(F.array_join(F.array_sort(F.collect_list("_split")), ",").alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return several.select(*finding(gate, F.substring("h", 1, 16), F.concat(F.lit("leak:"), F.col("n")), F.col("s")))


def claim_support(seeds: DataFrame, gate: str, entity: str, ids: str, topics: str, critical: Column, claims: DataFrame) -> DataFrame:
    """Seeds without a care claim, without one that fits their topics, with claims of other roles, and critical ones with a blocked claim.

    claims: claim_id, role, supports (topics), blocked. Unknown claims support nothing.
    """
    each = seeds.select(F.col(entity).alias("_e"), F.col(topics).alias("_t"), critical.alias("_c"), F.explode_outer(ids).alias("claim_id"))
    both = each.join(claims, "claim_id", "left")
    care = F.coalesce(F.col("role") == "care", F.lit(False))
    out = both.groupBy("_e").agg(F.bool_or(care).alias("care"), F.bool_or(F.coalesce(F.arrays_overlap("supports", "_t"), F.lit(False))).alias("fits"), F.bool_or(F.coalesce(F.col("role").isin("policy", "escalation", "context"), F.lit(False))).alias("other"), F.bool_or(F.col("_c") & F.coalesce("blocked", F.lit(False))).alias("blocked"))
    return row_rules(out, gate, F.col("_e"), {"lacks_care_claim": ~F.col("care"), "lacks_compatible_claim": ~F.col("fits"), "non_care_claims": F.col("other"), "blocked_claim_in_critical_seed": F.col("blocked")})


def variants(df: DataFrame, gate: str, family: str, axes: Column, contract: Column, size: int = 3, least: int = 2) -> DataFrame:
    """Families of another size; of those of the right size, the ones whose rows differ in too few axes or have one contract."""
    base = df.select(F.col(family).alias("_f"), axes.alias("_a"), F.sha2(contract, 256).alias("_h"))
    sizes = base.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), (F.min("_h") == F.max("_h")).alias("same"))
    each = base.select("_f", F.explode("_a").alias("k", "v")).groupBy("_f", "k").agg((F.min("v") != F.max("v")).alias("d")).groupBy("_f").agg(F.count_if("d").alias("differing"))
    out = sizes.join(each, "_f", "left")
    right = F.col("n") == size
    return row_rules(out, gate, F.col("_f"), {"family_size": ~right, "few_axes": right & (F.coalesce("differing", F.lit(0)) < least), "same_contract": right & F.col("same")}, F.col("n"))


def prompt_contracts(df: DataFrame, gate: str, entity: Column, prompt: Column, topic: Column, contracts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """Prompts without a cue of their topic, or with a forbidden one; unknown topics are generic."""
    lower, known = F.lower(prompt), F.coalesce(topic, F.lit("generic"))
    lacks, bad = F.lit(False), F.lit(False)
    for name, (required, forbidden) in contracts.items():
        own = known == name if name != "generic" else ~known.isin([c for c in contracts if c != "generic"])
        if required:
            lacks = lacks | (own & ~P.any_term(lower, required))
        bad = bad | (own & P.any_term(lower, forbidden))
    return row_rules(df, gate, entity, {"lacks_topic_cue": lacks, "forbidden_cue": bad}, known)


def shapes(df: DataFrame, gate: str, shape: str, split: str, cap: float = 0.30, least: int = 5) -> DataFrame:
    """The shapes over a share of all rows, and splits with too few shapes."""
    counts = df.groupBy(F.col(shape).alias("v"), F.col(split).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    dominant = counts.groupBy("v").agg(F.sum("n").alias("n")).join(F.broadcast(total), F.lit(True)).where(F.col("n") > F.col("_t") * cap)
    few = counts.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < least)
    return dominant.select(*finding(gate, F.col("v"), "dominant_shape", F.col("n"))).unionByName(few.select(*finding(gate, F.col("s"), "few_shapes", F.col("k"))))


def coverage(df: DataFrame, gate: str, split: str, values: Column, required: dict[str, list[str]]) -> DataFrame:
    """Values that a split must have and hasn't."""
    want = df.sparkSession.createDataFrame([(s, v) for s, vs in required.items() for v in vs], "_split string, v string")
    have = df.select(F.col(split).alias("_split"), F.explode(values).alias("v")).distinct()
    return want.join(have, ["_split", "v"], "left_anti").select(*finding(gate, F.col("_split"), "missing_coverage", F.col("v")))


def repetition(df: DataFrame, gate: str, values: dict[str, Column], caps: dict[str, int]) -> DataFrame:
    """Values of several fields that stand oftener than their caps, in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v"), F.lit(caps[n]).alias("cap")) for n, v in values.items()])
    counts = df.select(F.explode(pairs).alias("p")).where("p.v is not null").groupBy("p.n", "p.v", "p.cap").agg(F.count(F.lit(1)).alias("c")).where("c > cap")
    return counts.select(*finding(gate, F.sha2("v", 256).substr(1, 16), F.concat(F.lit("cap:"), "n"), F.col("c")))


def frames(df: DataFrame, gate: str, bucket: str, frame: Column, least: int = 8) -> DataFrame:
    few = df.select(F.col(bucket).alias("b"), F.sha2(frame, 256).alias("f")).distinct().groupBy("b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") < least)
    return few.select(*finding(gate, F.col("b"), "few_frames", F.col("k")))


def exercised(df: DataFrame, gate: str, text: Column, phrases: list[str], cases: Column, required: list[str]) -> DataFrame:
    """Phrases that no row's text has, and cases that no row is."""
    seen = df.agg(*[F.bool_or(F.contains(F.lower(text), F.lit(p))).alias(f"p{k}") for k, p in enumerate(phrases)], *[F.bool_or(cases == c).alias(f"c{k}") for k, c in enumerate(required)])
    lost = [F.when(~F.coalesce(f"p{k}", F.lit(False)), F.struct(F.lit("phrase_not_exercised").alias("code"), F.lit(p).alias("v"))) for k, p in enumerate(phrases)]
    lost += [F.when(~F.coalesce(f"c{k}", F.lit(False)), F.struct(F.lit("missing_case").alias("code"), F.lit(c).alias("v"))) for k, c in enumerate(required)]
    return seen.select(F.explode(F.array_compact(F.array(*lost))).alias("x")).select(*finding(gate, F.col("x.v"), F.col("x.code")))


def provenance(rows: DataFrame, gate: str, entity: str, parent: str, split: str, parents: DataFrame, key: str, lineage: dict[str, str], fields: list[str], digest: Column, stored: str) -> DataFrame:
    """Lineage of expanded rows: missing fields, repeated ids, a content hash that isn't the row's, unknown parents, parents of another split,
    and fields that differ from the parent's. `lineage` names the parents' split of each split.
    """
    times = rows.groupBy(F.col(entity).alias("_e")).agg(F.count(F.lit(1)).alias("_times"))
    held = parents.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in ("split", *fields)])
    both = rows.join(times, F.col(entity) == F.col("_e"), "left").join(held, F.col(parent) == F.col("_k"), "left")
    wanted = F.create_map(*[F.lit(x) for pair in lineage.items() for x in pair])[F.col(split)]
    known = F.col("_k").isNotNull()
    rules = {"missing_fields": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (entity, parent, stored)]), "duplicate_id": F.col("_times") > 1, "content_hash": digest != F.col(stored), "unknown_parent": ~known & F.col(parent).isNotNull(), "cross_split": known & ~wanted.eqNullSafe(F.col("_p_split"))}
    rules |= {f"parent_mismatch:{c}": known & ~F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in fields}
    return row_rules(both, gate, F.coalesce(F.col(entity).cast("string"), F.lit("")), rules)


def fidelity(rows: DataFrame, gate: str, entity: str, parent: str, claims: str, parents: DataFrame, key: str, parent_claims: str, sections: str, care: DataFrame) -> DataFrame:
    """Sections (type, claim_ids) with claims that the parent hasn't, positive ones without a care claim, unknown types, and rows whose claims aren't the parent's."""
    held = parents.select(F.col(key).alias("_k"), F.col(parent_claims).alias("_p"))
    both = rows.join(held, F.col(parent) == F.col("_k"))
    whole = row_rules(both, gate, F.col(entity), {"claim_mismatch": ~W.same_set(F.col(claims), F.col("_p"))})
    each = both.select(F.col(entity).alias("_e"), "_p", F.posexplode(sections).alias("_i", "_s"))
    known = each.select("_e", "_i", F.explode("_s.claim_ids").alias("claim_id")).join(care.select("claim_id"), "claim_id", "left_semi").select("_e", "_i").distinct().withColumn("_care", F.lit(True))
    each = each.join(known, ["_e", "_i"], "left")
    kind, ids = F.col("_s.type"), F.col("_s.claim_ids")
    rules = {"unsupported_claims": (F.size(ids) == 0) | ~W.subset(ids, F.col("_p")), "lacks_care_claim": kind.isin("safe_step", "must_ask") & F.col("_care").isNull(), "unknown_section": ~kind.isin("safe_step", "must_ask", "red_flag", "must_not_say", "boundary", "style")}
    return whole.unionByName(row_rules(each, gate, F.col("_e"), rules, kind))


def drift(rows: DataFrame, gate: str, entity: Column, text: Column, patterns: list[str], negation: str, reach: int = 45) -> DataFrame:
    """A row per unsafe match without a negation around it."""
    hits = F.concat(*[P.unguarded(text, "(?i)" + p, "(?i)" + negation, reach) for p in patterns])
    return rows.withColumn("_hit", F.explode(hits)).select(*finding(gate, entity, "unsafe_advice", F.col("_hit")))


def calibration(rows: DataFrame, gate: str, entity: Column, answer: Column, risk: Column, help_: str, watch: tuple[str, ...], referral: str, cap: float = 0.10) -> DataFrame:
    """Red answers without help, yellow ones without watching, and green referrals over a share of the green answers."""
    lower = F.lower(answer)
    each = row_rules(rows, gate, entity, {"red_lacks_escalation": (risk == "red") & ~lower.rlike(help_), "yellow_lacks_monitoring": (risk == "yellow") & ~P.any_term(lower, watch)})
    green = rows.where(risk == "green").agg(F.count(F.lit(1)).alias("n"), F.count_if(lower.rlike(referral)).alias("r")).where(F.col("r") > F.col("n") * cap)
    return each.unionByName(green.select(*finding(gate, F.lit("all"), "green_over_referral", F.concat("r", F.lit("/"), "n"))))


def collapse(rows: DataFrame, gate: str, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """Values of a field that hold more than its share of all rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("v"), F.lit(s).alias("share")) for n, (v, s) in values.items()])
    counts = rows.select(F.explode(pairs).alias("p")).groupBy("p.n", "p.share", "p.v").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("n", "share").agg(F.max("c").alias("c"), F.sum("c").alias("t")).where("c > t * share")
    return top.select(*finding(gate, F.col("n"), "dominant", F.concat("c", F.lit("/"), "t")))


def unique_within(rows: DataFrame, gate: str, parent: str, size: int | None, values: dict[str, Column]) -> DataFrame:
    """Parents with another number of rows, or with a field whose values repeat among their rows."""
    out = rows.groupBy(F.col(parent).alias("_p")).agg(F.count(F.lit(1)).alias("n"), *[(F.count_distinct(F.coalesce(v, F.lit(""))) < F.count(F.lit(1))).alias(f"_{k}") for k, v in values.items()])
    rules = {f"repeated:{k}": F.col(f"_{k}") for k in values}
    return row_rules(out, gate, F.col("_p"), ({"rows_per_parent": F.col("n") != size} if size else {}) | rules, F.col("n"))


def rejection_rate(rows: DataFrame, gate: str, reviewed: Column, rejected: Column, cap: float = 0.10) -> DataFrame:
    out = rows.agg(F.count_if(reviewed).alias("n"), F.count_if(reviewed & rejected).alias("r")).where(F.col("r") > F.col("n") * cap)
    return out.select(*finding(gate, F.lit("all"), "rejection_rate", F.concat("r", F.lit("/"), "n")))


def verdict(df: DataFrame, gates: list[str]) -> DataFrame:
    """(gate, errors, valid) for a stated list of gates, those without findings included."""
    counts = df.groupBy("gate").agg(F.count(F.lit(1)).alias("errors"))
    names = df.sparkSession.createDataFrame([(g,) for g in gates], "gate string")
    out = names.join(counts, "gate", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    return out.withColumn("valid", F.col("errors") == 0)


# ---------------------------------------------------------------- review


def review_reasons(risk: Column, bucket: Column, tags: Column, text: Column, sensitive: tuple[str, ...], buckets: tuple[str, ...], terms: dict[str, str], blocked: Column) -> Column:
    """Why a row must be reviewed, sorted."""
    found = F.array_compact(F.array(F.when(risk == "red", "red_risk"), F.when(bucket.isin(*buckets), bucket), F.when(blocked, "source_fallback_or_blocker"), *[F.when(text.rlike(p), F.lit(f"term:{n}")) for n, p in terms.items()]))
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(F.array_intersect(tags, F.array(*map(F.lit, sensitive))), lambda x: F.concat(F.lit("tag:"), x)))))


def review_selection(rows: DataFrame, key: str, reasons: str, cluster: Column, parent: str, strata: list[str], share: float = 0.4, seed: int = 76044) -> DataFrame:
    """(key, reasons): rows with reasons, the first of each cluster, the first of each parent among the others, and a share of each stratum of what is left."""
    from millrace.operators.curate import stratified_sample
    from millrace.sources.shared import written

    must = rows.where(F.size(reasons) > 0).select(key, F.explode(reasons).alias("r"))
    clusters = rows.groupBy(cluster.alias("_c")).agg(F.min(key).alias(key)).select(key, F.lit("positive_care_cluster_representative").alias("r"))
    low = rows.where(F.size(reasons) == 0)
    parents = low.groupBy(parent).agg(F.min(key).alias(key)).select(key, F.lit("seed_representative").alias("r"))
    chosen = written(must.unionByName(clusters).unionByName(parents), "review")
    rest = low.join(chosen.select(key).distinct(), key, "left_anti")
    sampled = stratified_sample(rest, strata, key, share, seed).select(key, F.lit("stratified_optional_40_percent").alias("r"))
    return chosen.unionByName(sampled).groupBy(key).agg(F.array_sort(F.collect_set("r")).alias("reasons"))


def decision(findings: DataFrame, reviewer: str) -> DataFrame:
    """One row: how many findings block, by severity, and the decision; a positive one needs a named reviewer."""
    out = findings.agg(F.count(F.lit(1)).alias("blocking"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "major").alias("major"))
    return out.withColumn("decision", F.when((F.col("blocking") > 0) | F.lit(not reviewer), "repair_required").otherwise("approved_for_pilot_eval_only"))


def known_regressions(findings: DataFrame, family: str, category: str, known: dict[str, str]) -> DataFrame:
    """(family, category, hits, pass) of a stated list of past failures."""
    want = findings.sparkSession.createDataFrame(list(known.items()), "family string, category string")
    hits = findings.groupBy(F.col(family).alias("family"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("hits"))
    out = want.join(hits, ["family", "category"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("pass", F.col("hits") == 0)


def probes(rows: DataFrame, tags: str, parent: str, wanted: dict[str, str], k: int = 10) -> DataFrame:
    """(probe, parents): constant probes with the first parents of their tag."""
    table = rows.sparkSession.createDataFrame(list(wanted.items()), "probe string, tag string")
    each = rows.select(F.explode(tags).alias("tag"), F.col(parent).alias("_p")).distinct()
    w = Window.partitionBy("tag").orderBy("_p")
    few = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    lists = few.groupBy("tag").agg(F.array_sort(F.collect_list("_p")).alias("parents"))
    return table.join(lists, "tag", "left").select("probe", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


# ---------------------------------------------------------------- research


def audit(chunks: DataFrame, family: str, tokens: str, digest: str, share: float = 0.50) -> DataFrame:
    """(family, chunks, tokens, share, dominant) and repeated chunks of each family."""
    copies = chunks.groupBy(digest).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    rows = chunks.join(copies, digest, "left")
    out = rows.groupBy(family).agg(F.count(F.lit(1)).alias("chunks"), F.sum(tokens).alias("tokens"), F.count("_copies").alias("repeated"))
    total = out.agg(F.sum("tokens").alias("_t"))
    out = out.join(F.broadcast(total), F.lit(True)).withColumn("share", F.round(F.col("tokens") / F.col("_t"), 6)).drop("_t")
    return out.withColumn("dominant", F.col("share") > share)


def question_bank(chunks: DataFrame, key: str, topics: str, text: str, kinds: tuple[str, ...], first: int = 1, regular: int = 40, most: int = 60) -> DataFrame:
    """(key, topic, kind): the first chunk of each topic that no topic before it took, then chunks in order, `most` at most, kinds in turn.

    The topics' candidates, as many chunks of each as there are topics, are the only rows that the driver sees: a topic can lose no
    more than that to the topics before it.
    """
    each = chunks.select(key, F.explode(topics).alias("topic"))
    n = each.select("topic").distinct().count()
    w = Window.partitionBy("topic").orderBy(key)
    few = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).orderBy("topic", key)
    used: dict[object, str] = {}
    taken: set[str] = set()
    for row in few.toLocalIterator():
        if row["topic"] not in taken and row[key] not in used:
            used[row[key]] = row["topic"]
            taken.add(row["topic"])
    spark = chunks.sparkSession
    kind = chunks.schema[key].dataType.simpleString()
    heads = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(sorted(used.items(), key=lambda x: x[1]))][:most], f"{key} {kind}, topic string, place long")
    rest = chunks.join(heads.select(key), key, "left_anti").orderBy(key).limit(max(0, min(regular, most - len(used)))).select(key)
    rest = rest.withColumn("place", F.row_number().over(Window.orderBy(key)) + len(used) - 1).select(key, F.lit("any").alias("topic"), F.col("place").cast("long").alias("place"))
    out = heads.unionByName(rest)
    return out.select(key, "topic", F.element_at(F.array(*map(F.lit, kinds)), (F.col("place") % len(kinds) + 1).cast("int")).alias("kind"))
