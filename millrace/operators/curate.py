"""Curation: classify, flag, gate, split, sample, deduplicate exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import sets as S
from millrace.functions import text as T
from millrace.sources.shared import written


def classify(text: Column, hard: str, low: str, risky: str) -> Column:
    """Ordered: hard reject, low quality, quarantine for risky spans, accept; struct(state, reason)."""
    pick = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(hard), pick("reject", "hard_reject")).when(t.rlike(low), pick("reject", "low_quality")).when(t.rlike(risky), pick("quarantine", "risky_spans")).otherwise(pick("accept", "clean"))


def flags(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in their order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def status(tokens: Column, removed: Column, hard: Column, tier: Column, species: Column, untrusted: tuple[str, ...], trusted: tuple[str, ...], least: int = 80, most: int = 12) -> Column:
    """Ordered: untrusted sources with hard matches are rejected; too little text, or too much stripped, is quarantined; what was stripped or strays from the species is accepted as stripped."""
    return (
        F.when(hard & tier.isin(*untrusted), "rejected")
        .when(tokens < least, "quarantined")
        .when(removed > most, "quarantined")
        .when((removed > 0) | hard | ~species, "accepted_stripped")
        .otherwise("accepted")
    )


def source_flags(text: Column, removed: Column, tokens: Column, hard: str, mojibake: str, species: Column, hindi: Column, most: int = 12, least: int = 80) -> Column:
    """The seven flags of a source, in their order."""
    t = F.coalesce(text, F.lit(""))
    rules = {
        "hard_reject_pattern": t.rlike(hard),
        "possible_mojibake_or_ocr_noise": t.rlike(mojibake),
        "risky_spans_stripped": removed > 0,
        "procedure_or_dose_heavy": removed > most,
        "non_target_species": ~species,
        "too_little_clean_text": tokens < least,
        "hindi_source_without_devanagari_detected": hindi & ~t.rlike("[\\u0900-\\u097F]"),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def share_of_total(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """(key, n, amount, share): the total is a sum over the groups, one row per key."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
    total = groups.agg(F.sum("amount").alias("_total"))
    return groups.join(F.broadcast(total), F.lit(True)).select(key, "n", "amount", F.round(F.col("amount") / F.col("_total"), 6).alias("share"))


def exact_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Hashes that occur more than once, with their surplus."""
    return df.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").withColumn("surplus", F.col("copies") - 1)


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Every row with `duplicate`: true for all but the first of its key; the first is a sum per key, so hot keys don't gather."""
    keyed = df.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(first, "_key", "left").withColumn("duplicate", F.col(order) != F.col("_first")).drop("_key", "_first")


def hash_ranked(df: DataFrame, strata: list[str], digest: Column, tie: str, bins: int = 3) -> DataFrame:
    """The rows with `_rank` (from 1) by digest within their stratum, and `_n`, its size; digest is hexadecimal.

    A stratum is cut into 16 ** `bins` ranges by the digest's first digits; a rank is a range's rows before it plus the place in it,
    so no task holds a stratum, however large.
    """
    keyed = df.withColumn("_digest", digest).withColumn("_bin", F.substring("_digest", 1, bins))
    counts = keyed.groupBy(*strata, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*(strata or [F.lit(0)]))
    starts = counts.withColumns({"_before": F.coalesce(F.sum("_m").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_m").over(whole)})
    names = {c: f"_s{k}" for k, c in enumerate(strata)}
    starts = starts.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_bin").alias("_b"), "_before", "_n")
    same = F.col("_bin") == F.col("_b")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    place = F.row_number().over(Window.partitionBy(*strata, "_bin").orderBy("_digest", tie))
    return keyed.withColumn("_place", place).join(starts, same).withColumn("_rank", F.col("_before") + F.col("_place")).drop(*names.values(), "_b", "_bin", "_digest", "_place", "_before", "_m")


def hash_rank_split(df: DataFrame, key: str, train: float = 0.70, dev: float = 0.15) -> DataFrame:
    """(key, split) of the distinct keys ranked by hash: shares are rounded half to even, train and dev have one at least, and test takes one from train if it would have none."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = hash_ranked(ids, [], F.sha2(F.col(key).cast("string"), 256), key)
    first, second = F.greatest(F.lit(1), F.bround(F.col("_n") * train)), F.greatest(F.lit(1), F.bround(F.col("_n") * dev))
    short = F.col("_n") - first - second < 1
    first = F.when(short, first - 1).otherwise(first)
    return ranked.select(key, F.when(F.col("_rank") <= first, "train").when(F.col("_rank") <= first + second, "dev").otherwise("test").alias("split"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, share: float = 0.4, seed: int = 76044) -> DataFrame:
    """Per stratum the first max(1, floor(share * n + 0.999)) rows by hash of the key."""
    ranked = hash_ranked(df, strata, F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.999))).drop("_n", "_rank")


def balance_caps(df: DataFrame, groups: dict[str, int], order: str, most: int) -> DataFrame:
    """Greedy choice in order under a cap per value of each column, `most` rows in all.

    Rows beyond the smallest cap of their combination can't be chosen, so a ranked prefix of each combination remains; those
    few (combinations x cap) are chosen in one ordered pass.
    """
    cap = min([*groups.values(), most])
    w = Window.partitionBy(*groups).orderBy(order)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r").orderBy(order)
    seen: dict[tuple[str, object], int] = {}
    chosen = []
    for row in few.select(order, *groups).toLocalIterator():
        if len(chosen) == most:
            break
        keys = [(c, row[c]) for c in groups]
        if all(seen.get(k, 0) < groups[k[0]] for k in keys):
            chosen.append(row[order])
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
    return df.where(F.col(order).isin(chosen)) if chosen else df.limit(0)


def repeated_values(df: DataFrame, value: Column, cap: int) -> DataFrame:
    """Values above the cap: (value, n), a repetition gate."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)


def leaked_keys(df: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys, by their hash, that stand in more than one split; (key, split) pairs are made distinct first, so a hot key is a few rows."""
    return df.select(F.sha2(key, 256).alias("key"), split).where(F.col("key").isNotNull()).distinct().groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def missing_values(df: DataFrame, column: str, required: list[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(x,) for x in required], f"{column} string").join(df.select(column).distinct(), column, "left_anti")


def required_gate(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """A row (entity_id, code) per missing field."""
    codes = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing:{c}")) for c in columns]))
    return df.select(F.col(entity).alias("entity_id"), F.explode(codes).alias("code"))


def table_checksum(df: DataFrame, text: str) -> DataFrame:
    """An order-free checksum: row count and sums of 32-bit pieces of the rows' hashes, each a partial sum."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    piece = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n"), piece(0).alias("a"), piece(1).alias("b"))


def chunked(df: DataFrame, key: str, text: str, size: int = 750, overlap: int = 75, least: int = 80) -> DataFrame:
    """(key, chunk, start, n_words, content_hash, text): chunks numbered over those that are emitted."""
    out = df.select(key, F.posexplode(T.chunks(F.col(text), size, overlap, least)).alias("chunk", "c"))
    body = F.array_join("c.words", " ")
    return out.select(key, F.col("chunk").cast("long").alias("chunk"), F.col("c.start").cast("long").alias("start"), F.size("c.words").cast("long").alias("n_words"), F.sha2(body, 256).alias("content_hash"), body.alias("text"))


#: Grams of the texts, and pairs, that are confirmed at a time; a larger group of candidates is cut into blocks of its texts by themselves.
GROUP_GRAMS, GROUP_PAIRS = 2_000_000, 20_000


def near_duplicate_pairs(df: DataFrame, key: str, text: Column, block: Column, split: Column, threshold: float = 0.96, n: int = 5) -> DataFrame:
    """(kind, left_id, right_id, similarity): texts of one block that stand in several splits, exactly or with a Jaccard similarity of their
    character n-grams over the threshold.

    Equal texts are one class, which its smallest id stands for: one row per class that stands in two splits (kind exact, right_id its
    largest id), one per pair of classes that are near and not all of one split (kind near). Candidates share a signature, as sets
    that are so alike must, so no pair is lost; they are confirmed on the whole sets. Sets aren't kept: signatures take a twelfth of
    them, and a candidate's set is made again from its text, once in each group of candidates that it is in.
    """
    rows = df.select(F.col(key).alias("id"), text.alias("t"), block.alias("block"), split.alias("split")).withColumn("h", F.unhex(F.sha2("t", 256)))
    sign = F.pandas_udf(S.signed(n, threshold), "m int, own array<long>, next array<long>")
    # the larger half of the work is done where the texts stand; they don't travel
    signed = rows.select("id", "block", "h", "split", sign("t").alias("s"))
    classes = signed.groupBy("block", "h").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.array_sort(F.collect_set("split")).alias("splits"), F.first("s").alias("s"))
    # once written, the numbers are fixed
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    exact = classes.where(F.size("splits") > 1).select(F.lit("exact").alias("kind"), F.col("id").alias("left_id"), F.col("last").alias("right_id"), F.lit(1.0).alias("similarity"))
    # the lowest bit of a code: 1 as a member of the next interval, where those of its own interval aren't sought again
    coded = lambda items, bit: F.transform(items, lambda x: F.struct(F.xxhash64("block", x).alias("k"), (F.col("node") * 2 + bit).alias("c")))
    held = classes.where("block is not null").select(F.explode(F.concat(coded(F.col("s.own"), 0), coded(F.col("s.next"), 1))).alias("x")).select("x.k", "x.c")
    half = lambda c: F.shiftright(c, 1)
    met = held.select("k", F.col("c").alias("ca")).join(held.select("k", F.col("c").alias("cb")), "k").where((half("ca") < half("cb")) & (F.col("ca").bitwiseAND(F.col("cb")).bitwiseAND(F.lit(1)) == 0))
    side = lambda c: classes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"), F.col("block").alias(f"{c}_block"), F.col("splits").alias(f"{c}_s"))
    apart = ~((F.size("a_s") == 1) & (F.size("b_s") == 1) & (F.col("a_s") == F.col("b_s")))
    pairs = met.select(half("ca").alias("a"), half("cb").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    pairs = written(pairs.where((F.col("a_block") == F.col("b_block")) & (F.col("a_id") != F.col("b_id")) & apart).select("a", "b", "a_id", "b_id"), "near-pairs")
    # pairs of one neighbourhood are one group, so that a text goes where its pairs are, not along with each
    first = pairs.groupBy("b").agg(F.min("a").alias("_first"))
    led = pairs.join(first.withColumnRenamed("b", "a"), "a", "left").withColumn("group", F.coalesce("_first", "a")).select("group", "a", "b")
    within = led.select("group", F.col("a").alias("node")).unionByName(led.select("group", F.col("b").alias("node"))).distinct()
    weight = within.join(classes.select("node", "s.m"), "node").groupBy("group").agg(F.sum("m").alias("m"))
    cuts = led.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(weight, "group").select("group", F.greatest(F.ceil(F.col("m") / GROUP_GRAMS), F.ceil(F.sqrt(F.col("n") / GROUP_PAIRS))).cast("int").alias("cuts"))
    # groups to cut are few, so their many pairs needn't meet in one task for it
    cuts = written(cuts.where("cuts > 1"), "near-cuts")
    cuts = F.broadcast(cuts) if cuts.limit(200_001).count() <= 200_000 else cuts
    cell = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.col("cuts")), F.lit(0)).cast("int")
    led = written(led.join(cuts, "group", "left").select("group", cell("a").alias("ga"), cell("b").alias("gb"), "a", "b"), "near-groups")
    place = ["group", "ga", "gb"]
    members = led.select(*place, F.col("a").alias("node")).unionByName(led.select(*place, F.col("b").alias("node"))).distinct()
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("id", "h", "node")
    few = wanted.limit(200_001).count() <= 200_000
    texts = rows.select("id", "h", "t").join(F.broadcast(wanted) if few else wanted, ["id", "h"]).select("node", "t")
    texts = members.join(texts, "node").select(*[F.col(c).alias(f"_{c}") for c in place], "node", "t")
    both = led.groupBy(*place).cogroup(texts.groupBy(*[f"_{c}" for c in place])).applyInPandas(S.confirmed(n, threshold), "a long, b long, similarity double")
    near = pairs.join(both, ["a", "b"]).select(F.lit("near").alias("kind"), F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"), "similarity")
    return exact.unionByName(near)
