"""Joins, counters, windows and set operations that gates and reports are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.curate import hash_ranked
from millrace.sources.shared import written

#: Rows of a looked-up side that are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def missing_references(df: DataFrame, entity: str, ids: str, known: DataFrame, key: str) -> DataFrame:
    """(entity_id, missing): the elements of an array column that a table has no row for."""
    each = df.select(F.col(entity).alias("entity_id"), F.explode(F.array_distinct(ids)).alias("_id"))
    lost = each.join(known.select(F.col(key).alias("_id")), "_id", "left_anti")
    return lost.groupBy("entity_id").agg(F.array_sort(F.collect_list("_id")).alias("missing"))


def parent_mismatch(rows: DataFrame, entity: str, parent: str, parents: DataFrame, key: str, rules: dict[str, Callable], unknown: str) -> DataFrame:
    """(entity_id, code): a row per rule that a child and its parent break; `rules` take two functions from a name to the child's and the parent's column.

    A child without a parent has the code `unknown` beside those of its rules that nulls break.
    """
    held = parents.select(*[F.col(c).alias(f"_p_{c}") for c in parents.columns])
    both = rows.join(held, F.col(parent) == F.col(f"_p_{key}"), "left")
    broken = [F.when(F.col(f"_p_{key}").isNull(), F.lit(unknown))]
    broken += [F.when(rule(F.col, lambda c: F.col(f"_p_{c}")), F.lit(code)) for code, rule in rules.items()]
    return both.select(F.col(entity).alias("entity_id"), F.explode(F.array_compact(F.array(*broken))).alias("code"))


def overlapping(a: DataFrame, a_key: str, a_items: str, b: DataFrame, b_key: str, b_items: str) -> DataFrame:
    """(a_key, b_key) of rows whose arrays share an element; an equality join on elements, not a nested loop."""
    left = a.select(a_key, F.explode(F.array_distinct(a_items)).alias("_x"))
    return left.join(b.select(b_key, F.explode(F.array_distinct(b_items)).alias("_x")), "_x").select(a_key, b_key).distinct()


def missing_pairs(rows: DataFrame, key: str, systems: list[str], system: str, have: DataFrame) -> DataFrame:
    """(key, system) of a stated list of systems that a table has no row for."""
    want = rows.select(key, F.explode(F.array(*map(F.lit, systems))).alias(system))
    return want.join(have.select(key, system), [key, system], "left_anti")


def either_key(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(key, value): an index by any of several keys; earlier keys go before later ones, then the smallest value."""
    out = None
    for k, c in enumerate(keys):
        part = rows.select(F.col(c).alias("key"), F.struct(F.lit(k).alias("k"), F.col(value).alias("v")).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("s").alias("s")).select("key", F.col("s.v").alias("value"))


def overlaps(a: DataFrame, b: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(label, overlap): how many values of each key two tables share."""
    each = lambda df, side: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), k.cast("string").alias("value")) for n, k in keys.items()])).alias("s")).select("s.*", F.lit(side).alias("side"))
    both = each(a, 0).unionByName(each(b, 1)).where(F.col("value").isNotNull()).groupBy("label", "value").agg((F.min("side") != F.max("side")).alias("shared"))
    return both.groupBy("label").agg(F.count_if("shared").alias("overlap"))


def element_counts(df: DataFrame, items: Column) -> DataFrame:
    return df.select(F.explode(items).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def counters(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): several counters in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, value: Column, order: str, k: int) -> DataFrame:
    """(value, n, rank): the k commonest, ties by first place; sorted after counting."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    top = counts.orderBy(F.desc("n"), "_first").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, counts): a map from inner values to counts."""
    n = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(inner, "n"))).alias("counts"))


def map_averages(df: DataFrame, group: str, scores: Column) -> DataFrame:
    """(group, key, average): sums of map values over all rows of the group, those without the key included."""
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    sums = df.select(group, F.explode(scores).alias("key", "v")).groupBy(group, "key").agg(F.sum("v").alias("_v"))
    return sums.join(totals, group).select(group, "key", F.round(F.col("_v") / F.col("_total"), 4).alias("average"))


def examples(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """(group, examples): the first k ids; ranked before they are gathered, so a list never exceeds k."""
    w = Window.partitionBy(group).orderBy(order)
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return few.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("examples"))


def differing_axes(df: DataFrame, family: str, axes: Column) -> DataFrame:
    """(family, differing): in how many axes of a map the rows of a family differ."""
    each = df.select(family, F.explode(axes).alias("axis", "value")).groupBy(family, "axis").agg((F.min("value") != F.max("value")).alias("d"))
    return each.groupBy(family).agg(F.count_if("d").alias("differing"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest id of each key."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(first, [*keys, order], "left_semi")


def prefix_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """By position in a numeric order: the first floor(share * n) rows train, the others are dev; ranks by ranges, not in one task."""
    ranked = hash_ranked(df, [], F.lpad(F.hex(F.col(order)), 16, "0"), order, bins=13)
    return ranked.select(*df.columns, F.when(F.col("_rank") <= F.floor(F.col("_n") * share), "train").otherwise("dev").alias("split"))


def priority_first(df: DataFrame, priority: Column, order: str, k: int) -> DataFrame:
    """The first k rows, priority ones before the others."""
    top = df.withColumn("_p", (~priority).cast("int")).orderBy("_p", order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_p", order))).drop("_p")


def cycled(rows: DataFrame, order: str, n: int, variants: tuple[str, ...]) -> DataFrame:
    """(i, <order>, variant): n places filled by rows and variants in turn; rows are a catalogue, numbered in one task."""
    listed = written(rows, "cycle")
    size = listed.count()
    numbered = listed.withColumn("_k", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
    places = rows.sparkSession.range(n).withColumnRenamed("id", "i")
    out = places.join(numbered, F.col("i") % size == F.col("_k"))
    return out.select("i", order, F.element_at(F.array(*map(F.lit, variants)), (F.col("i") % len(variants) + 1).cast("int")).alias("variant"))


def changed(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, previous, current) of (key, value) tables where the two differ."""
    both = previous.select("key", F.col("value").alias("previous")).join(current.select("key", F.col("value").alias("current")), "key", "full")
    return both.where(~F.col("previous").eqNullSafe(F.col("current")))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time, or null.

    Both sides are sorted together within a key, so a key's rows are read once and no pairs are made.
    """
    both = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1)}).unionByName(right.select(key, at, value).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_v", F.last(value, ignorenulls=True).over(w)).where("_left = 1").drop("_left", value).withColumnRenamed("_v", value)
