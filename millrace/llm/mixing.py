"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in a fixed order (size class, hash); the expected copies of each are summed up along it, one
random offset is added, and a document is emitted once per integer that its interval crosses. Neighbours in the order are of
like size (CLASSES classes for each power of two, single sizes below), so what rounding takes too much of one document it
takes too little of its neighbour, and the words taken miss the target by about the longest document at most, as the error is a sum
of size steps, each times a fraction. So that one long document can't miss the target of a small source, the at most LONG
texts of a source that are longer than LONG_SHARE of its target have whole expected copies, chosen from the longest down so that
their words keep near their share; the others share what is left at one rate, which stays within 0 and the most copies.

The running sums come from small sums, so no task holds a source: rows within a chunk, chunks within a
class, classes within a source. A class is cut by hash into chunks of about CHUNK rows by its own count, whatever share of the rows
it has; a class of up to CHUNK rows is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, Names, discard, scratch, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
CHUNK = 4_000
#: Size classes for each power of two; a power of two itself.
CLASSES = 64
#: Texts longer than this share of their source's target have whole expected copies, the LONG longest of a source at most.
LONG_SHARE, LONG = 0.02, 100


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_of(digest: Column) -> Column:
    """A number in [0, 1) out of a hexadecimal hash."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def unit(text: Column) -> Column:
    return unit_of(F.md5(text))


def size_class(size: Column) -> Column:
    """CLASSES classes for each power of two, so single sizes up to twice that."""
    bits = F.length(F.bin(size))
    return F.when(size < CLASSES, size).otherwise(bits * CLASSES + F.floor(size / F.pow(F.lit(2.0), bits - 1 - F.lit(CLASSES.bit_length() - 1))) % CLASSES).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight of 100 %, none over its cap.

    Filling up by weight is one sort by cap per weight: were exactly the sources before one capped, the others would share the
    rest at some level per weight; capping a source that is over its cap raises that level, capping one that isn't lowers
    it, so the level is the highest of these. One row per source goes in, so these windows see the sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.withColumns({"_w": pick, "_cap": (F.col("source_size") * max_copies).cast("double")})
    out = out.withColumns({
        "_total": F.sum("source_size").over(everything).cast("double"),
        "_done": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_left": F.sum("_w").over(rest),
    })
    out = out.withColumn("_level", (F.col("_total") - F.col("_done")) / F.col("_left"))
    level = F.max("_level").over(everything)
    return out.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_w")).alias("target"))


def long_texts(rows: DataFrame, goal: DataFrame, max_copies: int) -> DataFrame:
    """(source, size, h, tie, m, c): the long texts of each source, in m equal rows, and the whole copies c of each.

    From the longest down a text gets the copies that bring the words taken so far nearest to the rate times the words so far.
    """
    near = goal.select(F.col("source").alias("_g"), "rate", (F.col("target") * LONG_SHARE).alias("_least"))
    found = rows.join(small(near, BROADCAST_ROWS // 4), F.col("source").eqNullSafe(F.col("_g"))).where(F.col("size") > F.col("_least"))
    found = found.groupBy("source", "rate", "size", "h", "tie").agg(F.count(F.lit(1)).alias("m"))
    longest = Window.partitionBy("source").orderBy(F.desc("size"), "h", "tie")
    found = found.withColumn("_r", F.row_number().over(longest)).where(F.col("_r") <= LONG)
    listed = found.groupBy("source", "rate").agg(F.array_sort(F.collect_list(F.struct("_r", "size", "h", "tie", "m"))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("c"))

    def step(done: Column, x: Column) -> Column:
        own = x["size"] * x["m"]
        c = F.floor((F.col("rate") * (done["words"] + own) - done["taken"]) / own + 0.5)
        c = F.greatest(F.lit(0), F.least(F.lit(max_copies), c)).cast("long")
        return F.struct((done["words"] + own).alias("words"), (done["taken"] + c * own).alias("taken"), F.concat(done["c"], F.array(c)).alias("c"))

    chosen = listed.select("source", F.explode(F.arrays_zip(F.col("t"), F.aggregate("t", start, step)["c"].alias("c"))).alias("x"))
    return chosen.select("source", "x.t.size", "x.t.h", "x.t.tie", "x.t.m", "x.c")


MADE = ("size", "source_size", "target", "copies", "taken")


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 7, keep: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (= copies * size); with `keep` beside its own columns.

    Null text has size 0; a null source is a source, last in order. A source without words has no target and gives
    no copies. Repeated rows are documents of their own, and rows of one id are told apart by their text. An empty table gives an
    empty result. Reruns agree. Input columns named like the made ones are replaced.
    """
    name, tables = Names(docs), []
    src, cls, h, piece, tie, rank = map(name, ("source", "class", "h", "piece", "tie", "rank"))
    hashed = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    placed = docs.drop(*(c for c in docs.columns if c in MADE)).withColumns({src: F.col(source), "size": word_count(F.col(text)), h: hashed, tie: F.xxhash64(F.col(text))})
    placed = placed.withColumn(cls, size_class(F.col("size")))
    narrow = scratch(placed.select(F.col(doc_id).alias("doc_id"), src, "size", h, tie, cls), "mix-sizes", tables)
    sums = scratch(narrow.groupBy(F.col(src).alias("source")).agg(F.sum("size").alias("source_size")), "mix-sources", tables)
    goal = targets(sums, weights, max_copies)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = scratch(goal.withColumn("rate", rate), "mix-targets", tables)
    whole = long_texts(narrow.select(F.col(src).alias("source"), "size", F.col(h).alias("h"), F.col(tie).alias("tie")), goal, max_copies)
    whole = scratch(whole.select(F.col("source").alias(name("_ws")), F.col("size").alias(name("_wsize")), F.col("h").alias(name("_wh")), F.col("tie").alias(name("_wt")), F.col("m").alias(name("_wm")), F.col("c").alias(name("_whole"))), "mix-whole")
    spent = whole.groupBy(F.col(name("_ws")).alias("_s")).agg(F.sum(F.col(name("_wsize")) * F.col(name("_wm"))).alias("_long"), F.sum(F.col(name("_wsize")) * F.col(name("_wm")) * F.col(name("_whole"))).alias("_taken"))
    side = small(whole, BROADCAST_ROWS // 4)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(side, F.col(src).eqNullSafe(F.col(name("_ws"))) & (F.col("size") == F.col(name("_wsize"))) & (F.col(h) == F.col(name("_wh"))) & F.col(tie).eqNullSafe(F.col(name("_wt"))), "left")

    rest = scratch(marked(narrow).select(*narrow.columns, name("_whole")), "mix-marked")
    sizes = scratch(rest.where(F.col(name("_whole")).isNull()).groupBy(src, cls).agg(F.count(F.lit(1)).alias("n")), "mix-classes", tables)
    goal = goal.join(spent, F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({"_long": F.coalesce("_long", F.lit(0)), "_taken": F.coalesce("_taken", F.lit(0))})
    left = F.when(F.col("source_size") > F.col("_long"), F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), (F.col("target") - F.col("_taken")) / (F.col("source_size") - F.col("_long"))))).otherwise(F.lit(0.0))
    goal = scratch(goal.select("source", "source_size", "target", left.alias("rate")), "mix-rates", tables)
    offset = unit(F.concat(F.coalesce("source", F.lit("null")), F.lit(f":offset:{seed}")))
    upto = Window.partitionBy(src).orderBy(cls).rowsBetween(Window.unboundedPreceding, -1)
    laid = sizes.select(F.col(src).alias("_s"), F.col(cls).alias("_c"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long").alias("_pieces"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    laid = small(scratch(laid.withColumnsRenamed({c: name(c) for c in laid.columns}), "mix-laid"), BROADCAST_ROWS // 4)
    rates = goal.select(F.col("source").alias(name("_g")), F.col("source_size").alias(name("_source_size")), F.col("target").alias(name("_target")), F.col("rate").alias(name("_rate")), offset.alias(name("_offset")))
    rates = small(scratch(rates, "mix-offsets"), BROADCAST_ROWS // 4)

    def dealt(rows: DataFrame) -> DataFrame:
        out = rows.join(laid, F.col(src).eqNullSafe(F.col(name("_s"))) & (F.col(cls) == F.col(name("_c"))), "left")
        return out.withColumn(piece, F.floor(unit_of(F.col(h)) * F.coalesce(name("_pieces"), F.lit(1))).cast("long"))

    chunk = [src, cls, piece]
    sampled = F.col(name("_whole")).isNull()
    cut = dealt(rest).where(sampled & (F.col(name("_pieces")) > 1)).groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(src, cls).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).select(*(F.col(c).alias(name(f"_{k}")) for k, c in enumerate(chunk)), F.col("start").alias(name("_start")))
    starts = small(scratch(starts, "mix-starts"), BROADCAST_ROWS // 4)
    discard(*tables)
    # a hash that two ids share, and rows of one id, are told apart by size and text; rows that are equal throughout take places alike
    order = Window.partitionBy(*chunk).orderBy(F.col(name("_whole")).asc_nulls_first(), h, "size", tie)
    out = dealt(marked(placed) if keep else rest).withColumn(rank, F.row_number().over(order))
    out = out.join(starts, F.col(src).eqNullSafe(F.col(name("_0"))) & (F.col(cls) == F.col(name("_1"))) & (F.col(piece) == F.col(name("_2"))), "left")
    out = out.join(rates, F.col(src).eqNullSafe(F.col(name("_g"))))
    k = F.coalesce(name("_before"), F.lit(0)) + F.coalesce(name("_start"), F.lit(0)) + F.col(rank)
    taken = F.floor(k * F.col(name("_rate")) + F.col(name("_offset"))) - F.floor((k - 1) * F.col(name("_rate")) + F.col(name("_offset")))
    copies = F.least(F.coalesce(F.col(name("_whole")), taken), F.lit(max_copies)).cast("long")
    out = out.withColumns({"copies": copies, "source_size": F.col(name("_source_size")), "target": F.col(name("_target"))})
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*([c for c in docs.columns if c not in MADE] if keep else ["doc_id", F.col(src).alias("source")]), *MADE)
