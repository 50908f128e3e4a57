"""Near duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle falls by hash into one of T bins with a value; a bin keeps the value of its first round,
the smallest one. After T random rounds, round T + j sends all shingles to bin j, so every coordinate of any non-empty set
fills, and coordinates agree with the sets' Jaccard similarity in expectation, concentrated as for T independent minima.

Plan: (1) texts of equal word sequences form a class, a node of the graph with a number of its own, whatever ids its rows have;
(2) band keys of BANDS x ROWS coordinates make buckets; (3) a bucket's members are first tried against its centre, the
member with most company, which settles copies in rows that grow with the group, not with its square; (4) a bucket whose members
aren't yet all in one component is opened: members outside its largest component are compared with all members of other
components, in blocks of at most BLOCK by BLOCK, so that a bucket of any size is done whole, a stranger in a group of millions costs
one row more per member, and only pairs whose sketches come within MARGIN deviations of the threshold leave it; (5) each
candidate pair is confirmed on full shingle sets; (6) components by alternating stars. Joins that put the partners of one
node on a key are salted by their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from millrace.llm.common import Names, Rolling, bounded_batches, canonical, discard, mix, scratch, small, text_blocks, word_bounds

SHINGLE = 5
T, BANDS, ROWS = 256, 32, 5
BLOCK = 512
#: Bytes of text that are hashed together: a worker keeps what its largest block took.
TEXT_BYTES = 200_000
MARGIN = 4.5
#: Classes that are broadcast (24 bytes each) to pick the texts of candidates; beyond, both sides are shuffled.
BROADCAST_CLASSES = 500_000
#: Partners of one node that a task joins with one copy of the node's set.
PARTNERS = 2_000

_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64))
_HASH = Rolling(1105)
_LOW = np.uint64((1 << 47) - 1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each canonical text the sorted distinct 64-bit hashes of its k-word shingles; of all words if fewer; none if none."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = word_bounds(data)
    sums = _HASH.sums(data)
    at = 0
    for t in texts:
        n = t.count(b" ") + 1 if t else 0
        w = min(n, k)
        s, e = start[at : at + n - w + 1], end[at + w - 1 : at + n]
        at += n
        yield np.unique(_HASH.ranges(sums, s, e)) if n else np.zeros(0, np.uint64)


def sketch(items: np.ndarray) -> np.ndarray:
    """The T coordinates of a non-empty set of 64-bit hashes."""
    out, filled, i = np.zeros(T, np.uint64), np.zeros(T, bool), 0
    while i < T and not filled.all():
        rounds = min(T - i, max(1, math.ceil(1.2 * T * math.log(T) / len(items))))
        h = mix(items[None, :] ^ _SEEDS[i : i + rounds, None])
        key = (h >> np.uint64(56)) << np.uint64(56) | (np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(47))[:, None] | (h & _LOW)
        key = np.sort(key, axis=None)
        bins = (key >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        new = first[~filled[bins[first]]]
        out[bins[new]] = key[new]
        filled[bins[new]] = True
        i += rounds
    for j in np.flatnonzero(~filled):
        out[j] = np.uint64(j) << np.uint64(56) | np.uint64(T + j) << np.uint64(47) | (mix(items ^ _SEEDS[T + j]) & _LOW).min()
    return mix(out)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key per band out of the ROWS low bytes that the sketches keep, so that equal bytes mean one bucket."""
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = key << np.uint64(8) | rows[:, j]
    return key.view(np.int64)


SIGNED = "n_shingles long, class binary, sketch binary, bands array<long>"


def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What banding needs of each text: set size, 128 bits of the word sequence, the sketch's low bytes, band keys."""
    for texts in batches:
        rows = []
        for _, block in text_blocks([canonical(t).lower() for t in texts], TEXT_BYTES):
            for t, items in zip(block, shingle_sets(block), strict=True):
                if len(items):
                    low = (sketch(items) & np.uint64(255)).astype(np.uint8)
                    rows.append((len(items), xxh3_128_digest(t), low.tobytes(), band_keys(low)))
                else:
                    rows.append((0, None, None, None))
        yield pd.DataFrame(rows, columns=["n_shingles", "class", "sketch", "bands"])


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a == b, axis=1)


def least_agreement(threshold: float) -> int:
    """Sketches of a pair at the threshold agree in fewer coordinates with a chance of some 1e-6."""
    return math.ceil(T * threshold - MARGIN * math.sqrt(T * threshold * (1 - threshold)))


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def estimates(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(agree(_bytes(a), _bytes(b)))


def verified(percent: int):
    def confirm(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out)

    return confirm


def full_sets(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for _, block in text_blocks([canonical(t).lower() for t in texts], TEXT_BYTES):
        rows += [(xxh3_128_digest(t), items.tobytes()) for t, items in zip(block, shingle_sets(block), strict=True)]
    return pd.DataFrame(rows, columns=["class", "items"])


def cell_pairs(least: int):
    """Pairs of a cell's seekers and members whose labels differ and whose sketches agree often enough, in the first band they share.

    The rows come sorted by (bucket, x, y): a cell is a block of seekers, members outside the bucket's largest label, against a block
    of members. Two seekers meet twice, so only the smaller one's seeking counts.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = batch[["bucket", "x", "y"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            rest = batch.iloc[last:].reset_index(drop=True)
            if last:
                yield from found(batch.iloc[:last])
        if rest is not None and len(rest):
            yield from found(rest)

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = rows[["bucket", "x", "y"]].to_numpy()
        nodes, label, sketches = rows["node"].to_numpy(), rows["label"].to_numpy(), _bytes(rows["sketch"])
        seeks, sought = rows["seeks"].to_numpy(bool), rows["minor"].to_numpy(bool)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        for lo, hi in zip(start, np.append(start[1:], len(rows)), strict=True):
            own = np.arange(lo, hi)
            left, right = own[seeks[lo:hi]], own[~seeks[lo:hi]]
            step = max(1, 50_000 // max(1, len(right)))
            for k in range(0, len(left), step):
                i, j = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
                keep = (label[i] != label[j]) & (~sought[j] | (nodes[i] < nodes[j]))
                i, j = i[keep], j[keep]
                near = agree(sketches[i], sketches[j]) >= least
                i, j = i[near], j[near]
                if len(i):
                    # of the bands that the pair shares, only the first sends it
                    same = (sketches[i, : BANDS * ROWS] == sketches[j, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                    first = same.argmax(axis=1) == key[lo, 0] >> (8 * ROWS)
                    i, j = i[first], j[first]
                if len(i):
                    yield pd.DataFrame({"a": np.minimum(nodes[i], nodes[j]), "b": np.maximum(nodes[i], nodes[j])})

    return pairs


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b); component is the smallest id that is reachable.

    Alternating large and small stars; each step is a sum per node and a join, ends in a written table, and repeats until
    every edge points at a root.
    """
    edges = scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("u"), F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every smaller neighbour and the node itself point at the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        smaller = large.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.col("a").alias("y"))
        smaller = smaller.union(low.select(F.col("m").alias("x"), F.col("u").alias("y"))).where("x <> y")
        before, edges = edges, scratch(smaller.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "stars")
        discard(before)
        roots = edges.select(F.col("a").alias("r")).distinct()
        if edges.join(roots, F.col("b") == F.col("r"), "left_semi").isEmpty() and edges.count() == edges.select("b").distinct().count():
            break
    out = scratch(edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots.select("r", F.col("r"))), "components")
    discard(edges)
    return out


def with_payloads(pairs: DataFrame, table: DataFrame, payload: str, tables: list) -> DataFrame:
    """Pairs (a, b), written, with the payloads of both nodes added as _a and _b.

    A node of many partners has its payload repeated once per PARTNERS of them, and they are dealt out over these copies, so no task
    holds one node's partners all.
    """
    ends = pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node")))
    hot = ends.groupBy("_node").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_copies")).where("_copies > 1")
    hot = small(scratch(hot, "near-hot", tables))
    own = table.select("node", payload).join(hot, F.col("node") == F.col("_node"), "left")
    own = own.select("node", payload, F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("_copy"))
    for end in ("a", "b"):
        dealt = pairs.join(hot, F.col(end) == F.col("_node"), "left")
        dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_node", "_copies")
        pairs = dealt.join(own.withColumnRenamed(payload, f"_{end}"), (F.col(end) == F.col("node")) & (F.col("_salt") == F.col("_copy"))).drop("node", "_copy", "_salt")
    return pairs


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per row of docs with an id: id, sign (64 bits of the raw text), class, n_shingles, component_id, component_class.

    class is 128 bits of the lower-cased word sequence, null without words. component_id is the smallest id of the component's rows
    and component_class the class of its rows that stays when one does: the first of those that hold that id.
    """
    bounded_batches(docs.sparkSession)
    tables: list[DataFrame] = []
    # sets are compared by 64-bit hashes of their shingles: two shingles of one pair collide with a chance below 1e-12
    signed = F.pandas_udf(sign, SIGNED)(F.col(text))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("sign"), F.col(text).alias("text"))
    base = scratch(texts.select("id", "sign", signed.alias("s")).select("id", "sign", "s.*"), "near-signed")
    # rows of a class have one sketch, so any of them does; once written, the numbers are fixed
    heads = base.where("n_shingles > 0").groupBy("class").agg(F.min("id").alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands"))
    heads = scratch(heads.withColumn("node", F.monotonically_increasing_id()), "near-heads", tables)
    base = base.drop("sketch", "bands")
    least = least_agreement(percent / 100)
    keys = heads.select("node", F.explode("bands").alias("bucket"))
    full = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = scratch(keys.join(full, "bucket"), "near-members", tables)
    company = scratch(members.groupBy("node").agg(F.sum("m").alias("company")), "near-company", tables)
    named = members.select("bucket", "node").join(company, "node")
    centre = named.groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre"))
    tried = named.join(centre, "bucket").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    tried = scratch(tried, "near-tried", tables)
    both = with_payloads(tried, heads, "sketch", tables)
    near = both.select("a", "b", F.pandas_udf(estimates, "int").asNondeterministic()("_a", "_b").alias("n")).where(F.col("n") >= least)
    best = Window.partitionBy("a").orderBy(F.desc("n"), "b")  # of the bands of one text: at most BANDS rows
    near = near.withColumn("_r", F.row_number().over(best)).where("_r <= 2").select("a", "b")
    wanted = company.join(heads.select("node", "class", "rep"), "node").select("node", F.col("class").alias("_class"), "rep")
    wanted = small(scratch(wanted, "near-wanted", tables), BROADCAST_CLASSES)
    picked = texts.join(wanted.select("rep"), F.col("id") == F.col("rep"), "left_semi")
    # a filter on what it tells must not be pushed below the pick
    told = F.pandas_udf(full_sets, "class binary, items binary").asNondeterministic()
    picked = picked.select(told("text").alias("s")).select("s.*")
    sets = scratch(picked.join(wanted, F.col("class") == F.col("_class")).select("node", "items").dropDuplicates(["node"]), "near-sets", tables)
    confirm = F.pandas_udf(verified(percent), "boolean")

    def proved(pairs: DataFrame, label: str) -> DataFrame:
        pairs = scratch(pairs, "near-pairs", tables)
        both = with_payloads(pairs, sets, "items", tables)
        return scratch(both.where(confirm("_a", "_b")).select("a", "b"), label, tables)

    stars = proved(near, "near-stars")
    label = components(stars).withColumnsRenamed({"id": "node", "component": "label"})
    tied = scratch(members.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "near-tied", tables)
    sizes = tied.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("bucket").agg(F.sum("n").alias("m"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    split = scratch(split.select("bucket", F.col("top.label").alias("major"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("int").alias("x_n"), F.ceil(F.col("m") / BLOCK).cast("int").alias("y_n")), "near-split", tables)
    opened = tied.join(small(split), "bucket").withColumn("minor", F.col("label") != F.col("major"))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    seekers = opened.where("minor").withColumn("x", dealt("x_n")).withColumn("y", F.explode(upto("y_n"))).withColumn("seeks", F.lit(True))
    sought = opened.withColumn("y", dealt("y_n")).withColumn("x", F.explode(upto("x_n"))).withColumn("seeks", F.lit(False))
    cells = seekers.unionByName(sought).join(heads.select("node", "sketch"), "node").select("bucket", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "seeks", "minor", "node", "label", "sketch")
    cells = cells.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    rest = cells.mapInPandas(cell_pairs(least), "a long, b long")
    links = stars.unionByName(proved(rest, "near-rest"))
    groups = components(links).withColumnsRenamed({"id": "node"})
    named = heads.select("node", "class", "rep").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the smallest id of a component, and of the classes that hold it the first
    first = named.groupBy("component").agg(F.min(F.struct("rep", "class")).alias("f"))
    named = named.join(first, "component").select("class", F.col("f.rep").alias("component_id"), F.col("f.class").alias("component_class"))
    named = scratch(named, "near-named")
    discard(*tables)
    out = base.join(small(named, BROADCAST_CLASSES), "class", "left")
    return out.select("id", "sign", "class", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), "component_class")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """Per row of docs with an id: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of lower-cased (A-Z) five-word shingles;
    fewer words are one shingle. Null, empty and blank texts have empty sets and are linked with nothing. Rows with a
    null id are left out. Repeated rows of one id with one text give equal rows; rows of one id with different texts are nodes of
    their own, each with its own links. An empty table gives an empty result.
    """
    out = classes(docs, doc_id, text, percent)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs of which each group of near copies keeps one: its smallest id, and of that id's texts one.

    A row stays if its id and text are those of its group; rows that repeat both are one. Rows without an id and rows
    without words are in no group and stay. Columns are as they were.
    """
    judged = classes(docs, doc_id, text, percent)
    stays = judged.where("class is not null and id = component_id and class = component_class")
    # of one class's texts under one id, which differ in case or white space only, the first sign stays; most are one row
    stays = stays.groupBy("id", "class").agg(F.min("sign").alias("sign"), F.count(F.lit(1)).alias("rows"))
    stays = scratch(stays, "near-stays")
    name = Names(docs)
    grouped = F.col(doc_id).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(grouped).withColumns({name("id"): F.col(doc_id).cast("long"), name("sign"): F.xxhash64(F.col(text))})

    def matching(side: DataFrame) -> DataFrame:
        return own.join(small(side.select(F.col("id").alias(name("id")), F.col("sign").alias(name("sign"))), BROADCAST_CLASSES), [name("id"), name("sign")], "left_semi")

    once = matching(stays.where("rows = 1"))
    again = stays.where("rows > 1")
    if not again.isEmpty():
        once = once.unionByName(matching(again).dropDuplicates([name("id"), name("sign")]))
    return once.select(docs.columns).unionByName(docs.where(~grouped))
