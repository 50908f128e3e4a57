"""Benchmark decontamination with an FM-index per shard of the training text.

A shard is a run of up to SHARD_ROWS documents. Words that no benchmark item holds can't be part of an occurrence, so the
shard's text is the runs of benchmark words that are long enough for a window, one separator between runs; that
loses nothing and keeps the index small. Test phrases are found by backward search over wavelet ranks of the
Burrows-Wheeler transform, all phrases at once; occurrences are located by walking back to sampled suffix positions; the
word spans they cover are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Names, bounded_batches, scratch

WINDOW = 10
SAMPLE = 8
#: Documents of a shard, at most.
SHARD_ROWS = 1000
#: Bytes of benchmark text that go to the executors at once; a larger benchmark is searched in blocks.
ITEM_BYTES = 8_000_000
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
LEAK = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Wavelet:
    """A wavelet matrix: one bit per symbol and level, stored as running counts."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.shifts, self.counts, self.zeros = range(levels - 1, -1, -1), [], []
        for shift in self.shifts:
            bit = (symbols >> shift) & 1
            count = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.counts.append(count)
            self.zeros.append(len(symbols) - int(count[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, count, zeros in zip(self.shifts, self.counts, self.zeros, strict=True):
            ones = count[at]
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.descend(symbol, at) - self.descend(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for count, zeros in zip(self.counts, self.zeros, strict=True):
            ones = count[at]
            bit = count[at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a shorter suffix stands first."""
    n, k = len(text), 1
    rank = text.astype(np.int64) + 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] if k < n else ahead[:0]
        key = rank * (max(n, int(rank.max())) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) > 0)))
        if int(new.max()) == n or k >= n:
            return order
        rank, k = new, 2 * k


class FmIndex:
    """Backward search and location over a text of symbols in [1, size); 0 is the end marker."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        text = np.concatenate((text, [0])).astype(np.int64)
        order = suffix_array(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:-1]
        self.tree = Wavelet(text[order - 1], max(1, (size - 1).bit_length()))
        self.known = np.where(order % SAMPLE == 0, order, -1)
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each row of patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for symbol in patterns.T[::-1]:
            live = np.flatnonzero(lo < hi)
            c = symbol[live].astype(np.int64)
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.known[rows[todo]]
            out[todo[found >= 0]] = found[found >= 0] + steps
            todo = todo[found < 0]
            c = self.tree.access(rows[todo])
            rows[todo] = self.before[c] + self.tree.rank(c, rows[todo])
            steps += 1
        return out


class Vocabulary(dict):
    """Word numbers from 2; any other word is the separator 1."""

    def __missing__(self, word: bytes) -> int:
        return 1


class Phrases:
    """The windows of the benchmark items as rows of word numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.ids = sorted({i for i, _ in items if i is not None})
        number, self.vocabulary = {i: k for k, i in enumerate(self.ids)}, Vocabulary()
        held: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            k = min(window, len(row))
            for i in range(len(row) - k + 1 if k else 0):
                held.setdefault(tuple(row[i : i + k]), set()).update([number[item]] if item is not None else [])
        self.by_length: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for k in sorted({len(p) for p in held}):
            own = [p for p in held if len(p) == k]
            self.by_length[k] = np.array(own, np.int64), [np.array(sorted(held[p]), np.int64) for p in own]
        self.shortest = min(self.by_length, default=0)


def leaks(texts: list[str | None], phrases: Phrases) -> pd.DataFrame:
    """One row per text as LEAK says, spans merged, in order and disjoint."""
    split = [words(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))
    out = {"n_words": counts, "starts": [()] * len(texts), "ends": [()] * len(texts), "items": [()] * len(texts)}
    if phrases.by_length and first[-1]:
        get = phrases.vocabulary.__getitem__
        ids = np.concatenate([np.fromiter(map(get, w), np.int32, len(w)) for w in split])
        del split
        doc = np.repeat(np.arange(len(texts)), counts)
        # runs of benchmark words within one document
        known = ids > 1
        begins = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
        ends = known & np.concatenate((~known[1:] | (doc[1:] != doc[:-1]), [True]))
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        a, b = a[b - a >= phrases.shortest], b[b - a >= phrases.shortest]
        if len(a):
            size = b - a
            at = np.concatenate(([0], np.cumsum(size + 1)))
            place = np.full(int(at[-1]), -1, np.int64)  # the word that each symbol of the shard is
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            place[np.repeat(at[:-1], size) + inside] = np.repeat(a, size) + inside
            index = FmIndex(np.where(place >= 0, ids[place], 1), len(phrases.vocabulary) + 2)
            cover, pairs = np.zeros(len(ids) + 1, np.int32), []
            for k, (patterns, holders) in phrases.by_length.items():
                lo, hi = index.search(patterns)
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                n = hi[hit] - lo[hit]
                rows = np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                word = place[index.locate(rows)]
                np.add.at(cover, word, 1)
                np.add.at(cover, word + k, -1)
                for p, docs in zip(hit, np.split(doc[word], np.cumsum(n)[:-1]), strict=True):
                    docs = np.unique(docs)
                    pairs.append(np.column_stack((np.repeat(docs, len(holders[p])), np.tile(holders[p], len(docs)))))
            # a run never leaves its document, so neither does a span; documents are cut apart all the same
            covered = np.cumsum(cover[:-1]) > 0
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            s = np.flatnonzero(covered & (np.concatenate(([True], ~covered[:-1])) | new))
            e = np.flatnonzero(covered & (np.concatenate((~covered[1:], [True])) | np.concatenate((new[1:], [True])))) + 1
            for d in np.unique(doc[s]):
                own = slice(*np.searchsorted(s, [first[d], first[d + 1]]))
                out["starts"][d], out["ends"][d] = (s[own] - first[d]).astype(np.int32), (e[own] - first[d]).astype(np.int32)
            if pairs and len(found := np.unique(np.concatenate(pairs), axis=0)):
                for d, rows in zip(*_groups(found[:, 0], found[:, 1]), strict=True):
                    out["items"][d] = [phrases.ids[i] for i in rows]
    return pd.DataFrame(out)


def _groups(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    own, at = np.unique(key, return_index=True)
    return own, np.split(value, at[1:])


def merged_spans(starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for s, e in zip(starts, ends, strict=True):
        spans: list[list[int]] = []
        for x, y in sorted(zip(s, e, strict=True)):
            if spans and x <= spans[-1][1]:
                spans[-1][1] = max(y, spans[-1][1])
            else:
                spans.append([x, y])
        out.append([{"start": int(x), "end": int(y)} for x, y in spans])
    return pd.Series(out)


def shards(batches: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    for batch in batches:
        for lo in range(0, len(batch), SHARD_ROWS):
            yield list(batch[lo : lo + SHARD_ROWS])


def searcher(held):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in shards(batches):
            yield leaks(texts, held.value)

    return F.pandas_udf(search, LEAK)


def cutter(held):
    """Search and cut in one worker: two functions in a row would hold two workers a task. Null where a text stays as it is."""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in shards(batches):
            found = leaks(texts, held.value)
            yield pd.Series([cut_spans(t, s, e) if len(s) else None for t, s, e in zip(texts, found["starts"], found["ends"], strict=True)], dtype=object)

    return F.pandas_udf(cut, "string")


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """The items as (i, t) and the number of blocks that they are searched in."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return items, -(-total // ITEM_BYTES) or 1


def held_phrases(items: DataFrame, window: int):
    return items.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in items.collect()], window))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add `leak`: struct<n_words, starts, ends, items> of each document; starts and ends are the merged word spans to remove.

    Null and empty texts have no words and no leaks; items without words, or with null text, match nothing. Items that share
    an id are one item; an item with a null id removes words but is not listed. An empty benchmark leaks nothing. Nothing is
    shuffled. A benchmark of more than ITEM_BYTES is searched in blocks, each a pass over the documents that writes the spans it finds,
    and the documents are joined with those once. A column `leak` of the input is replaced.
    """
    bounded_batches(docs.sparkSession)
    name = Names(docs)
    items, blocks = blocks_of(benchmark, item_id, item_text)
    out = docs.drop("leak")
    if blocks == 1:
        return out.withColumn("leak", searcher(held_phrases(items, window))(F.col(text)))
    # a pass per block leaves spans by text, not the texts, and these are merged by text in the end
    key = F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.col(text), F.lit(1)).alias("b"))
    parts = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        search = searcher(held_phrases(own, window)).asNondeterministic()
        found = docs.where(F.col(text).isNotNull()).select(key.alias("key"), search(F.col(text)).alias("leak"))
        found = scratch(found.where(F.size("leak.starts") > 0).dropDuplicates(["key"]), f"leaks{k}")
        parts = found if parts is None else parts.unionByName(found)
    merge = F.pandas_udf(merged_spans, "array<struct<start:int,end:int>>")
    both = parts.groupBy("key").agg(*(F.flatten(F.collect_list(f"leak.{c}")).alias(c) for c in ("starts", "ends", "items")))
    both = both.withColumn("spans", merge("starts", "ends")).select(F.col("key").alias(name("key")), F.col("spans.start").alias(name("starts")), F.col("spans.end").alias(name("ends")), F.array_distinct("items").alias(name("items")))
    out = out.join(scratch(both, "leaks"), key == F.col(name("key")), "left")
    counted = F.pandas_udf(_word_counts, "long")
    none = F.array()
    leak = F.struct(counted(F.col(text)).alias("n_words"), F.coalesce(name("starts"), none.cast("array<int>")).alias("starts"), F.coalesce(name("ends"), none.cast("array<int>")).alias("ends"), F.coalesce(name("items"), none.cast("array<string>")).alias("items"))
    return out.withColumn("leak", leak).drop(*(name(c) for c in ("key", "starts", "ends", "items")))


def _word_counts(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words(t)) for t in texts], dtype="int64")


def leak_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    hit = F.aggregate(F.zip_with("leak.starts", "leak.ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    out = found.select(F.col(doc_id).alias("doc_id"), F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut_spans(text: str | None, starts, ends) -> str | None:
    """The text without the words of the spans; what stands between kept words stays as it is."""
    if text is None or not len(starts):
        return text
    data = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(data.translate(_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[at : a[s]])
        at = int(b[e - 1])
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass").strip()


def removed(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, s, e) for t, s, e in zip(text, starts, ends, strict=True)])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the words of every occurrence removed from the text; documents without one are as they were."""
    items, blocks = blocks_of(benchmark, item_id, item_text)
    if blocks == 1:
        bounded_batches(docs.sparkSession)
        cut = cutter(held_phrases(items, window))
        return docs.drop("leak").withColumn(text, F.coalesce(cut(F.col(text)), F.col(text)))
    found = find_leaks(docs, benchmark, text, item_id, item_text, window)
    cut = F.when(F.size("leak.starts") > 0, F.pandas_udf(removed, "string")(F.col(text), F.col("leak.starts"), F.col("leak.ends"))).otherwise(F.col(text))
    return found.withColumn(text, cut).drop("leak")
