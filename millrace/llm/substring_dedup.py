"""Substring dedup with a count-min prefilter.

A window is sketched by its run: the smallest hash of ROUTE words in a row within it, which equal windows share and neighbours
mostly share too, so there are a tenth as many runs as windows. Pass 1: every task counts the documents of each run in a
count-min sketch, cut into pieces by a hash of the run, each with DEPTH rows of cells; the pieces are merged where they are, whatever
their number, and answer each document with its runs whose cells hold two documents or more in every row. Merged counts never
underestimate, so no repeated window is lost, and cells grow with the windows, so the share that is passed on by chance stays the same
at any size. Pass 2: only windows of
such runs go on; each task keeps, per window, its smallest document and settles the others itself, so that a window of any number of
copies sends one row per task; what goes on is grouped exactly by 128 bits. Windows of a run travel together.
Pass 3 removes the covered words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Names, Rolling, bounded_batches, canonical, mix, scratch, text_blocks, word_bounds

WINDOW = 50
DEPTH = 2
#: Cells in a row of the sketch per run that is expected, at least, so that a run passes by chance at (1 - exp(-1/8))**2, 1.4 %, at most.
CELLS_PER_RUN = 8
#: Cells in a row of a piece; one task holds a piece at a time.
PIECE = 1 << 22
#: Windows, and candidates, that a task holds before it sends what it has.
HOLD, HOLD_CANDIDATES = 2_000_000, 500_000
ROUTE = 25

_FIRST, _SECOND = Rolling(501), Rolling(502)
_ROWS = mix(np.arange(71, 72 + DEPTH, dtype=np.uint64))


class Windows:
    """The windows of a block of documents: document number, first word, two hashes, route."""

    def __init__(self, texts: list[bytes], k: int) -> None:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        start, end = word_bounds(data)
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        self.word = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        n = max(len(doc) - k + 1, 0)
        self.at = np.flatnonzero(doc[:n] == doc[len(doc) - n :])
        self.doc, self.start, self.end, self.data, self.k = doc, start, end, data, k
        self.key = _FIRST.ranges(_FIRST.sums(data), start[self.at], end[self.at + k - 1])

    def second(self, pick: np.ndarray) -> np.ndarray:
        at = self.at[pick]
        return _SECOND.ranges(_SECOND.sums(self.data), self.start[at], self.end[at + self.k - 1])

    def route(self) -> np.ndarray:
        """The smallest hash of ROUTE words in a row within each window: the same for equal windows, and for most neighbours."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        w = min(ROUTE, self.k)
        low = _SECOND.ranges(_SECOND.sums(self.data), self.start[: len(self.start) - w + 1], self.end[w - 1 :])
        span, have = self.k - w + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        return np.minimum(low[self.at], low[self.at + span - have])


def cells(run: np.ndarray, row: int, step: int) -> np.ndarray:
    """The cell of each run in a row of its piece; step is a power of two."""
    return (mix(run ^ _ROWS[row]) & np.uint64(step - 1)).astype(np.int64)


def piece_of(run: np.ndarray, pieces: int) -> np.ndarray:
    return (mix(run ^ _ROWS[DEPTH]) % np.uint64(pieces)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as differences, byte planes apart, deflated."""
    d = np.diff(numbers, prepend=0).astype("<i4")
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


PIECES = "piece long, first binary, second binary, owners binary, ids array<long>, signs array<long>, more binary"


def sketch_pieces(k: int, width: int):
    """Of each task's documents, by piece of the sketch: the cells of runs of one own document, with that document, and of runs of several.

    A task's several documents of one run know that it is repeated: the run counts twice by `more`, and an answer goes to each of
    them as a row of its own (piece null, the run's place in `first`).
    """
    step = min(PIECE, width)
    total = width // step

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, owner, ids, signs, n = [], [], [], [], 0
        for batch in batches:
            i64, s64 = batch["id"].to_numpy(np.int64), batch["sign"].to_numpy(np.int64)
            for first, block in text_blocks([canonical(t) for t in batch["text"]]):
                w = Windows(block, k)
                route, doc = w.route(), w.doc[w.at]
                new = np.flatnonzero(np.concatenate(([True], (route[1:] != route[:-1]) | (doc[1:] != doc[:-1])))[: len(route)])
                runs.append(route[new])
                owner.append(doc[new] + sum(map(len, ids)))
                ids.append(i64[first : first + len(block)])
                signs.append(s64[first : first + len(block)])
                n += len(route)
                if n >= HOLD:
                    yield from sent(np.concatenate(runs), np.concatenate(owner), np.concatenate(ids), np.concatenate(signs))
                    runs, owner, ids, signs, n = [], [], [], [], 0
        if n:
            yield from sent(np.concatenate(runs), np.concatenate(owner), np.concatenate(ids), np.concatenate(signs))

    def sent(run: np.ndarray, owner: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.lexsort((owner, run))
        run, owner = run[order], owner[order]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])))
        run, owner = run[new], owner[new]
        # rows of one id don't precede one another, but counting them apart only overestimates
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.append(first, len(run)))
        several = np.repeat(size > 1, size)
        piece, cell = piece_of(run, total), cells(run, 0, step)
        out = []
        if several.any():
            place, own = (piece * step + cell)[several], owner[several]
            at = np.lexsort((place, own))
            docs, start = np.unique(own[at], return_index=True)
            out += [(None, x.astype("<i8").tobytes(), None, None, [ids[d]], [signs[d]], None) for d, x in zip(docs, np.split(place[at], start[1:]), strict=True)]
        once, lead = np.flatnonzero(~several), first[several[first]]
        once, lead = once[np.lexsort((cell[once], piece[once]))], lead[np.lexsort((cell[lead], piece[lead]))]
        pieces = np.unique(piece)
        bounds = lambda at: zip(np.searchsorted(piece[at], pieces), np.searchsorted(piece[at], pieces, "right"), strict=True)
        for p, (a, b), (c, d) in zip(pieces, bounds(once), bounds(lead), strict=True):
            docs, local = np.unique(owner[once[a:b]], return_inverse=True)
            more = np.concatenate((cell[lead[c:d]], cells(run[lead[c:d]], 1, step)))
            out.append((int(p), _pack(cell[once[a:b]]), _pack(cells(run[once[a:b]], 1, step)), _pack(local), ids[docs], signs[docs], _pack(more)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])

    return pieces


REPLIES = "id long, sign long, cells binary"


def merged_pieces(width: int):
    """Rows of PIECES sorted by piece to REPLIES: to each document the places of its runs whose merged count is two or more."""
    step = min(PIECE, width)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, held, count = None, [], None
        for batch in batches:
            told = batch[batch["piece"].isna()]
            if len(told):
                yield pd.DataFrame({"id": [x[0] for x in told["ids"]], "sign": [x[0] for x in told["signs"]], "cells": list(told["first"])})
            for row in batch[batch["piece"].notna()].itertuples(index=False):
                if row.piece != piece:
                    if held:
                        yield from answered(int(piece), held, count)
                    piece, held, count = row.piece, [], [np.zeros(step, np.uint8) for _ in range(DEPTH)]
                more = np.split(_unpack(row.more), DEPTH)
                for n, x, m in zip(count, (_unpack(row.first), _unpack(row.second)), more, strict=True):
                    x, seen = np.unique(x, return_counts=True)
                    n[x] = np.minimum(n[x] + seen, 2)
                    n[m] = 2
                held.append((row.first, row.second, row.owners, row.ids, row.signs))
        if held:
            yield from answered(int(piece), held, count)

    def answered(piece: int, held: list, count: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        out = []
        for first, second, owners, ids, signs in held:
            x, own = _unpack(first), _unpack(owners)
            hit = np.flatnonzero((count[0][x] > 1) & (count[1][_unpack(second)] > 1))
            if len(hit):
                hit = hit[np.argsort(own[hit], kind="stable")]
                docs, start = np.unique(own[hit], return_index=True)
                for d, c in zip(docs, np.split(x[hit] + piece * step, start[1:]), strict=True):
                    out.append((ids[d], signs[d], c.astype("<i8").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["id", "sign", "cells"])

    return merge


def estimated(w: Windows, replies: list, width: int) -> np.ndarray:
    """Numbers of the windows whose run's place is among the replies to their document."""
    step = min(PIECE, width)
    route, doc = w.route(), w.doc[w.at]
    if not len(route):
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], (route[1:] != route[:-1]) | (doc[1:] != doc[:-1])))
    run, owner = route[new], doc[new]
    place = piece_of(run, width // step) * step + cells(run, 0, step)
    passed = np.zeros(len(run), bool)
    bounds = np.searchsorted(owner, np.arange(len(replies) + 1))
    for d, parts in enumerate(replies):
        a, b = bounds[d], bounds[d + 1]
        if a < b and len(parts):
            passed[a:b] = np.isin(place[a:b], np.frombuffer(b"".join(parts), "<i8"))
    return np.flatnonzero(passed[np.cumsum(new) - 1])


def runs(starts: np.ndarray) -> bytes:
    """Ascending window starts as (first, length) pairs of 32-bit numbers."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) != 1)))
    return np.column_stack((starts[new], np.diff(np.append(new, len(starts))))).astype("<u4").tobytes()


FIELDS = [("key", "<u8"), ("second", "<u8"), ("doc", "<u4"), ("start", "<u4")]
CANDIDATES = "bucket int, n int, entries binary, ids array<long>, signs array<long>, done_ids array<long>, done_signs array<long>, done_runs array<binary>"


def candidates(k: int, buckets: int, width: int):
    """Rows as CANDIDATES: the windows to group in a bucket, and the runs of windows that this task has settled."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, signs, n = [], [], [], 0
        for batch in batches:
            i64, s64, told = batch["id"].to_numpy(np.int64), batch["sign"].to_numpy(np.int64), list(batch["cells"])
            for first, block in text_blocks([canonical(t) for t in batch["text"]]):
                w = Windows(block, k)
                own = estimated(w, told[first : first + len(block)], width)
                if len(own):
                    rows = np.zeros(len(own), FIELDS)
                    rows["key"], rows["second"] = w.key[own], w.second(own)
                    rows["doc"] = w.doc[w.at[own]] + sum(map(len, ids))
                    rows["start"] = w.word[w.at[own]]
                    held.append((rows, (w.route()[own] % np.uint64(buckets)).astype(np.int32)))
                    n += len(own)
                ids.append(i64[first : first + len(block)])
                signs.append(s64[first : first + len(block)])
                if n >= HOLD_CANDIDATES:
                    yield sent(held, np.concatenate(ids), np.concatenate(signs))
                    held, ids, signs, n = [], [], [], 0
        if n:
            yield sent(held, np.concatenate(ids), np.concatenate(signs))

    def sent(held, ids, signs) -> pd.DataFrame:
        rows, bucket = np.concatenate([x for x, _ in held]), np.concatenate([b for _, b in held])
        order = np.lexsort((rows["start"], ids[rows["doc"]], rows["second"], rows["key"]))
        rows, bucket = rows[order], bucket[order]
        low = least(rows, ids)
        settled = ids[rows["doc"]] > low
        out = []
        gone = rows[settled]
        if len(gone):
            # what is settled goes the same way, dealt out by task and not by window
            out.append((int(mix(rows["key"][:1])[0] % np.uint64(buckets)), 0, None, None, None, *by_document(gone, ids, signs)))
        rows, bucket = rows[~settled], bucket[~settled]
        order = np.lexsort((rows["start"], rows["doc"], bucket))
        rows, bucket = rows[order], bucket[order]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(start, np.append(start[1:], len(rows)), strict=True):
            own = rows[a:b].copy()
            docs, own["doc"] = np.unique(own["doc"], return_inverse=True)
            planes = b"".join(own[f].tobytes() for f, _ in FIELDS[:2]) + zlib.compress(b"".join(np.ascontiguousarray(np.diff(own[f].astype(np.int64), prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for f, _ in FIELDS[2:]), 1)
            out.append((int(bucket[a]), len(own), planes, ids[docs], signs[docs], None, None, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CANDIDATES.split(", ")])

    return pick


def least(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per row, sorted by window and document, the smallest document id of its window."""
    new = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["second"][1:] != rows["second"][:-1])))
    return ids[rows["doc"]][np.flatnonzero(new)][np.cumsum(new) - 1]


def by_document(rows: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> tuple[list, list, list]:
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    start = np.flatnonzero(np.concatenate(([True], rows["doc"][1:] != rows["doc"][:-1])))
    parts = [runs(rows["start"][a:b].astype(np.int64)) for a, b in zip(start, np.append(start[1:], len(rows)), strict=True)]
    return ids[rows["doc"][start]].tolist(), signs[rows["doc"][start]].tolist(), parts


def entries(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, FIELDS)
    out["key"], out["second"] = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u8", n, 8 * n)
    planes = np.frombuffer(zlib.decompress(data[16 * n :]), np.uint8).reshape(2, 4, n)
    for f, plane in zip(("doc", "start"), planes, strict=True):
        out[f] = np.cumsum(np.ascontiguousarray(plane.T).view("<i4").ravel(), dtype=np.int64)
    return out


SETTLED = "id long, sign long, runs binary"


def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of CANDIDATES sorted by bucket to (id, sign, runs): window starts that a smaller document has too."""
    names = [x.split()[0] for x in SETTLED.split(", ")]
    bucket, held = None, []

    def grouped() -> Iterator[pd.DataFrame]:
        parts, ids, signs, n = [], [], [], 0
        for rows, i, s in held:
            rows["doc"] += n
            n += len(i)
            parts.append(rows)
            ids.append(i)
            signs.append(s)
        rows, ids, signs = np.concatenate(parts), np.concatenate(ids), np.concatenate(signs)
        rows = rows[np.lexsort((ids[rows["doc"]], rows["second"], rows["key"]))]
        rows = rows[ids[rows["doc"]] > least(rows, ids)]
        if len(rows):
            yield pd.DataFrame(dict(zip(names, by_document(rows, ids, signs), strict=True)))

    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.bucket != bucket:
                if held:
                    yield from grouped()
                bucket, held = row.bucket, []
            if row.done_ids is not None:
                yield pd.DataFrame({"id": row.done_ids, "sign": row.done_signs, "runs": row.done_runs})
            if row.entries is not None:
                held.append((entries(row.entries, row.n), np.asarray(row.ids, np.int64), np.asarray(row.signs, np.int64)))
    if held:
        yield from grouped()


KEPT = "n_words long, n_removed long, kept_text string, kept_sha256 string"


def strip(k: int):
    def stripped(text: pd.Series, run: pd.Series) -> pd.DataFrame:
        out = []
        for t, parts in zip(text, run, strict=True):
            words = canonical(t).split()
            n = len(words)
            if parts is not None and len(parts):
                cover = np.zeros(n + 1, np.int32)
                for part in parts:
                    pairs = np.frombuffer(part, "<u4").reshape(-1, 2).astype(np.int64)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 0] + pairs[:, 1] + k - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
            kept = b" ".join(words)
            out.append((n, n - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in KEPT.split(", ")])

    return stripped


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row with `repeats`: struct<n_words, n_removed, kept_text, kept_sha256> added.

    A word goes if a window of `window` consecutive words covers it whose words also start somewhere in a document with a
    smaller id; windows are judged on the input. Null and empty texts have no words. Rows with a null id are
    kept whole and count as nobody's predecessor. Rows that share an id don't precede one another; each is
    judged by its own text. An empty table gives an empty result. A column `repeats` of the input is replaced.
    """
    bounded_batches(docs.sparkSession)
    name, sign = Names(docs), F.xxhash64(F.col(text))
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), sign.alias("sign"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    guess = max(1, size // 6)  # windows, from the bytes of text
    per_run = max(1, (window - min(ROUTE, window) + 2) // 2)  # windows that share their smallest hash, on average
    width = max(1 << 10, 1 << (CELLS_PER_RUN * guess // per_run - 1).bit_length())
    pieces = texts.mapInPandas(sketch_pieces(window, width), PIECES)
    # rows without a piece are answers already; they are dealt by document
    dealt = pieces.repartition(F.coalesce("piece", F.xxhash64("ids", "signs"))).sortWithinPartitions("piece")
    replies = dealt.mapInPandas(merged_pieces(width), REPLIES).groupBy("id", "sign").agg(F.collect_list("cells").alias("cells"))
    buckets = max(16, guess // 1_000_000)
    # by shuffle at every size, as answers grow with the texts
    sent = texts.join(replies.hint("merge"), ["id", "sign"]).mapInPandas(candidates(window, buckets, width), CANDIDATES)
    settled = sent.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(settle, SETTLED)
    found = settled.groupBy("id", "sign").agg(F.collect_list("runs").alias("runs"))
    found = scratch(found.select(F.col("id").alias(name("id")), F.col("sign").alias(name("sign")), F.col("runs").alias(name("runs"))), "repeats")
    # as above: what was found grows with the texts
    out = docs.drop("repeats").join(found.hint("merge"), (F.col(doc_id).cast("long") == F.col(name("id"))) & (sign == F.col(name("sign"))), "left")
    return out.withColumn("repeats", F.pandas_udf(strip(window), KEPT)(F.col(text), F.col(name("runs")))).drop(name("id"), name("sign"), name("runs"))
