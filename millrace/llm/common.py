"""Helpers that the operators share: written tables, size-checked broadcasts, byte hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows (a few dozen bytes each) and shuffled beyond.
BROADCAST_ROWS = 200_000
#: Bytes of text that one numpy pass holds at a time; a longer document is a pass of its own.
BLOCK_BYTES = 1_000_000

BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't depend on the table; workers that need less cut a batch themselves."""
    for k, v in BATCH_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(df: DataFrame, label: str, own: list | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there and survives lost executors.

    `own` collects tables that only later steps of one operator read, to discard them in the end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    if own is not None:
        own.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of scratch that nothing reads any more; what is still read stays for the cluster's own clean-up of the folder."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._millrace_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that has been written, marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def small_join(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that has been written: broadcast it if it has at most `rows` rows, else let Spark shuffle both."""
    return df.join(small(side, rows), on, how)


class Names:
    """Working column names that no input column has, whatever its case."""

    def __init__(self, *tables: DataFrame) -> None:
        taken, self.prefix = {c.lower() for t in tables for c in t.columns}, "_mr"
        while any(c.startswith(self.prefix) for c in taken):
            self.prefix += "_"

    def __call__(self, name: str) -> str:
        return f"{self.prefix}_{name}"


# ---------------------------------------------------------------- bytes and hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _GOLD
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def canonical(text: str | None) -> bytes:
    """The words `[^\\x20\\x09-\\x0D]+` in UTF-8, joined by one space; null has none."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


class Rolling:
    """Hashes of any byte range out of one running sum: (S[e] - S[s]) * M**-s, then mixed."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.mult = int(rng.integers(0, 2**63)) * 8 + 5 & (2**64 - 1)
        self.inverse = pow(self.mult, -1, 2**64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            for name, base in (("_up", self.mult), ("_down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self._up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self._down[start])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of canonical texts joined by line feeds."""
    gaps = np.flatnonzero((data == 32) | (data == 10))
    start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    full = end > start
    return start[full], end[full]


def text_blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `limit` bytes together, each with the index of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]
