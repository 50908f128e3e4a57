"""Sinks: JSON lines with sorted keys, one JSON document, logs, CSV queues, outputs by state, manifests, packages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import file_system


def json_line(df: DataFrame) -> Column:
    """A row as JSON, its keys sorted, nulls written."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False, mode: str = "overwrite") -> None:
    """A line per row. `order` sorts within files; `one_file` is for small tables that must be one file."""
    lines = df.select(json_line(df).alias("value"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])])
    if one_file:
        lines = lines.coalesce(1)
    if order:
        lines = lines.sortWithinPartitions(*[f"_o{k}" for k in range(len(order))])
    lines.select("value").write.mode(mode).text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def write_document(df: DataFrame, path: str) -> str:
    """The one row of a report as an indented JSON document with sorted keys; more rows are an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    body = json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
    fs, p = file_system(df.sparkSession, path)
    out = fs.create(p, True)
    out.write(bytearray(body, "utf-8"))
    out.close()
    return body


def write_queue(df: DataFrame, path: str, fields: list[str], default: str = "pending") -> None:
    """A review queue: a header, the fields in their order, `default` where a field is null or missing; all values quoted, lists joined by |."""
    def value(c: str) -> Column:
        kind = dict(df.dtypes).get(c)
        if kind is None:
            return F.lit(default).alias(c)
        return F.coalesce(F.array_join(c, "|") if kind.startswith("array") else F.col(c).cast("string"), F.lit(default)).alias(c)

    df.select(*map(value, fields)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_states(df: DataFrame, path: str, state: str) -> None:
    """All states in one pass, a folder for each."""
    df.write.mode("overwrite").partitionBy(state).json(path)


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(artifact, file, bytes, sha256) of every part file of the artifacts; hashes are taken by the executors."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
        rows = files.select(F.lit(name).alias("artifact"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


def copy_package(spark: SparkSession, files: dict[str, str], target: str) -> DataFrame:
    """Copy the required files into a package and hash them; raises if one is missing."""
    missing = [p for p in files.values() if not (lambda f: f[0].exists(f[1]))(file_system(spark, p))]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name, path in files.items():
        (source, a), (to, b) = file_system(spark, path), file_system(spark, f"{target}/{name}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source, a, to, b, False, conf)
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(target)
    return packed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
