"""Scans: JSON lines lenient and strict, with provenance, JSON documents, files by system, bytes to text, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import text as T
from millrace.sources.shared import exists, file_system


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _parsed(lines: DataFrame, schema: StructType | str, keep: list[str]) -> DataFrame:
    row = F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_row")
    return lines.select(*keep, row).select(*keep, "_row.*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """Blank lines are skipped and bad JSON raises. A missing file raises too; where `missing_ok`, it has no rows."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _parsed(_lines(spark, path), schema, [])


def read_jsonl_with_provenance(spark: SparkSession, path: str, schema: StructType | str, texts: tuple[str, ...] = ("text", "content", "chunk_text", "raw_text")) -> DataFrame:
    """The rows with `_source_file`, `_line_no` (from 1, blank lines counted) and the first non-empty of the text fields as `text`.

    Lines of a file's block are numbered as they are read; the lines of the blocks before it are a sum over one row per
    block, so a file of any size is numbered without passing through one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    from pyspark.sql import Window

    blocks = raw.groupBy("_source_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_source_file", "_block", "_first", before.alias("_before"))
    numbered = raw.join(F.broadcast(blocks), ["_source_file", "_block"]).withColumn("_line_no", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    rows = _parsed(numbered.where(F.trim("value") != ""), schema, ["_source_file", "_line_no"])
    return rows.withColumn("text", pick_text([F.col(c) for c in texts if c in rows.columns]))


def pick_text(fields: list[Column]) -> Column:
    """The first field that isn't blank, trimmed; null if all are."""
    return F.coalesce(*[F.when(F.trim(f) != "", F.trim(f)) for f in fields], F.lit(None).cast("string"))


def read_json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One row: the object that the whole file is."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def find_file(spark: SparkSession, explicit: str | None, roots: list[str], name: str) -> str:
    """The explicit path if it is there, else the first file of that name under the roots in order, then by path; raises if there is none."""
    if explicit and exists(spark, explicit):
        return explicit
    for root in roots:
        fs, p = file_system(spark, root)
        if not fs.exists(p):
            continue
        found, files = [], fs.listFiles(p, True)
        while files.hasNext():
            at = files.next().getPath()
            if at.getName() == name:
                found.append(at.toString())
        if found:
            return min(found)
    raise FileNotFoundError(name)


def read_by_system(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """The rows of one file per system with `system`; raises if a file is missing."""
    missing = [s for s, p in paths.items() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    out = None
    for system, path in paths.items():
        rows = read_jsonl(spark, path, schema).withColumn("system", F.lit(system))
        out = rows if out is None else out.unionByName(rows)
    return out


def content_type(path: Column) -> Column:
    lower = F.lower(F.regexp_replace(path, r"\?.*$", ""))
    return F.when(lower.endswith(".pdf"), "application/pdf").when(lower.rlike(r"\.html?$"), "text/html").otherwise("text/plain")


def raw_filename(source_id: Column, url: Column) -> Column:
    """The source's id with the suffix of the url's path: .pdf, .txt or else .html."""
    path = F.lower(F.substring_index(url, "?", 1))
    return F.concat(source_id, F.when(path.endswith(".pdf"), ".pdf").when(path.endswith(".txt"), ".txt").otherwise(".html"))


def decode_bytes(data: Column) -> Column:
    """UTF-8, else UTF-16 (by its mark, else little-endian), else Latin-1, the first that the bytes are valid in."""
    mark = F.hex(F.substring(data, 1, 2))
    wide = F.when(mark.isin("FEFF", "FFFE"), F.decode(data, "UTF-16")).otherwise(F.decode(data, "UTF-16LE"))
    fits = (F.octet_length(data) % 2 == 0) & ~F.contains(wide, F.lit("�"))
    return F.coalesce(F.try_validate_utf8(data), F.when(fits, wide), F.decode(data, "ISO-8859-1"))


def extract_text(decoded: Column, kind: Column, path: Column, ended: bool = False) -> Column:
    """HTML by its type, suffix or an <html in its first 500 characters is taken as text, everything else is as it is; `ended` as in unescape."""
    page = F.contains(kind, F.lit("html")) | F.lower(path).rlike(r"\.html?$") | F.contains(F.lower(F.substring(decoded, 1, 500)), F.lit("<html"))
    return F.when(page, T.html_to_text(decoded, ended)).otherwise(decoded)


def save_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vector array<float>").parquet(path)
