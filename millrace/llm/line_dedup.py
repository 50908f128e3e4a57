"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that contain it exceeds a ratio. Pages are
counted once per line however often the line repeats in them, and pages of equal text are one page, so that copies of an article
don't make its lines boilerplate. All of it is DataFrame code: what is shuffled are (host, line hash, page hash) and their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Names, scratch, small

#: Over one page in a hundred: in the given tables most lines that recur in a host lie between half a percent and 4 %.
RATIO = 0.01
#: So many pages at least, as in a small host a chance repeat is a large share.
MIN_PAGES = 5
#: Hosts with boilerplate that are broadcast (some KB each); beyond, both sides are shuffled.
BROADCAST_HOSTS = 10_000


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.trim(line), F.lit(1)).alias("b"))


def boilerplate_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host that has boilerplate: `host`, `lines`, an array of line keys.

    A host's array holds fewer than (mean distinct lines per page) / ratio keys, so it stays small at any size.
    """
    keys = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != ""), line_key))
    own = pages.select(F.col(host).alias("host"), line_key(F.col(text)).alias("page"), keys.alias("keys"))
    lines = own.where(F.col("keys").isNotNull()).select("host", "page", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    totals = own.groupBy(F.col("host").alias("of")).agg(F.count_distinct("page").alias("total"))
    bad = lines.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    return bad.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Add `kept_text`, `n_lines`, `n_dropped`, replacing such columns; other columns stay.

    Lines are what `\\n` separates. A line counts trimmed of spaces; blank lines are never dropped. A line goes if
    it is in at least `min_pages` pages of its host and in more than `ratio` of them; rows of one host with equal texts, but for spaces around them,
    are one page. Null text: kept_text null, 0 lines; empty text: one (blank) line, kept. All null texts of a host are one page. Null hosts form one host.
    """
    name = Names(pages)
    at, lines_, kept_ = map(name, ("host", "lines", "kept"))
    bad = scratch(boilerplate_lines(pages, host, text, ratio, min_pages), "lines")
    side = small(bad.select(F.col("host").alias(at), F.col("lines").alias(lines_)), BROADCAST_HOSTS)
    joined = pages.drop("kept_text", "n_lines", "n_dropped").join(side, F.col(host).eqNullSafe(F.col(at)), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(lines_).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines_), line_key(x))))
    out = joined.withColumn(kept_, kept)
    return out.withColumns({
        "kept_text": F.array_join(kept_, "\n"),
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size(lines) - F.size(kept_), F.lit(0)).cast("long"),
    }).drop(kept_, lines_, at)
