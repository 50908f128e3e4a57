"""The registered queries of the operators and their SQL equivalents, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import html_to_text
from millrace.llm import decontam, html_extract, langid, line_dedup, media, mixing, near_dedup, quality, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "html")
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leak_digest(decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return out.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = langid.learn(table(spark, sf_dir, "documents").select("text", "lang"), "text", "lang")
    host, html = url_filter.host_of(F.col("url")), F.col("html")
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), langid.domain_of(host).alias("domain"), langid.markup_language(html).alias("declared"), langid.address_language(F.col("url"), models.languages).alias("address"), html_to_text(html).alias("text"))
    out = langid.identify(pages, models, host=F.col("host"), domain=F.col("domain"), declared=F.col("declared"), address=F.col("address"), keep=["page_id", "host", "domain", "declared", "address"])
    return out.select("page_id", "host", "domain", "declared", "address", "language", F.round("confidence", 6).alias("confidence"), F.col("accepted").alias("kept"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    info = ["media_info.n_bytes", *(f"media_info.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"))]
    return out.select("doc_id", *info)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_html_extraction, op3_line_dedup, op4_source_mixing, op5_decontamination, op6_quality, op7_substring_dedup, op8_language_id, op9_media, op10_near_dedup)}

# ------------------------------------------------------------------------------------------------- SQL

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _op1_sql() -> str:
    longest = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in longest)
    actions = " ".join(f"WHEN rule = '{h + p}' THEN '{a}'" for a, h, p in url_filter.RULES)
    host = _FOLD.format(r"regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's')")
    a, keep = url_filter.DAMPING, 1 - url_filter.DAMPING
    rounds, last = [], "r0"
    for k in range(url_filter.ROUNDS):
        rounds.append(f"""r{k + 1} AS (
  SELECT coalesce(s0.host, s.b) AS host, coalesce(t0, 0.0) + {a} * coalesce(s.t, 0.0) AS trust, coalesce(d0, 0.0) + {a} * coalesce(s.d, 0.0) AS distrust
  FROM s0 FULL JOIN (SELECT b, sum(wt * trust) AS t, sum(wd * distrust) AS d FROM flows JOIN {last} ON flows.a = {last}.host GROUP BY b) s ON s0.host = s.b)""")
        last = f"r{k + 1}"
    return rf"""WITH p AS (SELECT page_id, html, coalesce({host.format('url')}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
judged AS (SELECT *, CASE {cases} END AS rule FROM p),
acted AS (SELECT *, CASE {actions} END AS action FROM judged),
seen AS (SELECT DISTINCT src, page, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS url FROM (SELECT page_id AS page, * FROM (SELECT page_id, host AS src, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1, 'i')) AS link FROM p WHERE host <> ''))),
aimed AS (SELECT src, {host.format('url')} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM seen),
tested AS (SELECT src, host AS dst, CASE {cases} END AS rule FROM aimed WHERE host <> '' AND src <> host),
links AS (SELECT src, dst, avg(CASE WHEN action = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t, avg(CASE WHEN action = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d FROM (SELECT *, CASE {actions} END AS action FROM tested) GROUP BY src, dst),
wide AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM links),
flows AS (SELECT src AS a, dst AS b, w AS wt, 0.0::DOUBLE AS wd FROM wide UNION ALL SELECT dst, src, 0.0::DOUBLE, w FROM wide),
own AS (SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t, avg(CASE WHEN action = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d FROM acted WHERE host <> '' GROUP BY host),
s0 AS (SELECT host, {keep} * t AS t0, {keep} * d AS d0 FROM (SELECT * FROM own UNION ALL SELECT dst, avg(t), avg(d) FROM links WHERE dst NOT IN (SELECT host FROM own) GROUP BY dst HAVING avg(t) > 0 OR avg(d) > 0)),
r0 AS (SELECT host, t0 AS trust, d0 AS distrust FROM s0),
{", ".join(rounds)}
SELECT page_id, acted.host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > {url_filter.THRESHOLD} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM acted LEFT JOIN {last} ON acted.host = {last}.host"""


_OP3_SQL = f"""WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
own AS (SELECT source, trim(text, ' ') AS page, unnest(list_distinct(list_transform(list_filter(lines, lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')))) AS line FROM d),
bad AS (SELECT k.source, list(k.line) AS bad FROM (SELECT source, line, count(DISTINCT page) AS n FROM own GROUP BY ALL) k
        JOIN (SELECT source, count(DISTINCT trim(text, ' ')) + max((text IS NULL)::INT) AS total FROM documents GROUP BY source) t ON k.source IS NOT DISTINCT FROM t.source
        WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO}::DOUBLE * total GROUP BY k.source),
kept AS (SELECT doc_id, d.source, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))) END AS kept
         FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END) AS kept_sha256 FROM kept"""

_OP4_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_SPACED})), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
named AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (source_size * 3)::DOUBLE AS cap FROM sums),
room AS (SELECT *, (SELECT sum(source_size) FROM sums)::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS done,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM named),
level AS (SELECT max((total - done) / rest) AS level FROM room),
goal AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM level), 0.0::DOUBLE) * w) AS target FROM room),
placed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'null') || ':7') AS h, CASE WHEN size < {mixing.CLASSES} THEN size ELSE length(bin(size)) * {mixing.CLASSES} + floor(size / pow(2.0, length(bin(size)) - {mixing.CLASSES.bit_length()}))::BIGINT % {mixing.CLASSES} END AS class FROM d),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM goal),
long AS (SELECT p.source, p.size, p.h, rate, row_number() OVER w AS r, sum(p.size) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS words FROM placed p JOIN rates g ON p.source IS NOT DISTINCT FROM g.source
         WHERE p.size > target * {mixing.LONG_SHARE}::DOUBLE WINDOW w AS (PARTITION BY p.source ORDER BY p.size DESC, p.h) QUALIFY r <= {mixing.LONG}),
steps AS (SELECT DISTINCT source, 0::BIGINT AS r, 0::BIGINT AS taken, 0::BIGINT AS c FROM long
          UNION ALL SELECT l.source, l.r, (s.taken + l.size * greatest(0, least({mixing.MAX_COPIES}, floor((rate * words - s.taken) / l.size + 0.5::DOUBLE))))::BIGINT,
          greatest(0, least({mixing.MAX_COPIES}, floor((rate * words - s.taken) / l.size + 0.5::DOUBLE)))::BIGINT FROM steps s JOIN long l ON l.source IS NOT DISTINCT FROM s.source AND l.r = s.r + 1),
whole AS (SELECT l.source, l.size, l.h, s.c FROM long l JOIN steps s ON l.source IS NOT DISTINCT FROM s.source AND l.r = s.r),
spent AS (SELECT source, sum(size)::BIGINT AS words, sum(size * c)::BIGINT AS taken FROM whole GROUP BY source),
left_over AS (SELECT g.source, source_size, target, CASE WHEN source_size > coalesce(words, 0) THEN greatest(0.0::DOUBLE, least({mixing.MAX_COPIES}.0::DOUBLE, (target - coalesce(taken, 0)) / (source_size - coalesce(words, 0)))) ELSE 0.0::DOUBLE END AS rate,
              ('0x' || substr(md5(coalesce(g.source, 'null') || ':offset:7'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
              FROM goal g LEFT JOIN spent s ON g.source IS NOT DISTINCT FROM s.source),
marked AS (SELECT p.*, w.c FROM placed p LEFT JOIN whole w ON p.source IS NOT DISTINCT FROM w.source AND p.size = w.size AND p.h = w.h),
counted AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY source, class) / {mixing.CHUNK}.0::DOUBLE)) AS pieces FROM marked WHERE c IS NULL),
dealt AS (SELECT *, floor(('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * pieces)::BIGINT AS piece FROM counted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, piece, h, size) AS k FROM dealt),
taken AS (SELECT doc_id, r.source, size, least(floor(k * rate + u) - floor((k - 1) * rate + u), {mixing.MAX_COPIES})::BIGINT AS c FROM ranked r JOIN left_over g ON r.source IS NOT DISTINCT FROM g.source
          UNION ALL SELECT doc_id, source, size, c FROM marked WHERE c IS NOT NULL)
SELECT doc_id, size, source_size, target, (c * size)::BIGINT AS taken FROM taken t JOIN goal g ON t.source IS NOT DISTINCT FROM g.source"""

_OP5_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_PLAIN}) AS w FROM documents),
b AS (SELECT item_id, w, least({decontam.WINDOW}, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_PLAIN}) AS w FROM benchmark)),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b WHERE k > 0)),
spots AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT doc_id, spots.k, i, item_id FROM spots JOIN windows ON spots.k = windows.k AND spots.s = windows.s),
covered AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_OP7_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
spots AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS low FROM spots) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM later),
words AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_OP10_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT DISTINCT a AS doc_id, a AS seen FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.seen = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _op1_sql(),
    "op3_line_dedup": _OP3_SQL,
    "op4_source_mixing": _OP4_SQL,
    "op5_decontamination": _OP5_SQL,
    "op7_substring_dedup": _OP7_SQL,
    "op10_near_dedup": _OP10_SQL,
}
