"""Queries on predicates and scalar functions of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import rows as W
from millrace.functions import text as T
from millrace.plans.registry import query

# Neutral stand-ins for invented prose; tests/test_packs.py holds the shipped packs on sentences of their own.
TERMS = {"the": ("the ", "that"), "und": ("und", "der "), "secret": ("password", "akia"), "los": ("los ", "que")}
ALIASES = ("the and", "of", "password", "Licensed under", "für")
UNSAFE, SAFE, REFUSAL = "thing|password|ung", "and|der|los", "the|die|las"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{x}')" for x in v) + f" THEN '{k}' END" for k, v in TERMS.items()) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def doc_keyword_topics(t):
    return t("documents").select("doc_id", F.array_join(P.terms_found(F.col("text"), TERMS), ",").alias("found"))


_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"SELECT doc_id, list_has_all({_TOKENS}, ['the', 'and']) OR regexp_matches(lower(text), '(^|[^a-z0-9])the and([^a-z0-9]|$)') AS a0, list_contains({_TOKENS}, 'of') AS a1, list_contains({_TOKENS}, 'password') AS a2, list_has_all({_TOKENS}, ['licensed', 'under']) AS a3, list_has_all({_TOKENS}, ['f', 'r']) AS a4 FROM documents")
def doc_alias_match(t):
    return t("documents").select("doc_id", *[P.alias_match(F.col("text"), a).alias(f"a{k}") for k, a in enumerate(ALIASES)])


def _spans_sql(pattern: str) -> str:
    return f"""m AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents),
o AS (SELECT doc_id, text, m[i] AS w, length(array_to_string(p[1 : i], '')) + length(array_to_string(m[1 : i - 1], '')) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m))"""


@query(f"WITH {_spans_sql('password=|AKIA')}, w AS (SELECT doc_id, count(*) FILTER (NOT regexp_matches(substring(text, greatest(s - 30, 0) + 1, s + length(w) + 30 - greatest(s - 30, 0)), '{SAFE}')) AS open, count(*) AS hits, min(s) AS first FROM o GROUP BY doc_id) SELECT doc_id, coalesce(hits, 0)::BIGINT AS hits, coalesce(open, 0)::BIGINT AS open_hits, coalesce(first, -1)::BIGINT AS first_at FROM documents LEFT JOIN w USING (doc_id)")
def doc_spans(t):
    text = F.col("text")
    s = P.spans(text, "password=|AKIA")
    return t("documents").select("doc_id", F.size(s).cast("long").alias("hits"), F.size(P.unguarded(text, "password=|AKIA", SAFE, 30)).cast("long").alias("open_hits"), F.coalesce(F.try_element_at(s, F.lit(1))["start"], F.lit(-1)).cast("long").alias("first_at"))


_FORBIDDEN = ["password", "license", "AKI", "die"]


def _forbidden_sql(item: str) -> str:
    needle, low = item.lower(), "lower(text)"
    if len(needle) <= 3:
        at = f"length(regexp_extract({low}, '^(.*?)(?:^|[^a-z0-9])(?:{needle})(?:$|[^a-z0-9])', 1, 's')) + CASE WHEN regexp_matches({low}, '^{needle}([^a-z0-9]|$)') THEN 0 ELSE 1 END"
        found = f"regexp_matches({low}, '(^|[^a-z0-9]){needle}([^a-z0-9]|$)')"
    else:
        at, found = f"strpos({low}, '{needle}') - 1", f"contains({low}, '{needle}')"
    window = f"substring({low}, greatest({at} - 60, 0) + 1, {at} + {len(needle)} + 60 - greatest({at} - 60, 0))"
    return f"CASE WHEN {found} AND NOT regexp_matches({window}, '{REFUSAL}') THEN '{item}' END"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(map(_forbidden_sql, _FORBIDDEN)) + "], lambda x: x IS NOT NULL), ',') AS hits FROM documents")
def doc_forbidden_hits(t):
    return t("documents").select("doc_id", F.array_join(P.forbidden_hits(F.col("text"), _FORBIDDEN, REFUSAL, 60), ",").alias("hits"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(f"SELECT doc_id, len(list_filter(range(2, len(s) + 1), lambda i: regexp_matches(s[i - 1], '{REFUSAL}') AND regexp_matches(s[i], '{UNSAFE}') AND NOT regexp_matches(s[i], '{SAFE}')))::BIGINT AS pairs FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def doc_contradictions(t):
    return t("documents").select("doc_id", P.contradicted(F.col("text"), REFUSAL, UNSAFE, SAFE).alias("pairs"))


@query(f"""WITH {_spans_sql('password=|AKIA|Licen')}, c AS (SELECT doc_id, w, substring(text, 1, s) AS before, substring(text, s + length(w) + 1) AS after, s FROM o),
k AS (SELECT doc_id, CASE WHEN contains(before, 'The') THEN length(before) - position('ehT' IN reverse(before)) - 1 ELSE -1 END AS a, CASE WHEN contains(before, 'Die') THEN length(before) - position('eiD' IN reverse(before)) - 1 ELSE -1 END AS b,
 string_split(before, chr(10))[-1] || w || string_split(after, chr(10))[1] AS line, substring(before, greatest(s - 40, 0) + 1, 40) AS prefix FROM c)
SELECT doc_id, coalesce(n, 0)::BIGINT AS hits FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM k WHERE NOT (a > b AND a >= 0) AND NOT regexp_matches(line, 'zzz|ung') AND NOT regexp_matches(prefix, 'zzz|ung') GROUP BY doc_id) USING (doc_id)""")
def doc_outside_section(t):
    return t("documents").select("doc_id", P.outside_section(F.col("text"), "password=|AKIA|Licen", "zzz|ung", "The", ("Die",)).alias("hits"))


@query(f"SELECT doc_id, len(list_filter(s, lambda x: length(x) BETWEEN 30 AND 120 AND regexp_matches(x, '[.!]$') AND NOT regexp_matches(x, 'password')))::BIGINT AS usable, regexp_matches(text, '[ऀ-ॿ]') AS devanagari, lang IN ('en', 'de') AS known, quality IS DISTINCT FROM 1 AS not_good FROM (SELECT *, {_SENTENCES} AS s FROM documents LEFT JOIN labels USING (doc_id))")
def doc_shape_predicates(t):
    text = F.col("text")
    usable = F.size(F.filter(T.sentences(text), lambda s: P.usable_sentence(s, "password", 30, 120))).cast("long")
    d = t("documents").select("doc_id", usable.alias("usable"), P.devanagari(text).alias("devanagari"), F.col("lang").isin("en", "de").alias("known"))
    return d.join(t("labels"), "doc_id", "left").select(*d.columns, P.not_true(F.col("quality") == 1).alias("not_good"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS plain, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9ऀ-ॿ]+'), ' ')) AS wide, sha256(trim(regexp_replace(regexp_replace(lower(text), 'the|und|los', '{{word}}', 'g'), '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS placed, coalesce({_SENTENCES}[1], '') AS first_sentence, coalesce({_SENTENCES}[-1], '') AS last_sentence, upper(left(text, 1)) || lower(substring(text, 2, 19)) AS capital FROM documents")
def doc_normal_forms(t):
    text = F.col("text")
    forms = {"plain": T.normalize(text), "wide": T.wide_normal(text), "placed": T.placeholder_normal(text, "the|und|los", "{word}")}
    return t("documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in forms.items()], T.first_sentence(text).alias("first_sentence"), T.last_sentence(text).alias("last_sentence"), T.capitalize(F.substring(text, 1, 20)).alias("capital"))


@query("SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(length(x) - 4, 1) + 1), lambda i: substring(x, i, 5))))::BIGINT AS distinct5, length('  ' || x || '  ') - 2 AS n3, len(list_distinct(list_transform(range(1, length(x) + 3), lambda i: substring('  ' || x || '  ', i, 3))))::BIGINT AS distinct3 FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS x FROM documents)")
def doc_char_grams(t):
    x = T.normalize(F.col("text"))
    three = T.gram_counts(x)
    return t("documents").select("doc_id", F.size(T.char_grams(x, 5)).cast("long").alias("distinct5"), F.size(three).cast("long").alias("n3"), F.size(F.array_distinct(three)).cast("long").alias("distinct3"))


_W = r"regexp_extract_all(text, '\S+')"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, array_to_string(w, ' ') AS plain, CASE WHEN least(14, len(w)) > least(8, floor(len(w) / 3)) THEN array_to_string(w[least(8, floor(len(w) / 3))::INT + 1 : least(14, len(w))], ' ') ELSE '' END AS answer FROM w)
SELECT doc_id, answer, sha256(CASE WHEN answer <> '' AND contains(plain, answer) THEN substring(plain, 1, strpos(plain, answer) - 1) || '____' || substring(plain, strpos(plain, answer) + length(answer)) ELSE plain END) AS masked FROM c""")
def doc_cloze(t):
    return t("documents").select("doc_id", T.cloze(F.col("text")).alias("c")).select("doc_id", "c.answer", F.sha2("c.masked", 256).alias("masked"))


_JOINED = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f]+', ' ', 'g'), ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:All rights reserved|Licensed under)')), ' ')"


@query(rf"""WITH j AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_JOINED}, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(s, lambda x: NOT regexp_matches(x, 'password|!!')), ' ')) AS clean, len(list_filter(s, lambda x: regexp_matches(x, 'password|!!')))::BIGINT AS removed FROM j""")
def doc_clean_text(t):
    text = F.col("text")
    c = F.when(text.isNotNull(), T.clean_text(F.translate(text, "\r", ""), "^(?:All rights reserved|Licensed under)", "password|!!"))
    return t("documents").select("doc_id", c.alias("c")).select("doc_id", F.sha2("c.clean", 256).alias("clean"), F.array_size("c.removed").cast("long").alias("removed"))


@query(r"SELECT doc_id, (len(p) - len(list_distinct(p)))::BIGINT AS repeated FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: lower(trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' '))), lambda x: x <> '') AS p FROM documents)")
def doc_duplicate_sentences(t):
    return t("documents").select("doc_id", T.duplicate_sentences(F.col("text")).alias("repeated"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\bthe\b', 'und', 'g'), '\bund\b', 'los', 'g'), '\blos\b', 'les', 'g')) AS text_sha256 FROM documents")
def doc_replacement_chain(t):
    return t("documents").select("doc_id", F.sha2(T.replaced_in_order(F.regexp_replace("text", r"[^\x00-\x7F]", " "), [("the", "und"), ("und", "los"), ("los", "les")]), 256).alias("text_sha256"))


@query(r"WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), n AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS other, w, lead(w) OVER (PARTITION BY lang ORDER BY doc_id) AS v FROM d) SELECT doc_id, other, round(CASE WHEN len(list_distinct(w || v)) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(w), list_distinct(v)))::DOUBLE / len(list_distinct(w || v)) END, 6) AS jaccard, list_has_all(v, w) AS part FROM n WHERE other IS NOT NULL")
def doc_neighbour_jaccard(t):
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("doc_id")
    d = t("documents").select("doc_id", "lang", T.ascii_tokens(F.col("text")).alias("w"))
    d = d.withColumns({"other": F.lead("doc_id").over(w), "v": F.lead("w").over(w)}).where("other is not null")
    return d.select("doc_id", "other", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), W.subset(F.col("w"), F.col("v")).alias("part"))


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), u AS (SELECT doc_id, s, list_filter(s, lambda x: length(x) BETWEEN 30 AND 120 AND regexp_matches(x, '[.!]$')) AS u FROM s)
SELECT doc_id, coalesce(list_filter(u, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'der'))[1], u[1], left(array_to_string(s, ' '), 100)) AS short_text FROM u""")
def doc_short_sentence(t):
    s = T.sentences(F.col("text"))
    usable = F.filter(s, lambda x: P.usable_sentence(x, "(?!)", 30, 120))
    topical = F.filter(usable, lambda x: P.any_term(F.lower(x), ("the", "der")))
    first = lambda a: F.try_element_at(a, F.lit(1))
    return t("documents").select("doc_id", F.coalesce(first(topical), first(usable), F.substring(F.array_join(s, " "), 1, 100)).alias("short_text"))


@query(r"SELECT event_id, regexp_matches(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') AS stamped, regexp_matches(strftime(ts, '%Y-%m-%d %H:%M'), '^\d{4}-\d{2}-\d{2}T') AS plain, strftime(ts, '%Y-%m-%d') AS day FROM events")
def event_timestamps(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t("events").select("event_id", W.iso_timestamp(stamp).alias("stamped"), W.iso_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("plain"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
