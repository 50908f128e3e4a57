"""Queries on validation gates, review, readiness and research; the driver's documents and labels stand in for seeds and expanded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import packs
from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.operators import gates as G
from millrace.operators import relate as L
from millrace.plans.registry import query

_S = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SEEDS = f"""seeds AS (SELECT d.doc_id, 's' || d.doc_id AS seed_id, d.text AS text, CASE d.doc_id % 7 WHEN 0 THEN 'dev_seed' WHEN 1 THEN 'final_eval_seed' ELSE 'train_seed' END AS split, CASE WHEN toxic = 1 THEN 'red' WHEN quality = 0 THEN 'yellow' ELSE 'green' END AS risk, lang AS bucket, ['cow', 'buffalo', 'ox', 'calf'][(d.doc_id % 4 + 1)::INT] AS species, CASE WHEN lang = 'en' THEN 'english' ELSE 'hinglish' END AS style,
list_filter([lang, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN d.doc_id % 5 = 0 THEN 'odd' END], lambda x: x IS NOT NULL) AS tags, source AS family, source || ':' || lang AS cluster, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS shape, lower(d.text) AS prompt, [source, 'src' || (d.doc_id % 25)] AS claim_ids, {_S.replace('text', 'd.text')}[1] AS opening, {_S.replace('text', 'd.text')}[-1] AS closing FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _seeds(t):
    text = F.col("text")  # what is cut from a text is cut before the join, which then moves texts only where they are asked for
    d = t("documents").withColumns({"opening": T.first_sentence(text), "closing": T.last_sentence(text)}).join(t("labels"), "doc_id")
    m = F.col("doc_id")
    return d.select(
        "doc_id", F.concat(F.lit("s"), "doc_id").alias("seed_id"), "text",
        F.when(m % 7 == 0, "dev_seed").when(m % 7 == 1, "final_eval_seed").otherwise("train_seed").alias("split"),
        F.when(F.col("toxic") == 1, "red").when(F.col("quality") == 0, "yellow").otherwise("green").alias("risk"),
        F.col("lang").alias("bucket"), F.when(m % 4 != -1, F.element_at(F.array(*map(F.lit, ("cow", "buffalo", "ox", "calf"))), (m % 4 + 1).cast("int"))).alias("species"),
        F.when(F.col("lang") == "en", "english").otherwise("hinglish").alias("style"),
        F.array_compact(F.array("lang", F.when(F.col("n_chars") > 1000, "long"), F.when(m % 5 == 0, "odd"))).alias("tags"),
        F.col("source").alias("family"), F.concat_ws(":", "source", "lang").alias("cluster"),
        F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long").alias("shape"),
        F.lower("text").alias("prompt"), F.array("source", F.concat(F.lit("src"), m % 25)).alias("claim_ids"),
        "opening", "closing",
    )


_CLAIMS = [(f"src{k}", ("care", "policy", "context", "care")[k % 4], ["en", "long"] if k % 2 else ["fr"], k % 6 == 0) for k in range(20)]
_CLAIM_SQL = "claims AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {str(d).lower()})" for a, b, c, d in _CLAIMS) + ") v(claim_id, role, supports, blocked))"


def _claims(t):
    return t("labels").sparkSession.createDataFrame(_CLAIMS, "claim_id string, role string, supports array<string>, blocked boolean")


_OUT = "SELECT '{gate}' AS gate, {entity}::VARCHAR AS entity_id, {code} AS code, {detail}::VARCHAR AS detail"


def _out(gate, entity, code, detail="''"):
    return _OUT.format(gate=gate, entity=entity, code=code, detail=detail)


MINIMUMS = [("dev_seed", "en", 30), ("dev_seed", "red", 2), ("dev_seed", "odd", 99), ("train_seed", "cow", 10), ("train_seed", "nowhere", 1), ("final_eval_seed", "long", 20)]


@query(f"""WITH {_SEEDS}, c AS (SELECT split, k, v, count(*) AS n FROM (SELECT split, 'tag' AS k, unnest(tags) AS v FROM seeds UNION ALL SELECT split, 'scalar', unnest([risk, bucket, species, style]) FROM seeds) GROUP BY ALL), f AS (SELECT split, v, max(n) AS n FROM c GROUP BY ALL), w AS (SELECT * FROM (VALUES {', '.join(map(str, MINIMUMS))}) m(split, v, want))
{_out('stratification', 'w.split', "'below_minimum'", "w.v || ' ' || coalesce(n, 0) || ' < ' || want")} FROM w LEFT JOIN f ON f.split = w.split AND f.v = w.v WHERE coalesce(n, 0) < want
UNION ALL {_out('stratification', 's', "'split_count'", "n || ' of ' || want")} FROM (SELECT coalesce(a.split, b.s) AS s, coalesce(n, 0) AS n, coalesce(want, 0) AS want FROM (SELECT split, count(*) AS n FROM seeds GROUP BY split) a FULL JOIN (SELECT * FROM (VALUES ('train_seed', 210), ('dev_seed', 45), ('extra_seed', 1)) v(s, want)) b ON a.split = b.s) WHERE n <> want""")
def gate_stratification(t):
    s = _seeds(t)
    return G.minimums(s, "stratification", "split", "tags", ["risk", "bucket", "species", "style"], MINIMUMS).unionByName(G.expected_counts(s, "stratification", "split", {"train_seed": 210, "dev_seed": 45, "extra_seed": 1}))


@query(f"WITH {_SEEDS} SELECT c AS value, count(*)::BIGINT AS n FROM (SELECT unnest(claim_ids) AS c FROM seeds) GROUP BY c")
def gate_source_usage(t):
    """How often each claim is used."""
    return L.element_counts(_seeds(t), F.col("claim_ids"))


@query(f"""WITH {_SEEDS}, {_CLAIM_SQL}, e AS (SELECT seed_id, tags, risk = 'red' OR list_contains(tags, 'odd') AS c, unnest(claim_ids) AS claim_id FROM seeds),
g AS (SELECT seed_id, bool_or(coalesce(role = 'care', false)) AS care, bool_or(coalesce(list_has_any(supports, tags), false)) AS fits, bool_or(coalesce(role IN ('policy', 'escalation', 'context'), false)) AS other, bool_or(c AND coalesce(blocked, false)) AS blocked FROM e LEFT JOIN claims USING (claim_id) GROUP BY seed_id)
{_out('claims', 'seed_id', "unnest(list_filter([CASE WHEN NOT care THEN 'lacks_care_claim' END, CASE WHEN NOT fits THEN 'lacks_compatible_claim' END, CASE WHEN other THEN 'non_care_claims' END, CASE WHEN blocked THEN 'blocked_claim_in_critical_seed' END], lambda x: x IS NOT NULL))")} FROM g""")
def gate_claims(t):
    return G.claim_support(_seeds(t), "claims", "seed_id", "claim_ids", "tags", (F.col("risk") == "red") | F.array_contains("tags", "odd"), _claims(t))


@query(f"""WITH {_SEEDS}, f AS (SELECT doc_id // 9 AS f, * FROM seeds), g AS (SELECT f, count(*) AS n, count(DISTINCT split) > 1 AS a, count(DISTINCT shape) > 1 AS b, count(DISTINCT risk) > 1 AS c, count(DISTINCT species) = 1 AS same FROM f GROUP BY f)
{_out('variants', 'f', "unnest(list_filter([CASE WHEN n <> 3 THEN 'family_size' END, CASE WHEN n = 3 AND a::INT + b::INT + c::INT < 2 THEN 'few_axes' END, CASE WHEN n = 3 AND same THEN 'same_contract' END], lambda x: x IS NOT NULL))", 'n')} FROM g""")
def gate_variants(t):
    s = _seeds(t).withColumn("f", F.floor(F.col("doc_id") / 9))
    axes = F.create_map(F.lit("split"), F.col("split"), F.lit("shape"), F.col("shape"), F.lit("risk"), F.col("risk"))
    return G.variants(s, "variants", "f", axes, F.col("species"))


CONTRACTS = {"en": (("the", "and"), ("und",)), "de": (("der", "die"), ("zzz",)), "generic": ((), ("los",))}


@query(f"""WITH {_SEEDS} {_out('prompts', 'seed_id', "unnest(list_filter([CASE WHEN (bucket = 'en' AND NOT (contains(prompt, 'the') OR contains(prompt, 'and'))) OR (bucket = 'de' AND NOT (contains(prompt, 'der') OR contains(prompt, 'die'))) THEN 'lacks_topic_cue' END, CASE WHEN (bucket = 'en' AND contains(prompt, 'und')) OR (bucket = 'de' AND contains(prompt, 'zzz')) OR (bucket NOT IN ('en', 'de') AND contains(prompt, 'los')) THEN 'forbidden_cue' END], lambda x: x IS NOT NULL))", 'bucket')} FROM seeds""")
def gate_prompts(t):
    return G.prompt_contracts(_seeds(t), "prompts", F.col("seed_id"), F.col("prompt"), F.col("bucket"), CONTRACTS)


@query(f"""WITH {_SEEDS}, k AS (SELECT DISTINCT split, n, sha256(v) AS h FROM (SELECT split, family, unnest(['cluster', 'coarse']) AS n, unnest([cluster, family]) AS v FROM seeds) WHERE family NOT IN ('src0', 'src1'))
{_out('clusters', 'left(h, 16)', "'leak:' || n", "string_agg(split, ',' ORDER BY split)")} FROM k GROUP BY n, h HAVING count(*) > 1""")
def gate_clusters(t):
    return G.leaks(_seeds(t), "clusters", "split", {"cluster": F.col("cluster"), "coarse": F.col("family")}, F.col("family").isin("src0", "src1"))


@query(f"""WITH {_SEEDS} {_out('shapes', 'shape', "'dominant_shape'", 'count(*)')} FROM seeds GROUP BY shape HAVING count(*) > 0.3 * (SELECT count(*) FROM seeds) UNION ALL {_out('shapes', 'split', "'few_shapes'", 'count(DISTINCT shape)')} FROM seeds GROUP BY split HAVING count(DISTINCT shape) < 5
UNION ALL {_out('shapes', 's', "'missing_coverage'", 'v')} FROM (VALUES ('dev_seed', 'en'), ('dev_seed', 'xx'), ('none', 'english')) r(s, v) WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE split = s AND (bucket = v OR style = v))""")
def gate_shapes(t):
    s = _seeds(t)
    return G.shapes(s, "shapes", "shape", "split").unionByName(G.coverage(s, "shapes", "split", F.array("bucket", "style"), {"dev_seed": ["en", "xx"], "none": ["english"]}))


_SPECIES_RULES = "[CASE WHEN list_contains(tags, 'long') AND species NOT IN ('cow', 'buffalo') THEN 'long_not_adult' END, CASE WHEN list_contains(tags, 'odd') AND shape = 'short' THEN 'odd_short' END, CASE WHEN bucket = 'fr' AND species = 'ox' THEN 'ox_context' END]"


@query(f"WITH {_SEEDS} {_out('species', 'seed_id', f'unnest(list_filter({_SPECIES_RULES}, lambda x: x IS NOT NULL))', 'species')} FROM seeds")
def gate_species(t):
    rules = {"long_not_adult": F.array_contains("tags", "long") & ~F.col("species").isin("cow", "buffalo"), "odd_short": F.array_contains("tags", "odd") & (F.col("shape") == "short"), "ox_context": (F.col("bucket") == "fr") & (F.col("species") == "ox")}
    return G.row_rules(_seeds(t), "species", F.col("seed_id"), rules, F.col("species"))


@query(f"""WITH {_SEEDS}, v AS (SELECT unnest(['prompt', 'first_step', 'must_not']) AS n, unnest([left(prompt, 6), opening, closing]) AS v, unnest([3, 2, 1]) AS cap FROM seeds)
{_out('repetition', 'left(sha256(v), 16)', "'cap:' || n", 'count(*)')} FROM v GROUP BY n, v, cap HAVING count(*) > cap""")
def gate_repetition(t):
    return G.repetition(_seeds(t), "repetition", {"prompt": F.substring("prompt", 1, 6), "first_step": F.col("opening"), "must_not": F.col("closing")}, {"prompt": 3, "first_step": 2, "must_not": 1})


@query(f"WITH {_SEEDS} {_out('frames', 'family', chr(39) + 'few_frames' + chr(39), 'count(DISTINCT left(prompt, 20))')} FROM seeds GROUP BY family HAVING count(DISTINCT left(prompt, 20)) < 20")
def gate_frames(t):
    return G.frames(_seeds(t), "frames", "family", F.substring("prompt", 1, 20), 20)


@query(f"WITH {_SEEDS} {_out('language', 'seed_id', 'unnest(list_filter([CASE WHEN regexp_matches(text, ' + chr(39) + '[ÃÂ�]' + chr(39) + ') THEN ' + chr(39) + 'mojibake' + chr(39) + ' END, CASE WHEN regexp_matches(prompt, ' + chr(39) + 'password|thing' + chr(39) + ') THEN ' + chr(39) + 'metadata_prompt' + chr(39) + ' END, CASE WHEN style = ' + chr(39) + 'hinglish' + chr(39) + ' AND NOT regexp_matches(prompt, ' + chr(39) + 'die|der|les|los|que' + chr(39) + ') THEN ' + chr(39) + 'unnatural' + chr(39) + ' END], lambda x: x IS NOT NULL))', 'bucket')} FROM seeds")
def gate_language(t):
    rules = {"mojibake": F.col("text").rlike("[ÃÂ�]"), "metadata_prompt": F.col("prompt").rlike("password|thing"), "unnatural": (F.col("style") == "hinglish") & ~F.col("prompt").rlike("die|der|les|los|que")}
    return G.row_rules(_seeds(t), "language", F.col("seed_id"), rules, F.col("bucket"))


@query(f"""WITH {_SEEDS} SELECT 'bad_cases' AS gate, v AS entity_id, 'phrase_not_exercised' AS code, '' AS detail FROM (SELECT unnest(['the', 'never seen phrase']) AS v) WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE contains(lower(text), v)) UNION ALL SELECT 'bad_cases', v, 'missing_case', '' FROM (SELECT unnest(['red', 'purple']) AS v) WHERE v NOT IN (SELECT risk FROM seeds)""")
def gate_bad_cases(t):
    return G.exercised(_seeds(t), "bad_cases", F.col("text"), ["the", "never seen phrase"], F.col("risk"), ["red", "purple"])


_ROWS = f"""{_SEEDS}, rows_ AS (SELECT 'r' || (doc_id % 395) AS row_id, CASE WHEN doc_id % 17 = 0 THEN 's999999' ELSE seed_id END AS parent, CASE split WHEN 'dev_seed' THEN 'sft_dev' WHEN 'train_seed' THEN 'sft_train' ELSE CASE WHEN doc_id % 3 = 0 THEN 'sft_train' ELSE 'final_eval' END END AS row_split, CASE WHEN doc_id % 19 = 0 THEN 'other' ELSE family END AS family, risk, CASE WHEN doc_id % 23 = 0 THEN 'bad' WHEN doc_id % 29 = 0 THEN NULL ELSE sha256(text) END AS content_hash, text, doc_id FROM seeds)"""


@query(f"""WITH {_ROWS}, j AS (SELECT r.*, s.seed_id IS NOT NULL AS known, s.split AS ps, s.family AS pf, s.risk AS pr, count(*) OVER (PARTITION BY row_id) AS times FROM rows_ r LEFT JOIN seeds s ON r.parent = s.seed_id)
{_out('provenance', 'row_id', "unnest(list_filter([CASE WHEN content_hash IS NULL THEN 'missing_fields' END, CASE WHEN times > 1 THEN 'duplicate_id' END, CASE WHEN sha256(text) <> content_hash THEN 'content_hash' END, CASE WHEN NOT known THEN 'unknown_parent' END, CASE WHEN known AND ps IS DISTINCT FROM CASE row_split WHEN 'sft_dev' THEN 'dev_seed' WHEN 'sft_train' THEN 'train_seed' ELSE 'final_eval_seed' END THEN 'cross_split' END, CASE WHEN known AND family IS DISTINCT FROM pf THEN 'parent_mismatch:family' END, CASE WHEN known AND risk IS DISTINCT FROM pr THEN 'parent_mismatch:risk' END], lambda x: x IS NOT NULL))")} FROM j""")
def gate_provenance(t):
    s = _seeds(t)
    m = F.col("doc_id")
    row_split = F.when(F.col("split") == "dev_seed", "sft_dev").when(F.col("split") == "train_seed", "sft_train").otherwise(F.when(m % 3 == 0, "sft_train").otherwise("final_eval"))
    rows = s.select(F.concat(F.lit("r"), m % 395).alias("row_id"), F.when(m % 17 == 0, "s999999").otherwise(F.col("seed_id")).alias("parent"), row_split.alias("row_split"), F.when(m % 19 == 0, "other").otherwise(F.col("family")).alias("family"), "risk", F.when(m % 23 == 0, "bad").when(m % 29 == 0, F.lit(None)).otherwise(F.sha2("text", 256)).alias("content_hash"), "text")
    return G.provenance(rows, "provenance", "row_id", "parent", "row_split", s, "seed_id", {"sft_train": "train_seed", "sft_dev": "dev_seed", "final_eval": "final_eval_seed"}, ["family", "risk"], F.sha2("text", 256), "content_hash")


_SECTIONS = "[{'type': CASE WHEN doc_id % 4 = 0 THEN 'safe_step' ELSE 'red_flag' END, 'claim_ids': claim_ids[1:1]}, {'type': CASE WHEN doc_id % 31 = 0 THEN 'odd' ELSE 'style' END, 'claim_ids': CASE WHEN doc_id % 6 = 0 THEN ['srcX'] ELSE claim_ids END}]"


@query(f"""WITH {_SEEDS}, {_CLAIM_SQL}, r AS (SELECT doc_id, seed_id, claim_ids, CASE WHEN doc_id % 8 = 0 THEN claim_ids[1:1] ELSE list_reverse(claim_ids) END AS own, {_SECTIONS} AS sections FROM seeds), x AS (SELECT seed_id, claim_ids, unnest(sections) AS s FROM r)
{_out('fidelity', 'seed_id', "'claim_mismatch'")} FROM r WHERE NOT (list_has_all(own, claim_ids) AND list_has_all(claim_ids, own)) UNION ALL
{_out('fidelity', 'seed_id', "unnest(list_filter([CASE WHEN NOT list_has_all(claim_ids, s.claim_ids) THEN 'unsupported_claims' END, CASE WHEN s.type = 'safe_step' AND NOT list_has_any(s.claim_ids, (SELECT list(claim_id) FROM claims WHERE role = 'care')) THEN 'lacks_care_claim' END, CASE WHEN s.type = 'odd' THEN 'unknown_section' END], lambda v: v IS NOT NULL))", 's.type')} FROM x""")
def gate_fidelity(t):
    s, m = _seeds(t), F.col("doc_id")
    section = lambda kind, ids: F.struct(kind.alias("type"), ids.alias("claim_ids"))
    sections = F.array(section(F.when(m % 4 == 0, "safe_step").otherwise("red_flag"), F.slice("claim_ids", 1, 1)), section(F.when(m % 31 == 0, "odd").otherwise("style"), F.when(m % 6 == 0, F.array(F.lit("srcX"))).otherwise(F.col("claim_ids"))))
    rows = s.select(F.col("seed_id").alias("row_id"), "seed_id", F.when(m % 8 == 0, F.slice("claim_ids", 1, 1)).otherwise(F.reverse("claim_ids")).alias("own"), sections.alias("sections"))
    return G.fidelity(rows, "fidelity", "row_id", "seed_id", "own", s.select(F.col("seed_id").alias("key"), "claim_ids"), "key", "claim_ids", "sections", _claims(t).where("role = 'care'"))


def _drift_sql(pattern, negation, reach):
    return f"""SELECT seed_id, w FROM (SELECT seed_id, text, m[i] AS w, length(array_to_string(p[1 : i], '')) + length(array_to_string(m[1 : i - 1], '')) AS s FROM (SELECT seed_id, text, regexp_extract_all(text, '(?i){pattern}') AS m, string_split_regex(text, '(?i){pattern}') AS p, unnest(range(1, len(regexp_extract_all(text, '(?i){pattern}')) + 1)) AS i FROM seeds)) WHERE NOT regexp_matches(substring(text, greatest(s - {reach}, 0) + 1, s + length(w) + {reach} - greatest(s - {reach}, 0)), '(?i){negation}')"""


@query(f"""WITH {_SEEDS}, h AS ({_drift_sql('thing|password', 'the |und', 20)} UNION ALL {_drift_sql('ung', 'the |und', 20)}) {_out('drift', 'seed_id', "'unsafe_advice'", 'w')} FROM h""")
def gate_drift(t):
    return G.drift(_seeds(t), "drift", F.col("seed_id"), F.col("text"), ["thing|password", "ung"], "the |und", 20)


@query(f"""WITH {_SEEDS} {_out('calibration', 'seed_id', "unnest(list_filter([CASE WHEN risk = 'red' AND NOT regexp_matches(lower(text), 'tion|ung') THEN 'red_lacks_escalation' END, CASE WHEN risk = 'yellow' AND NOT (contains(lower(text), '!!') OR contains(lower(text), 'the')) THEN 'yellow_lacks_monitoring' END], lambda x: x IS NOT NULL))")} FROM seeds UNION ALL
{_out('calibration', "'all'", "'green_over_referral'", "r || '/' || n")} FROM (SELECT count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'heit|tion')) AS r FROM seeds WHERE risk = 'green') WHERE r > 0.1 * n""")
def gate_calibration(t):
    return G.calibration(_seeds(t), "calibration", F.col("seed_id"), F.col("text"), F.col("risk"), "tion|ung", ("!!", "the"), "heit|tion")


@query(f"""WITH {_SEEDS}, v AS (SELECT unnest(['structure', 'opening']) AS n, unnest([shape || risk, left(opening, 3)]) AS v, unnest([0.18::DOUBLE, 0.05::DOUBLE]) AS share FROM seeds), c AS (SELECT n, share, v, count(*) AS c FROM v GROUP BY ALL)
{_out('collapse', 'n', "'dominant'", "max(c) || '/' || sum(c)::BIGINT")} FROM c GROUP BY n, share HAVING max(c) > sum(c) * share UNION ALL
{_out('collapse', 'family', "unnest(list_filter([CASE WHEN count(*) <> 20 THEN 'rows_per_parent' END, CASE WHEN count(DISTINCT left(opening, 2)) < count(*) THEN 'repeated:opening' END, CASE WHEN count(DISTINCT coalesce(closing, '')) < count(*) THEN 'repeated:closing' END], lambda x: x IS NOT NULL))", 'count(*)')} FROM seeds GROUP BY family""")
def gate_collapse(t):
    s = _seeds(t)
    shares = {"structure": (F.concat("shape", "risk"), packs.COLLAPSE["large"][0]), "opening": (F.substring("opening", 1, 3), 0.05)}
    return G.collapse(s, "collapse", shares).unionByName(G.unique_within(s, "collapse", "family", 20, {"opening": F.substring("opening", 1, 2), "closing": F.col("closing")}))


@query(f"""WITH {_SEEDS} {_out('naturalness', "'all'", "'rejection_rate'", "r || '/' || n")} FROM (SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(lower(text), 'die|les|los') OR regexp_matches(lower(text), 'thing')) AS r FROM seeds WHERE style = 'hinglish') WHERE r > 0.01 * n""")
def gate_naturalness(t):
    lower = F.lower("text")
    return G.rejection_rate(_seeds(t), "naturalness", F.col("style") == "hinglish", ~lower.rlike("die|les|los") | lower.rlike("thing"), 0.01)


GATES = ["shapes", "species", "language", "bad_cases", "naturalness", "silent"]


@query(f"""WITH {_SEEDS}, g AS (SELECT 'species' AS gate, count(*) AS n FROM (SELECT unnest(list_filter({_SPECIES_RULES}, lambda x: x IS NOT NULL)) FROM seeds) UNION ALL SELECT 'silent', 0) SELECT gate, n::BIGINT AS errors, n = 0 AS valid FROM g""")
def validation_verdict(t):
    """Gates joined to a verdict; a gate without findings is valid."""
    return G.verdict(gate_species(t), ["species", "silent"])


@query(f"""WITH {_SEEDS}, e AS (SELECT seed_id, family, bucket, split, style, shape, text, list_sort(list_distinct(list_filter([CASE WHEN risk = 'red' THEN 'red_risk' END, CASE WHEN bucket = 'fr' THEN 'fr' END, CASE WHEN doc_id % 21 = 0 THEN 'source_fallback_or_blocker' END, CASE WHEN regexp_matches(text, 'password') THEN 'term:secret' END, CASE WHEN list_contains(tags, 'odd') THEN 'tag:odd' END], lambda x: x IS NOT NULL))) AS r FROM seeds),
m AS (SELECT seed_id, unnest(r) AS r FROM e), c AS (SELECT min(seed_id) AS seed_id, 'positive_care_cluster_representative' AS r FROM e GROUP BY left(text, 4)), p AS (SELECT min(seed_id) AS seed_id, 'seed_representative' AS r FROM e WHERE len(r) = 0 GROUP BY family),
o AS (SELECT * FROM m UNION ALL SELECT * FROM c UNION ALL SELECT * FROM p), l AS (SELECT * FROM e WHERE len(r) = 0 AND seed_id NOT IN (SELECT seed_id FROM o)),
x AS (SELECT seed_id, 'stratified_optional_40_percent' AS r FROM (SELECT seed_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY split, bucket, shape ORDER BY sha256('76044:' || seed_id), seed_id) AS k FROM l WINDOW w AS (PARTITION BY split, bucket, shape)) WHERE k <= greatest(1, floor(n * 0.4::DOUBLE + 0.999::DOUBLE)))
SELECT seed_id, array_to_string(list_sort(list_distinct(list(r))), ',') AS reasons FROM (SELECT * FROM o UNION ALL SELECT * FROM x) GROUP BY seed_id""")
def review_selection(t):
    s = _seeds(t)
    reasons = G.review_reasons(F.col("risk"), F.col("bucket"), F.col("tags"), F.col("text"), ("odd",), ("fr",), {"secret": "password"}, F.col("doc_id") % 21 == 0)
    out = G.review_selection(s.withColumn("r", reasons), "seed_id", "r", F.substring("text", 1, 4), "family", ["split", "bucket", "shape"])
    return out.select("seed_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_SEEDS}, f AS (SELECT CASE WHEN risk = 'red' THEN 'critical' ELSE 'major' END AS severity FROM seeds WHERE regexp_matches(text, 'password|!!')) SELECT count(*)::BIGINT AS blocking, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'major')::BIGINT AS major, CASE WHEN count(*) > 0 THEN 'repair_required' ELSE 'approved_for_pilot_eval_only' END AS decision FROM f")
def review_decision(t):
    found = _seeds(t).where(F.col("text").rlike("password|!!")).select(F.when(F.col("risk") == "red", "critical").otherwise("major").alias("severity"))
    return G.decision(found, "reviewer")


@query(f"WITH {_SEEDS} SELECT f AS family, c AS category, (SELECT count(*) FROM seeds WHERE family = f AND risk = c)::BIGINT AS hits, (SELECT count(*) FROM seeds WHERE family = f AND risk = c) = 0 AS pass FROM (VALUES ('src3', 'red'), ('src4', 'yellow'), ('srcX', 'red')) v(f, c)")
def readiness_regressions(t):
    return G.known_regressions(_seeds(t), "family", "risk", {"src3": "red", "src4": "yellow", "srcX": "red"})


@query(f"WITH {_SEEDS}, e AS (SELECT DISTINCT family, unnest(tags) AS tag FROM seeds) SELECT probe, coalesce((SELECT array_to_string(list_sort(list(family))[1:10], ',') FROM e WHERE e.tag = v.tag), '') AS parents FROM (VALUES ('p1', 'en'), ('p2', 'odd'), ('p3', 'nothing')) v(probe, tag)")
def adversarial_probes(t):
    return G.probes(_seeds(t), "tags", "family", {"p1": "en", "p2": "odd", "p3": "nothing"}).select("probe", F.array_join("parents", ",").alias("parents"))


@query(f"""WITH {_SEEDS}, c AS (SELECT step, r, n, lag(n) OVER (PARTITION BY r ORDER BY step) AS p FROM (SELECT doc_id % 3 AS step, risk AS r, count(*)::BIGINT AS n FROM seeds GROUP BY ALL)) SELECT step, r AS category, n, coalesce(n - p, n) AS change, (count(*) OVER (PARTITION BY r)) >= 2 AS recurring FROM c""")
def readiness_trend(t):
    """Blockers of each iteration beside the one before it, and what recurs."""
    from pyspark.sql import Window

    n = _seeds(t).groupBy((F.col("doc_id") % 3).alias("step"), F.col("risk").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category")
    return n.select("step", "category", "n", F.coalesce(F.col("n") - F.lag("n").over(w.orderBy("step")), F.col("n")).alias("change"), (F.count(F.lit(1)).over(w) >= 2).alias("recurring"))


_PARTS = r"""p AS (SELECT source AS family, doc_id, len(w[i * 675 + 1 : i * 675 + 750])::BIGINT AS n, sha256(array_to_string(w[i * 675 + 1 : i * 675 + 750], ' ')) AS h FROM (SELECT source, doc_id, w, unnest(range(0, CASE WHEN len(w) <= 750 THEN 1 ELSE 1 + ceil((len(w) - 750) / 675.0)::INT END)) AS i FROM (SELECT source, doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)) WHERE len(w[i * 675 + 1 : i * 675 + 750]) >= 20)"""


@query(f"WITH {_PARTS}, k AS (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM p) SELECT family, count(*)::BIGINT AS chunks, sum(n)::BIGINT AS tokens, count(*) FILTER (c > 1)::BIGINT AS repeated, round(sum(n)::DOUBLE / (SELECT sum(n) FROM p)::DOUBLE, 6) AS share, round(sum(n)::DOUBLE / (SELECT sum(n) FROM p)::DOUBLE, 6) > 0.06 AS dominant FROM k GROUP BY family")
def corpus_audit(t):
    from millrace.sources.shared import written

    parts = C.chunked(t("documents").select(F.struct("doc_id", "source").alias("id"), "text"), "id", "text", least=20)
    parts = written(parts.select(F.col("id.source").alias("family"), "n_words", "content_hash"), "audit")
    return G.audit(parts, "family", "n_words", "content_hash", 0.06)


@query("SELECT (n + least(40, 60 - n))::BIGINT AS n, (n + least(40, 60 - n))::BIGINT AS chunks, n::BIGINT AS topical FROM (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(list_filter([lang, CASE WHEN n_chars > 1000 THEN 'long' END, source], lambda x: x IS NOT NULL)) AS x FROM documents))")
def question_bank(t):
    """As many probes as topics, then chunks in order; here counted, tests hold the choice itself."""
    topics = F.array_compact(F.array("lang", F.when(F.col("n_chars") > 1000, "long"), "source"))
    c = t("documents").select("doc_id", topics.alias("topics"), "text")
    out = G.question_bank(c, "doc_id", "topics", "text", ("cloze", "qa", "order", "odd"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("chunks"), F.count_if(F.col("topic") != "any").alias("topical"))


@query(f"WITH {_SEEDS} SELECT split, count(*)::BIGINT AS rows, count(DISTINCT family)::BIGINT AS families, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens, array_to_string(list_sort(list(DISTINCT risk)), ',') AS risks FROM seeds GROUP BY split")
def split_summary(t):
    s = _seeds(t)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("family").alias("families"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.array_join(F.array_sort(F.collect_set("risk")), ",").alias("risks"))


@query(f"""WITH {_SEEDS}, a AS (SELECT count(*) FILTER (risk = 'green') AS ok, bool_or(bucket = 'en' AND risk = 'green') AS home, bool_or(bucket = 'xx') AS abroad, count(*) FILTER (species = 'ox' AND risk <> 'red') AS bad FROM seeds) SELECT ok::BIGINT AS accepted, array_to_string(list_filter([CASE WHEN ok < 12 THEN 'few_accepted' END, CASE WHEN NOT home THEN 'missing_home' END, CASE WHEN NOT abroad THEN 'missing_abroad' END, CASE WHEN bad > 0 THEN 'untrusted_not_rejected' END], lambda x: x IS NOT NULL), ',') AS errors FROM a""")
def catalog_gates(t):
    """Quality and safety gates of a catalogue as one row with its errors."""
    a = _seeds(t).agg(F.count_if(F.col("risk") == "green").alias("ok"), F.bool_or((F.col("bucket") == "en") & (F.col("risk") == "green")).alias("home"), F.bool_or(F.col("bucket") == "xx").alias("abroad"), F.count_if((F.col("species") == "ox") & (F.col("risk") != "red")).alias("bad"))
    errors = F.array_compact(F.array(F.when(F.col("ok") < packs.CATALOG_GATES["accepted"], "few_accepted"), F.when(~F.col("home"), "missing_home"), F.when(~F.col("abroad"), "missing_abroad"), F.when(F.col("bad") > 0, "untrusted_not_rejected")))
    return a.select(F.col("ok").alias("accepted"), F.array_join(errors, ",").alias("errors"))


@query(f"WITH {_SEEDS}, s AS (SELECT seed_id, i, unnest(ids) AS claim_id FROM (SELECT seed_id, unnest([0, 1]) AS i, unnest([claim_ids[1:1], claim_ids]) AS ids FROM seeds)), {_CLAIM_SQL} SELECT s.seed_id, s.i::INT AS section, s.claim_id, coalesce(role, 'unknown') AS role, coalesce(NOT blocked, false) AS usable FROM s LEFT JOIN claims USING (claim_id)")
def review_claim_spans(t):
    """A row per section and claim, with the claim's role."""
    s = _seeds(t).select("seed_id", F.posexplode(F.array(F.slice("claim_ids", 1, 1), F.col("claim_ids"))).alias("section", "ids")).select("seed_id", "section", F.explode("ids").alias("claim_id"))
    return s.join(F.broadcast(_claims(t)), "claim_id", "left").select("seed_id", "section", "claim_id", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce(~F.col("blocked"), F.lit(False)).alias("usable"))

