"""Queries on generated rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import rows as W
from millrace.functions import text as T
from millrace.operators import generate as N
from millrace.plans.gating import _SEEDS, _out, _seeds
from millrace.plans.registry import query

RULES = [("en", ("c1", "c2")), ("odd", ("c2", "c3")), ("long", ("c4",))]


@query(f"WITH {_SEEDS} SELECT seed_id, CASE WHEN len(x) = 0 THEN 'c0' ELSE array_to_string(x, ',') END AS claims FROM (SELECT seed_id, list_filter(['c1', 'c2', 'c3', 'c4'], lambda c: (c IN ('c1', 'c2') AND list_contains(tags, 'en')) OR (c IN ('c2', 'c3') AND list_contains(tags, 'odd')) OR (c = 'c4' AND list_contains(tags, 'long'))) AS x FROM seeds)")
def gen_claims(t):
    return _seeds(t).select("seed_id", F.array_join(N.claims_for(F.col("tags"), RULES, ("c0",)), ",").alias("claims"))


@query(f"WITH {_SEEDS} SELECT seed_id, CASE WHEN cluster = 'src1:en' THEN 'own' WHEN contains(cluster, 'src1') THEN 'teens' WHEN contains(cluster, ':de') THEN 'german' ELSE 'plain' END AS profile, ['a', 'b', 'c'][(('0x' || substr(sha256(seed_id), 1, 8))::BIGINT % 3 + 1)::INT] AS chosen FROM seeds")
def gen_profiles(t):
    chosen = F.element_at(F.array(*map(F.lit, "abc")), (W.hash_choice(F.col("seed_id"), 3) + 1).cast("int"))
    return _seeds(t).select("seed_id", N.profile(F.col("cluster"), {"src1:en": "own"}, [("src1", "teens"), (":de", "german")], "plain").alias("profile"), chosen.alias("chosen"))


@query(f"WITH {_SEEDS} SELECT seed_id || '_' || v || '_' || p AS row_id, species || '/' || p || '/' || v AS note FROM seeds, range(3) r(v), (SELECT unnest(['ask', 'tell', 'photo']) AS p)")
def gen_expansion(t):
    out = N.expanded(_seeds(t).select("seed_id", "species"), "seed_id", 3, ["ask", "tell", "photo"])
    return out.select("row_id", W.rendered("{species}/{template}/{variant}", species=F.col("species"), template=F.col("template"), variant=F.col("variant")).alias("note"))


@query(f"WITH {_SEEDS} SELECT seed_id, array_to_string(list_filter(['step', CASE WHEN risk <> 'green' THEN 'red_flag' END, CASE WHEN style = 'english' THEN 'boundary' END], lambda x: x IS NOT NULL), '>') AS structure, array_to_string(list_filter([opening, CASE WHEN risk <> 'green' THEN 'Watch ' || species || '.' END, CASE WHEN style = 'english' THEN 'Do not guess.' END], lambda x: x IS NOT NULL), chr(10)) AS text FROM seeds WHERE opening <> ''")
def gen_answers(t):
    s = _seeds(t).where("opening <> ''")
    watch = F.when(F.col("species").isNotNull(), W.rendered("Watch {species}.", species=F.col("species")))
    a = N.answer([("step", F.lit(True), F.col("opening")), ("red_flag", F.col("risk") != "green", watch), ("boundary", F.col("style") == "english", F.lit("Do not guess."))])
    return s.select("seed_id", a.alias("a")).select("seed_id", "a.structure", "a.text")


@query(f"""WITH {_SEEDS}, k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM seeds), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM seeds WHERE risk = 'red'),
p AS (SELECT i, CASE WHEN i < 30 THEN 'fallback' WHEN i < 70 THEN 'red_escalation' ELSE ['routine', 'myth_refusal'][((i - 70) % 2 + 1)::INT] END AS category FROM range(200) x(i))
SELECT i AS place, category, CASE WHEN category = 'red_escalation' THEN (SELECT doc_id FROM r WHERE r.k = i % r.n) ELSE (SELECT doc_id FROM k WHERE k.k = i % k.n) END AS doc_id FROM p""")
def gen_quota_rows(t):
    return N.quota_rows(_seeds(t), "doc_id", F.col("risk") == "red", [("fallback", 30), ("red_escalation", 40)], ["routine", "myth_refusal"], 200)


@query(f"""WITH {_SEEDS}, n AS (SELECT count(*) AS t FROM seeds) {_out('shares', 'bucket', "'over_share:category'", 'count(*)')} FROM seeds GROUP BY bucket HAVING count(*) > 0.2::DOUBLE * (SELECT t FROM n) UNION ALL {_out('shares', 'risk', "'over_share:risk'", 'count(*)')} FROM seeds GROUP BY risk HAVING count(*) > 0.4::DOUBLE * (SELECT t FROM n)
UNION ALL {_out('shares', 'v', "'under_share'", 'n')} FROM (SELECT v, share, (SELECT count(*) FROM seeds WHERE bucket = v) AS n FROM (VALUES ('fr', 0.15::DOUBLE), ('xx', 0.1::DOUBLE)) w(v, share)) WHERE n < share * (SELECT t FROM n)""")
def gate_shares(t):
    return N.share_gates(_seeds(t), "shares", "bucket", "risk", least={"fr": 0.15, "xx": 0.1})


@query("WITH a AS (SELECT ['source', 'safety', 'language', 'other'][(doc_id % 4 + 1)::INT] AS role, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'now' END AS checksum, CASE WHEN doc_id % 5 > 0 THEN 'x' END AS approver, CASE WHEN doc_id % 7 > 0 THEN '2024-05-01T10:00:00Z' ELSE 'May' END AS stamp, CASE WHEN doc_id % 2 > 0 THEN quality = 1 END AS approved FROM labels) SELECT 'approvals' AS gate, role AS entity_id, unnest(list_filter([CASE WHEN approved IS DISTINCT FROM true THEN 'not_approved' END, CASE WHEN approver IS NULL THEN 'unnamed' END, CASE WHEN checksum <> 'now' THEN 'stale_checksum' END, CASE WHEN stamp = 'May' THEN 'bad_time' END], lambda x: x IS NOT NULL)) AS code, '' AS detail FROM a UNION ALL SELECT 'approvals', 'eval', 'missing_approval', ''")
def gate_approvals(t):
    m = F.col("doc_id")
    role = F.element_at(F.array(*map(F.lit, ("source", "safety", "language", "other"))), (m % 4 + 1).cast("int"))
    given = t("labels").select(role.alias("role"), F.when(m % 3 == 0, "old").otherwise("now").alias("checksum"), F.when(m % 5 > 0, "x").alias("approver"), F.when(m % 7 > 0, "2024-05-01T10:00:00Z").otherwise("May").alias("at"), F.when(m % 2 > 0, F.col("quality") == 1).alias("approved"))
    return N.approvals(given, "approvals", ("source", "safety", "language", "eval"), F.lit("now"))


@query(f"""WITH {_SEEDS}, c AS (SELECT s, count(*) AS n FROM (SELECT CASE split WHEN 'dev_seed' THEN 'sft_dev' ELSE 'sft_train' END AS s FROM seeds) GROUP BY s), w AS (SELECT s, CASE WHEN (SELECT count(*) FROM seeds) > 300 THEN f ELSE p END AS w FROM (VALUES ('sft_train', 210, 1050), ('sft_dev', 45, 225), ('final_eval', 45, 225)) v(s, p, f)) {_out('phase', 'w.s', "'row_count'", "coalesce(n, 0) || ' of ' || w")} FROM w LEFT JOIN c ON c.s = w.s WHERE coalesce(n, 0) <> w""")
def gate_phase(t):
    s = _seeds(t).withColumn("s", F.when(F.col("split") == "dev_seed", "sft_dev").otherwise("sft_train"))
    return N.phase_gate(s, "phase", "s")


@query(f"WITH {_SEEDS} SELECT seed_id, length(p)::BIGINT AS n, sha256(p) AS prompt FROM (SELECT seed_id, 'Judge.' || chr(10) || chr(10) || 'RUBRIC:' || chr(10) || '{{\"id\":\"' || seed_id || '\",\"risk\":\"' || risk || '\",\"tags\":[' || array_to_string(list_transform(tags, lambda x: '\"' || x || '\"'), ',') || ']}}' || chr(10) || chr(10) || 'ASSISTANT_ANSWER:' || chr(10) || text || chr(10) AS p FROM seeds)")
def judge_prompts(t):
    p = N.judge_prompt({"id": F.col("seed_id"), "risk": F.col("risk"), "tags": F.col("tags")}, F.col("text"), "Judge.")
    return _seeds(t).select("seed_id", F.length(p).cast("long").alias("n"), F.sha2(p, 256).alias("prompt"))


@query(f"WITH {_SEEDS} SELECT seed_id, s AS mode, reverse(left(prompt, 12)) || CASE WHEN s = 'with' THEN '+' ELSE '' END AS answer FROM seeds, (SELECT unnest(['without', 'with']) AS s)")
def generated_answers(t):
    """Every prompt with and without evidence, answered by a plugged-in function."""
    s = _seeds(t).withColumn("mode", F.explode(F.array(F.lit("without"), F.lit("with"))))
    prompt = F.concat(F.substring("prompt", 1, 12), F.when(F.col("mode") == "with", "\x00").otherwise(""))
    return N.generated(s, prompt, lambda p: p.rstrip("\x00")[::-1] + ("+" if p.endswith("\x00") else "")).select("seed_id", "mode", "answer")


@query(r"SELECT doc_id, least(len(w), 64)::BIGINT AS n, coalesce(list_sum(list_transform(w[1:64], lambda x: length(x))), 0)::BIGINT AS total FROM (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents)")
def token_lengths(t):
    """A plugged-in tokenizer, here one whose ids are word lengths."""
    out = N.token_ids(t("documents"), F.col("text"), lambda texts: [[len(w) for w in re.findall("[a-zA-Z]+", x)] for x in texts], 64)
    return out.select("doc_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH {_SEEDS}, m AS (SELECT seed_id, style, least(1.0, len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'les', 'los')))::DOUBLE / greatest(len(w), 1) * 4.5) AS mix, len(w) AS n FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM seeds))
{_out('clean_rows', 'seed_id', "unnest(list_filter([CASE WHEN style = 'hinglish' AND mix < 0.38::DOUBLE THEN 'too_little_mix' END, CASE WHEN style = 'english' AND mix > 0.75::DOUBLE THEN 'too_much_mix' END, CASE WHEN n < 5 THEN 'too_short' END], lambda x: x IS NOT NULL))", 'style')} FROM m""")
def gate_clean_rows(t):
    """Rewritten rows by their language mix and length."""
    from millrace.operators.gates import row_rules

    w = T.ascii_tokens(F.col("text"))
    s = _seeds(t).withColumns({"mix": T.language_mix(F.size(F.filter(w, lambda x: x.isin("der", "die", "und", "les", "los"))), F.size(w)), "n": F.size(w)})
    rules = {"too_little_mix": (F.col("style") == "hinglish") & (F.col("mix") < 0.38), "too_much_mix": (F.col("style") == "english") & (F.col("mix") > 0.75), "too_short": F.col("n") < 5}
    return row_rules(s, "clean_rows", F.col("seed_id"), rules, F.col("style"))
