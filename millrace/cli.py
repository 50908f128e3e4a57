"""Command line: list and run queries, curate a corpus into state folders with a manifest, score predictions, pack files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import packs
from millrace.functions import text as T
from millrace.operators import curate as C
from millrace.operators import score as S
from millrace.session import session
from millrace.sources import readers, sinks


def curate(spark: SparkSession, source: str, target: str) -> DataFrame:
    """JSON lines (source_id, text) to state folders, chunks and a manifest."""
    rows = readers.read_jsonl(spark, source, "source_id string, text string")
    hard, low, risky = (packs.alternation(p) for p in (packs.HARD_CATALOG, packs.LOW_QUALITY, packs.RISKY_CATALOG))
    state = C.classify(F.col("text"), hard, low, risky)
    judged = rows.withColumns({"state": state["state"], "state_reason": state["reason"], "raw_text_hash": F.sha2("text", 256), "text_preview": F.substring("text", 1, 240)})
    sinks.write_states(judged.drop("text"), f"{target}/sources", "state")
    clean = T.clean_text(F.col("text"), packs.alternation(packs.BOILERPLATE_CATALOG), packs.alternation(packs.RISKY_CATALOG + packs.HARD_CATALOG))
    kept = judged.where("state <> 'reject'").select("source_id", clean["clean"].alias("text"))
    sinks.write_jsonl(C.chunked(kept, "source_id", "text", least=1), f"{target}/chunks")
    return sinks.manifest(spark, {"chunks": f"{target}/chunks"})


def score(spark: SparkSession, rubric: str, predictions: str, systems: list[str]) -> DataFrame:
    """Predictions (eval_id, system, prediction) against a rubric (eval_id, risk_level, must_escalate, must_refuse): a row per system."""
    p = readers.read_jsonl(spark, predictions, "eval_id string, system string, prediction string")
    r = readers.read_jsonl(spark, rubric, "eval_id string, risk_level string, must_escalate boolean, must_refuse boolean")
    i = "(?i)"
    patterns = {"unsafe": i + packs.UNSAFE_SCORE, "safe": i + packs.SAFE_SCORE, "overclaim": i + packs.UNSAFE_REVIEW["image_diagnosis_certainty"], "escalation": i + packs.TRAINED_HELP, "refusal": i + packs.REFUSAL_SCORE, "sale": i + packs.SALE_SCORE, "useful": i + packs.USEFUL_SCORE, "referral": packs.GREEN_REFERRAL}
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    z = S.rubric_score(F.col("prediction"), flag("must_escalate"), flag("must_refuse"), F.col("risk_level") == "green", [], patterns)
    rows = p.where(F.col("system").isin(systems)).join(r, "eval_id").withColumn("z", z)
    metrics = ["unsafe", "overclaim", "escalation_ok", "refusal_ok", "sale_violation", "green_over", "useful"]
    return S.score_summary(rows.select("system", *[F.col(f"z.{m}") for m in ("passed", *metrics)]), metrics)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="write JSON lines there instead of showing rows")
    cur = commands.add_parser("curate", help="JSON lines to state folders, chunks and a manifest")
    cur.add_argument("source")
    cur.add_argument("target")
    sco = commands.add_parser("score", help="predictions against a rubric")
    sco.add_argument("rubric")
    sco.add_argument("predictions")
    sco.add_argument("--systems", default="base,prompted")
    pack = commands.add_parser("pack", help="copy required files into a package and hash them")
    pack.add_argument("target")
    pack.add_argument("files", nargs="+", help="name=path")
    args = parser.parse_args(argv)
    from millrace.plans.catalogue import QUERIES

    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.getActiveSession() or session()
    if args.command == "run":
        out = QUERIES[args.name](spark, args.tables)
        if args.out:
            sinks.write_jsonl(out, args.out)
            return 0
    elif args.command == "curate":
        out = curate(spark, args.source, args.target)
    elif args.command == "score":
        out = score(spark, args.rubric, args.predictions, args.systems.split(","))
    else:
        out = sinks.copy_package(spark, dict(f.split("=", 1) for f in args.files), args.target)
    for row in out.limit(1000).collect():
        print(json.dumps(row.asDict(recursive=True), default=str, sort_keys=True, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
