"""Cutting leaks: one Python worker a task, texts as a plain search and cut has them, in one block of the benchmark or many."""

from pyspark.sql import functions as F

from millrace.llm import decontam

LEAK = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
TEXTS = [None, "", "  \n", LEAK, LEAK.upper() + "!", f" before, {LEAK}\x0b after ", f"x {LEAK} y {LEAK} z", f"{LEAK} {LEAK}", LEAK[:-4], "  kept\tas it is \n", "short item", "é short  ITEM é", f"{LEAK} j10 short item"]


def plain(text, items):
    """Every window by sliding over the words, one by one."""
    if text is None:
        return None
    own, hit = decontam.words(text), set()
    for item in items:
        w = decontam.words(item)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            hit.update(x for at in range(len(own) - k + 1) if own[at : at + k] == w[i : i + k] for x in range(at, at + k))
    runs = [x for x in sorted(hit) if x - 1 not in hit]
    return decontam.cut_spans(text, runs, [next(e for e in range(s + 1, len(own) + 1) if e not in hit) for s in runs])


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_search_and_cut_share_a_worker(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    items = [LEAK, "short item", None, ""]
    bench = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(items)], "item_id string, text string")
    want = {k: plain(t, [x or "" for x in items]) for k, t in enumerate(TEXTS)}
    assert want[3] == "" and want[9] == TEXTS[9] and want[11] == "é short  ITEM é".replace("short  ITEM", "")
    cut = decontam.remove_leaks(docs, bench)
    assert cut.columns == docs.columns and dict(map(tuple, cut.collect())) == want
    # a task with two Python nodes holds two workers, and idle ones stay
    assert python_nodes(cut) == 1 and python_nodes(cut.withColumn("n_chars", F.length("text").cast("long"))) == 1
    monkeypatch.setattr(decontam, "ITEM_BYTES", 12)
    assert dict(map(tuple, decontam.remove_leaks(docs, bench).collect())) == want
    assert decontam.remove_leaks(docs, bench.limit(0)).where("doc_id = 3").first().text == LEAK
