"""The catalogue against its SQL on small tables, and operators on cases of their own."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text as T
from millrace.operators import curate, evaluate, retrieve
from millrace.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in out.select(*columns).collect()) == plain(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sentences_are_stripped(spark):
    df = spark.createDataFrame([("Keep this. Give 5 mg now. Keep that! Inject it.",), ("",), (None,)], "t string")
    out = [r[0] for r in df.select(T.strip_sentences(F.col("t"), "mg|Inject")).collect()]
    assert [(r.clean, r.removed) for r in out] == [("Keep this. Keep that!", 2), ("", 0), ("", 0)]


def test_chunks_follow_the_loop(spark):
    def loop(n, size=10, overlap=3, least=4):
        out, start = [], 0
        while True:
            end = min(n, start + size)
            if end - start >= least:
                out.append((start, end - start))
            if end == n:
                return out
            start = max(end - overlap, start + 1)

    df = spark.createDataFrame([(n, " ".join(map(str, range(n)))) for n in range(0, 60)], "n int, t string")
    for r in df.select("n", F.transform(T.chunks(F.col("t"), 10, 3, 4), lambda c: F.struct(c["start"], F.size(c["words"]))).alias("c")).collect():
        assert [tuple(x) for x in r.c] == loop(r.n)


def test_unnegated_hits(spark):
    df = spark.createDataFrame([("do not use bleach. " + "x" * 60 + " use bleach",)], "t string")
    assert df.select(T.unnegated_hits(F.col("t"), "bleach", "not")).first()[0] == 1


def test_split_and_caps(spark):
    df = spark.createDataFrame([(i, f"s{i % 9}", "ab"[i % 2]) for i in range(60)], "i int, s string, k string")
    split = {r.s: r.split for r in curate.hash_rank_split(df, "s").collect()}
    assert sorted(split.values()).count("train") == 6 and set(split.values()) == {"train", "dev", "test"}
    chosen = [r.i for r in curate.balance_caps(df, {"s": 2, "k": 7}, "i", 12).collect()]
    assert len(chosen) == 12 and len({i % 9 for i in chosen}) >= 6


def test_json_from_fences(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 2} ok',), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(F.get_json_object(evaluate.extract_json(F.col("t")), "$.a")).collect()]
    assert got == ["1", "2", None, None]


def test_best_by_bm25_are_those_of_all_scores(spark, monkeypatch):
    docs = [(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 9))) for k in range(200)] + [(900, None), (901, ""), (902, "Straße w3 W3"), (None, "w1 w2")]
    d = spark.createDataFrame(docs, "doc long, text string")
    q = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k}") for k in range(12)] + [(50, None), (51, "none of these"), (52, "stra e")], "query long, text string")
    want = retrieve.top_k(retrieve.bm25(q, d.where("doc is not null"), "query", "text", "doc", "text"), "query", "score", "doc", 3)
    for terms, cells in ((retrieve.BLOCK_TERMS, retrieve.CELLS), (7, 30)):
        monkeypatch.setattr(retrieve, "BLOCK_TERMS", terms)
        monkeypatch.setattr(retrieve, "CELLS", cells)
        got = retrieve.bm25_top(q, d.repartition(3), "query", "text", "doc", "text", 3)
        assert plain(tuple(r) for r in got.select(*want.columns).collect()) == plain(tuple(r) for r in want.collect())
    assert retrieve.bm25_top(q.limit(0), d, "query", "text", "doc", "text", 3).count() == retrieve.bm25_top(q, d.limit(0), "query", "text", "doc", "text", 3).count() == 0


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "--"), (4, "a b a b")], "id long, text string")
    out = {r.id: r.vector for r in retrieve.hashed_vectors(rows, "id", "text", 8).collect()}
    assert set(out[2]) == set(out[3]) == {0.0} and all(abs(sum(x * x for x in out[k]) - 1) < 1e-9 for k in (1, 4)) and {len(v) for v in out.values()} == {8}


def test_character_runs_of_any_text(spark):
    texts = ["", "a", "abcd", "abcde", "añ😀bc😀", None, "ab\ncd ef" * 3_000]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, text string")
    out = {r.id: r for r in rows.select("id", T.char_runs(F.col("text"), 5).alias("r"), T.char_grams(F.col("text"), 5).alias("g"), T.gram_counts(F.col("text")).alias("c")).collect()}
    for k, x in enumerate(texts):
        want = [None] if x is None else [x[i : i + 5] for i in range(max(1, len(x) - 4))]
        padded = None if x is None else f"  {x}  "
        assert out[k].r == want and (x is None or (sorted(out[k].g) == sorted(set(want)) and out[k].c == [padded[i : i + 3] for i in range(len(padded) - 2)]))
