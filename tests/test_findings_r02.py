"""What round 2 found: queries against their SQL on rows where they differed."""

import duckdb

import __spark_entry__ as entry

SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn int, role string, text string", "pages": "page_id long, url string, html string"}
NUMBERED = "0 at first. 1 is 1 and 1\n 2nd line 2. 10 ends with 2. 31 letters in this sentence 3. \n 0 | x . "


def documents(*texts, langs="en"):
    return [(k, x, langs if isinstance(langs, str) else langs[k], "src1", len(x or "")) for k, x in enumerate(texts)]


def same(spark, folder, name, **tables):
    """The query's rows on these tables, which are those of its SQL."""
    duck = duckdb.connect()
    for t, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[t]).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    out = entry.queries()[name](spark, str(folder))
    want = duck.sql(f"SELECT {', '.join(out.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
    return got

def test_f11_sentences_keep_their_digits(spark, tmp_path):
    same(spark, tmp_path, "doc_strip_sentences", documents=documents(NUMBERED, " 0 ", "", None))


def test_f2_contexts_keep_the_digits_of_their_facts(spark, tmp_path):
    same(spark, tmp_path, "context_composed", documents=documents("007 a\n 1 b 1\n1 B 1\nc", " 0\n0", "x"), labels=[(0, 1, 0), (1, 0, 0), (2, 1, 1)])


def test_f3_a_stop_before_a_line_feed_is_no_end(spark, tmp_path):
    same(spark, tmp_path, "conversation_titles", conversations=[(0, 0, "user", "Ends here.\n"), (1, 0, "user", "Ends here."), (2, 0, "user", "No end"), (2, 1, "assistant", "b")])


def test_f4_lines_keep_their_digits(spark, tmp_path):
    same(spark, tmp_path, "doc_boilerplate_lines", documents=documents(" 007 \n1 of 1\n 2", "Licensed under\n1", ""))


def test_f5_clean_text_keeps_digits(spark, tmp_path):
    same(spark, tmp_path, "doc_clean_text", documents=documents(NUMBERED, "0 password=1. 1 x 1"))


def test_f6_openings_keep_their_zeros(spark, tmp_path):
    rows = same(spark, tmp_path, "gen_answers", documents=documents("0997 | a. b", "00. c"), labels=[(0, 1, 0), (1, 1, 0)])
    assert {r[2].split("\n")[0] for r in rows} == {"0997 | a.", "00."}


def test_f7_endings_are_judged_in_their_case(spark, tmp_path):
    rows = [(k, turn, role, x) for k, a in enumerate(("Tion lyed.", "a nation.", "UNG", "Achtung")) for turn, role, x in ((0, "user", "the one"), (1, "assistant", a))]
    assert sorted(r[2] for r in same(spark, tmp_path, "inference_record", conversations=rows)) == ["Tion lyed.", "UNG", "blocked", "blocked"]


HTML = ("<html><p>and&amp;&amp to &copy 5 &ltx &lt;y &amp;lt; &#39;z&#39;</p>", "<html><p>a &amp</p>", "<html>b &nbsp;c&middot;d")


def test_f8_references_without_a_semicolon_stay(spark, tmp_path):
    same(spark, tmp_path, "page_html_to_text", pages=[(k, f"https://a/{k}.html", h) for k, h in enumerate(HTML)])


def test_f8_ended_references_are_all_decoded(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as T

    df = spark.createDataFrame([("&eacute; &#233; &#xE9; &bogus; &notit; &amp;lt; &amp x",)], "t string")
    assert df.select(T.unescape(F.col("t"), ended=True)).first()[0] == "é é é &bogus; &notit; &lt; &amp x"


def test_f10_short_sentences_keep_digits(spark, tmp_path):
    texts = ("0 thirty letters are in this one. 1 x", "The first one of thirty letters and more 1! 1 and thirty letters there 1.", "19.37.233.111", "\u2028 of thirty letters and then one.\u2028", "", None)
    same(spark, tmp_path, "doc_short_sentence", documents=documents(*texts))


def test_f9_sentences_are_measured_whole(spark, tmp_path):
    same(spark, tmp_path, "doc_shape_predicates", documents=documents("0" + "x" * 28 + ".", "a. " + "1" * 100 + "x" * 30 + ".", "x" * 40 + ".\u2028"), labels=[(0, 1, 0)])


def test_f12_extracted_pages_as_their_sql(spark, tmp_path):
    same(spark, tmp_path, "source_extract_text", pages=[(k, f"https://a/{k}.html", h) for k, h in enumerate(HTML)], documents=documents("a &amp b"))


def test_f13_a_text_of_several_languages_counts_in_its_smallest(spark, tmp_path):
    assert sorted(r[:2] for r in same(spark, tmp_path, "stream_arrivals_once", documents=documents("a", "a", "a", "b", "c", "c", langs=["fr", "es", "de", "fr", "en", "fr"]))) == [("de", 1), ("en", 1), ("fr", 1)]


def test_f14_neighbours_are_compared_whole(spark, tmp_path):
    assert same(spark, tmp_path, "window_sentence_lag", documents=documents("000. ab.", "ab. 111."))[0][1] is not None


def test_f15_first_letters_and_sentences(spark, tmp_path):
    same(spark, tmp_path, "doc_normal_forms", documents=documents("ßheit. 19.37.233.111", "0 a. 1 b 1", "ŉa ΑΣ", "ᾳ İX", "ﬁx", "éA", "", "x"))


def near_texts(n, words, changed, seed=1):
    """n texts of so many words, each but for a few of its own."""
    import random

    r = random.Random(seed)
    base = ["".join(r.choices("abcdefgh", k=6)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in r.sample(range(words), changed):
            own[k] = "".join(r.choices("abcdefgh", k=6))
        out.append(" ".join(own))
    return out


def test_f1_texts_without_a_language_are_near_nothing(spark, tmp_path):
    texts = near_texts(4, 200, 1)
    rows = same(spark, tmp_path, "doc_near_dup_pairs", documents=documents(*texts, *texts[:2], "", None, None, langs=[None, None, "en", "en", None, "de", "de", "en", "en"]))
    assert sorted(r[0] for r in rows) == ["exact", "exact", "near"]


def test_f1_sets_are_not_stored(spark, tmp_path):
    from pathlib import Path

    texts = [x for k in range(60) for x in near_texts(1, 600, 0, k)]
    before = set(Path(spark.conf.get("spark.checkpoint.dir", "file:///nowhere").removeprefix("file://")).glob("millrace-near-*"))
    same(spark, tmp_path, "doc_near_dup_pairs", documents=documents(*texts, texts[1]))
    new = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("millrace-near-*")) - before
    assert new and sum(f.stat().st_size for d in new for f in d.rglob("*.parquet")) < 1.5 * sum(map(len, texts))


def test_f1_groups_cut_into_blocks_lose_no_pair(spark, tmp_path, monkeypatch):
    from millrace.operators import curate

    monkeypatch.setattr(curate, "GROUP_GRAMS", 3_000)
    monkeypatch.setattr(curate, "GROUP_PAIRS", 20)
    texts = [*near_texts(30, 250, 1), *near_texts(12, 80, 1, 2), *near_texts(12, 20, 1, 3), "a b", "a b c", "", "x"]
    assert len(same(spark, tmp_path, "doc_near_dup_pairs", documents=documents(*texts))) > 100


def test_f1_near_sets_share_a_signature():
    import random

    import numpy as np

    from millrace.functions import sets

    r, kinds, near = random.Random(5), sets.Signatures(0.96), 0
    fresh = lambda n: np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
    for m in [*range(1, 120), 300, 1_000, 4_000]:
        for _ in range(12):
            a, most = np.unique(fresh(m)), int(0.0205 * 2 * m) + 1
            lost = min(r.randint(0, most), m - 1)
            b = np.unique(np.concatenate((a[r.sample(range(m), m - lost)], fresh(r.randint(0, most - lost if most > lost else 0)))))
            shared = len(np.intersect1d(a, b))
            if shared > 0.96 * (len(a) + len(b) - shared):
                (a0, a1), (b0, b1) = (tuple(set(x.tolist()) for x in kinds.of(s)) for s in (a, b))
                assert a0 & b0 or a0 & b1 or a1 & b0
                near += 1
    assert near > 500


ODD = (None, "", "one. \x0btwo! three", "one.\x0btwo. three", "a\x01b. c\x01", "one\x0btwo \r three.\rfour\r\nfive. six", "x" * 20 + "\x01" + "y" * 31 + ".", "x" * 40 + ".\x0b" + "y" * 40 + "! z.")


def test_f5_clean_text_of_missing_and_odd_texts(spark, tmp_path):
    rows = dict(r[:2] for r in same(spark, tmp_path, "doc_clean_text", documents=documents(*ODD, "\rLicensed under\x0b1\n\x0bLicensed under 2. 3")))
    assert rows[0] is None and rows[1] is not None


def test_f6_answers_of_missing_and_odd_texts_and_negative_ids(spark, tmp_path):
    rows = [(k - 9, x, "en", "src1", 1) for k, x in enumerate((*ODD, "0. 1", "0\x0b1.\x0b2", "00"))]
    got = dict(r[:2] for r in same(spark, tmp_path, "gen_answers", documents=rows, labels=[(k, k % 2, 1) for k in range(-9, 3)]))
    assert got["s-1"] == got["s0"] == "step>red_flag>boundary"


def test_f14_rows_of_one_id_are_one_row(spark, tmp_path):
    texts = [(1, "abc. ab. a.")] * 3 + [(2, "a. bb. c.")] * 2 + [(None, "bb. a.")] * 2 + [(3 + k, x) for k, x in enumerate(ODD)]
    got = same(spark, tmp_path, "window_sentence_lag", documents=[(k, x, "en", "src1", 1) for k, x in texts])
    assert {(1, 2), (2, 1), (None, 1)} < set(got)


def test_f9_shapes_of_missing_and_odd_texts(spark, tmp_path):
    same(spark, tmp_path, "doc_shape_predicates", documents=documents(*ODD), labels=[(k, (None, 0, 1)[k % 3], 0) for k in range(1, 7)] + [(7, 1, 0), (7, 0, 0)])


def test_f9_texts_stay_out_of_the_join(spark, tmp_path):
    d = documents("a. b", "c")
    spark.createDataFrame(d, SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("doc_shape_predicates", "gen_answers"):
        plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
        while not plan.nodeName().startswith("Join"):
            plan = plan.children().head()
        assert "text" not in [plan.children().head().output().apply(k).name() for k in range(plan.children().head().output().size())]
