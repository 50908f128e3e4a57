"""The registered queries against their SQL, clashing names, repeated ids, hot groups, long rule lists and the pipeline against plain Python."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, decontam, langid, line_dedup, media, mixing, near_dedup, quality, substring_dedup, url_filter
from millrace.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in out.select(*columns).collect()) == plain(want)


def test_url_sql_on_linked_pages(spark, tmp_path):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [("http://a.test/", link("bad.net", "b.test")), ("http://b.test/", link("bad.net", "a.test", "worse.net")), ("http://c.org/fr/", link("b.test", "a.test")), ("http://c.org/de/", None), (None, link("a.test")), ("http://only.test/", link("bad.net"))]
    spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = QUERIES["op1_url_filter"](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op1_url_filter']})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)
    assert {r.verdict for r in got.where("rule is null").collect()} == {"allow", "block"}


def test_long_rule_lists(spark, monkeypatch):
    rules = [("block" if k % 2 else "allow", h, p) for k, (h, p) in enumerate((h, p) for h in ("net", "a.net", "b.a.net", "org", "test") for p in ("/", "/en/", "/en/x", "/de/"))]
    urls = [(k, f"http://{h}{p}") for k, (h, p) in enumerate((h, p) for h in ("a.net", "c.b.a.net", "xnet", "org", "z.test", "A.NET", "net") for p in ("", "/", "/en/", "/en/xy", "/de", "/de/1"))] + [(999, None), (998, "none")]
    pages = spark.createDataFrame([(*u, None) for u in urls], "page_id long, url string, html string")
    short = sorted(map(str, url_filter.filter_urls(pages, rules=rules).select("page_id", "rule", "verdict").collect()))
    monkeypatch.setattr(url_filter, "MAX_RULES", 3)
    assert sorted(map(str, url_filter.filter_urls(pages, rules=rules).select("page_id", "rule", "verdict").collect())) == short


CLASHES = ["_mr_host", "_MR_id", "_mr__x", "_host", "_bad", "_o", "_s", "_rate", "_id", "_runs", "_sign", "_prior_host", "_source", "_class", "_k", "_rule", "_kept", "_found", "_ll", "_own", "key", "node", "id", "sign", "h", "d", "n", "source_", "rank"]
TEXT = " ".join(f"word{i}" for i in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, TEXT + f" end{k}\nline", "en", "ab"[k % 2], f"http://h{k % 2}.test/", "<p>x</p>", *[f"c{k}"] * len(CLASHES)) for k in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, html string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_clashing_names(spark, clashing):
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    models = langid.learn(clashing, "text", "lang")
    outs = {
        "urls": url_filter.filter_urls(clashing), "lines": line_dedup.drop_boilerplate_lines(clashing), "mix": mixing.mix_sources(clashing, keep=True), "leaks": decontam.find_leaks(clashing, bench), "cut": decontam.remove_leaks(clashing, bench),
        "quality": quality.score_quality(clashing, labels), "repeats": substring_dedup.drop_repeats(clashing), "language": langid.identify(clashing, models, host=F.col("source"), declared=F.col("lang")), "media": media.with_media(clashing), "near": near_dedup.drop_near_duplicates(clashing),
    }
    for name, out in outs.items():
        assert set(clashing.columns) <= set(out.columns), name
        rows = out.collect()
        assert len(rows) == (1 if name == "near" else 6) and all(r[c] == f"c{r.doc_id}" for r in rows for c in CLASHES), name
    assert near_dedup.near_duplicates(clashing).count() == 6


def test_made_names_are_replaced(spark):
    own = spark.createDataFrame([(1, TEXT, "a", "x", "x", "x", "x", "x", "x", "x")], "doc_id long, text string, source string, size string, copies string, leak string, repeats string, language string, kept_text string, quality_score string")
    assert mixing.mix_sources(own, keep=True).first()["size"] == 60 and substring_dedup.drop_repeats(own).first().repeats.n_words == 60
    assert line_dedup.drop_boilerplate_lines(own).first().kept_text == TEXT and decontam.find_leaks(own, own.select(F.lit(1).alias("item_id"), "text")).first().leak.n_words == 60


def test_ids_of_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a.upper()), (5, ""), (5, ""), (None, a), (6, "zz"), (6, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, percent=85).collect())
    assert out == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5), (6, 6), (6, 6)]
    kept = sorted(((r.doc_id or 0), r.text) for r in near_dedup.drop_near_duplicates(df).collect())
    assert kept == [(0, a), (1, a), (1, b), (5, ""), (5, ""), (6, "zz")]


def test_copies_and_a_stranger_in_their_buckets(spark, monkeypatch):
    """10 000 near copies and texts that share most buckets with them but no link; one of those is linked to another."""
    base = [f"t{i}" for i in range(150)]
    rows = [(k + 100, " ".join([*base[:-1], f"n{k}"])) for k in range(10_000)]
    far = list(base)
    for e in range(3, 150, 17):
        far[e] = f"s{e}"
    rows += [(1, " ".join(far)), (2, " ".join([*far[:-1], "other"])), (3, " ".join(far[::-1]))]
    sizes = []
    real = near_dedup.cell_pairs
    monkeypatch.setattr(near_dedup, "cell_pairs", lambda least: sizes.append(least) or real(least))
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert {out[k + 100] for k in range(10_000)} == {100} and out[1] == out[2] == 1 and out[3] == 3 and sizes


def test_taken_words_come_near(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert max(abs(r.k / r.t - 1) for r in out) < 0.02
    again = mixing.mix_sources(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted(mixing.mix_sources(docs).select("doc_id", "taken").collect())


def test_scratch_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        common.shared_dir(Session())


# ---------------------------------------------------------------- the pipeline, stage by stage, against plain Python

SPACE = "[^ \\t\\n\\v\\f\\r]+"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r["source"], set()).add(None if r["text"] is None else r["text"].strip(" "))
    out = []
    for r in rows:
        own, lines = pages[r["source"]], [] if r["text"] is None else r["text"].split("\n")
        n = {x: sum(p is not None and x in {y.strip(" ") for y in p.split("\n")} for p in own) for x in {y.strip(" ") for y in lines}}
        kept = [x for x in lines if not x.strip(" ") or not (n[x.strip(" ")] >= line_dedup.MIN_PAGES and n[x.strip(" ")] > line_dedup.RATIO * len(own))]
        out.append((r["doc_id"], None if r["text"] is None else "\n".join(kept)))
    return out


def brute_near(rows, percent=80):
    sets = []
    for r in rows:
        w = re.findall(SPACE, fold(r["text"] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        best[root(i)] = min(best.get(root(i), r["doc_id"]), r["doc_id"])
    return [r["doc_id"] for i, r in enumerate(rows) if best[root(i)] == r["doc_id"]]


def brute_leaks(rows, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for t in items:
        w = re.findall(word, fold(t))
        k = min(10, len(w))
        windows.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0))
    out = []
    for r in rows:
        spots = list(re.finditer(word, fold(r["text"] or "")))
        w, hit = [m[0] for m in spots], set()
        for k, own in windows.items():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in own:
                    hit.update(range(i, i + k))
        out.append((r["doc_id"], [x for i, x in enumerate(w) if i not in hit]))
    return out


def test_pipeline_stages_equal_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.collect()
    rows = [tuple(r) for r in known]
    first = known[0].asDict()
    long = next(r for r in known if len(r["text"].split()) > 80).asDict()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    made = [long | {"doc_id": 9001, "text": long["text"] + " coda"}, long | {"doc_id": 9002, "text": "intro " + long["text"]}, first | {"doc_id": 9003, "text": first["text"] + "\n" + item}]
    rows += [tuple(m[c] for c in docs.columns) for m in made]
    rows = [(*r[:1], (r[1] + "\nRead more on this site") if r[0] % 2 else r[1], *r[2:]) for r in rows]
    docs = spark.createDataFrame(rows, docs.schema)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"]]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = [r.asDict() for r in docs.collect()], stage(spark, docs, str(tmp_path))
        docs = common.scratch(at[name][1], f"test-{name}")
        at[name] = at[name][0], [r.asDict() for r in docs.collect()]
    before, after = at["language_id"]
    assert len(after) >= 0.98 * len(before) and sum(a["lang"] == {b["doc_id"]: b["lang"] for b in before}[a["doc_id"]] for a in after) >= 0.98 * len(after)
    before, after = at["line_dedup"]
    want = brute_lines(before)
    assert sorted((r["doc_id"], r["text"] or "") for r in after) == sorted((i, t or "") for i, t in want) and any(r["text"] != dict(want)[r["doc_id"]] for r in before)
    before, after = at["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(brute_near(before)) and len(after) < len(before)
    before, after = at["decontamination"]
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    assert sorted((r["doc_id"], re.findall(words, fold(r["text"] or ""))) for r in after) == sorted(brute_leaks(before, items)) and any(len(r["text"] or "") < len({b["doc_id"]: b["text"] for b in before}[r["doc_id"]] or "") for r in after)
    before, after = at["source_mixing"]
    size = {r["doc_id"]: len(re.findall(SPACE, r["text"] or "")) for r in before}
    source = {s: sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in {r["source"] for r in before}}
    got = {s: sum(r["size"] for r in after if r["source"] == s) for s in source}
    target = {r["source"]: r["target"] for r in after}
    longest = {s: max(size[r["doc_id"]] for r in before if r["source"] == s) for s in source}
    for s, goal in target.items():
        assert goal <= 3 * source[s] + 1e-6 and abs(got[s] - goal) <= max(0.05 * goal, longest[s])
    assert abs(sum(target.values()) - sum(source.values())) < 1e-6 * sum(source.values()) and max(sum(1 for x in after if x["doc_id"] == r["doc_id"]) for r in after) <= 3
