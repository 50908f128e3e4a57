"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontam, html_extract, langid, line_dedup, media, mixing, near_dedup, quality, substring_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, host string, _key int, target string"
PASSAGE = " ".join(f"word{i}" for i in range(70))
ROWS = [
    (1, PASSAGE, "en", "a", 1, 1, "x", 1, None),
    (2, "lead " + PASSAGE + " tail", "en", "a", 1, 1, "x", 1, "t"),
    (3, PASSAGE, None, None, None, None, None, None, None),
    (3, PASSAGE, None, None, None, None, None, None, None),
    (4, None, "en", "b", 0, 0, "", 0, ""),
    (5, "", "de", "b", 0, 0, "", 0, ""),
    (6, " \n\t ", "de", None, 0, 0, "", 0, ""),
    (None, PASSAGE, "en", "a", 0, 0, "", 0, ""),
    (7, "tiny", "en", "c", 4, 0, "", 0, ""),
    (8, "der hund und die katze " * 30_000, "de", "c", 4, 0, "", 0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 35))), (2, None), (3, "tiny"), (None, "katze der")], "item_id long, text string")


def test_near(spark, docs, none):
    out = {(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, percent=85).collect()}
    assert out[1] == (66, 1, True) and out[2] == (68, 1, False) and out[3] == (66, 1, False)
    assert out[4] == out[5][:0] + (0, 4, True) and out[6] == (0, 6, True) and out[7] == (1, 7, True)
    assert None not in out and near_dedup.near_duplicates(none).count() == 0


def test_near_hot_group_is_whole(spark):
    """A group larger than a block of a bucket, chained so that no centre links all."""
    base = [f"t{i}" for i in range(150)]
    rows = []
    for k in range(700):
        w = list(base)
        for e in range(k % 3):
            w[(37 * k + 53 * e) % 150] = f"n{k}_{e}"
        rows.append((k + 10, " ".join(w)))
    rows += [(5000, "quite another text of its own words"), (5001, "quite another text of its own word")]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r.component_id for r in out if r.doc_id < 5000} == {10}
    assert {r.component_id for r in out if r.doc_id >= 5000} == {5000, 5001}


def test_substring(spark, docs, none):
    out = {(r.doc_id, r.text): r.repeats for r in substring_dedup.drop_repeats(docs).collect()}
    assert out[(1, PASSAGE)].n_removed == 0 and out[(2, ROWS[1][1])].kept_text == "lead tail" and out[(3, PASSAGE)].n_removed == 70
    assert out[(None, PASSAGE)].n_removed == 0 and out[(4, None)].n_words == 0 and out[(8, ROWS[-1][1])].n_removed == 0
    assert substring_dedup.drop_repeats(none).count() == 0


def test_leaks(spark, docs, none, bench):
    out = {(r.doc_id): r for r in decontam.leak_digest(decontam.find_leaks(docs, bench)).collect()}
    assert (out[1].n_hit, out[1].n_items) == (15, 1) and out[7].n_hit == 1 and out[4].n_words == 0 and not out[5].contaminated
    assert out[8].n_items == 0 and out[8].contaminated
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).where("size(leak.starts) > 0").count() == 0


def test_leaks_in_blocks(spark, docs, bench, monkeypatch):
    whole = sorted(map(str, decontam.leak_digest(decontam.find_leaks(docs, bench)).collect()))
    monkeypatch.setattr(decontam, "ITEM_BYTES", 60)
    assert sorted(map(str, decontam.leak_digest(decontam.find_leaks(docs, bench)).collect())) == whole


def test_lines(spark, none):
    rows = [(i, "Menu\n\nown %d" % i if i < 6 else None, "h") for i in range(8)] + [(9, "", None)] + [(k, "copied\nlines", "h") for k in range(20, 30)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept_text == "\nown 0" and out[0].n_dropped == 1 and out[7].kept_text is None and out[9].kept_text == "" and out[20].kept_text == "copied\nlines"
    assert line_dedup.drop_boilerplate_lines(none).count() == 0


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in out)
    assert mixing.mix_sources(docs, keep=True).count() == len(ROWS) and mixing.mix_sources(none).count() == 0


def test_others(spark, docs, none, bench):
    assert media.with_media(docs).count() == len(ROWS) and media.with_media(none).count() == 0
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).where("quality_score between 0 and 1").count() == len(ROWS)
    assert quality.score_quality(none, labels.limit(0)).count() == 0
    models = langid.learn(docs, "text", "lang")
    found = {r.doc_id: r for r in langid.identify(docs, models, host=F.col("source"), declared=F.col("lang")).collect()}
    assert found[8].language == "de" and found[1].language == "en" and not found[4].accepted and not found[6].accepted
    assert langid.identify(none, langid.learn(none, "text", "lang", folds=2)).count() == 0


def test_pages(spark):
    link = lambda *hosts: "".join(f'<a href="//{h}/x">x</a>' for h in hosts)
    rows = [(1, "http://Good.example.net/en/1", "<p>" + link("mid.test")), (2, "https://bad.net/", link("bad.net")), (3, "http://mid.test/?q", None), (4, "http://feeder.test/a#b", link("bad.net")), (5, None, ""), (6, "no scheme", "<article><p>A long enough text, with some words."), (6, "no scheme", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("good.example.net", "/en/1", "example.net/en/", "allow")
    assert out[2].verdict == "block" and out[4].rule is None and out[4].verdict == "block" and out[3].verdict == "allow" and out[3].trust > 0
    assert (out[5].host, out[5].path, out[5].verdict) == ("", "", "allow") and url_filter.filter_urls(pages.limit(0)).count() == 0
    assert html_extract.extract(pages).count() == 7 and html_extract.extract(pages.limit(0)).count() == 0


def test_stages(spark, docs, none, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    own = docs.columns
    for table in (docs, none):
        at = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            out.collect()
            if k < 4:
                assert out.columns == own
                at = out
