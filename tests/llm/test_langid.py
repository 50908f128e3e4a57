"""Language ID over pages: each source of evidence and their fusion against brute force."""

import math
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm import langid

WORDS = {"de": "der hund und die katze schlafen unter dem baum", "en": "the dog and the cat sleep under the tree", "fr": "le chien et le chat dorment sous un arbre"}
LANGS = sorted(WORDS)


class Root(HTMLParser):
    lang = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "html" and self.lang is None:
            self.lang = named.get("lang") or named.get("xml:lang")


def brute_markup(html):
    root = Root()
    root.feed(html or "")
    return root.lang.strip().lower().split("-")[0] if root.lang else None


def brute_address(url):
    if not url or "://" not in url:
        return None
    parts = urlsplit(url.lower())
    labels = parts.netloc.split(":")[0].split(".")
    inside = [x for x in parts.path.split("/") if x in LANGS]
    return inside[-1] if inside else labels[0] if labels[0] in LANGS and len(labels) > 1 else labels[-1] if labels[-1] in LANGS and len(labels) > 1 else None


def test_markup_language(spark):
    pages = ['<html lang="de">', "<HTML class=x LANG='FR-ca'>", "<html lang=en>", '<html data-lang="de">', '<html data-lang="de" lang="fr">', '<html xml:lang="en">', "<html>", '<body lang="de">', "<p>", "", None]
    df = spark.createDataFrame([(x,) for x in pages], "html string")
    assert [r[0] for r in df.select(langid.markup_language(F.col("html"))).collect()] == [brute_markup(x) for x in pages]


def test_address_language(spark):
    urls = ["http://a.test/de/1", "https://de.a.test/x", "https://a.de", "https://a.de:80/x?l=fr", "http://de.a.test/fr/x/en/", "http://a.test/den/1", "http://a.test/x?u=http://de.b.test/", "http://a.test/x#/de/", "http://a.test/DE", "http://a.test/es/", "no scheme/de/", "", None]
    df = spark.createDataFrame([(x,) for x in urls], "url string")
    assert [r[0] for r in df.select(langid.address_language(F.col("url"), LANGS)).collect()] == [brute_address(x) for x in urls]


def test_domain(spark):
    hosts = {"www.a.test": "a.test", "a.test:80": "a.test", "a": "a", "": "", "10.0.0.1": "10.0.0.1", "x.b.a.test": "a.test"}
    df = spark.createDataFrame([(x,) for x in hosts], "host string")
    assert [r[0] for r in df.select(langid.domain_of(F.col("host"))).collect()] == list(hosts.values())


def brute(rows, models):
    """Posteriors of rows (text, host, domain, declared, address) by plain sums."""
    n_langs, own = len(models.languages), []
    for text, _, _, declared, address in rows:
        n, mean = models.mean(text)
        score = [min(n, langid.MAX_EVIDENCE) * langid.TEMPER * float(m) for m in mean]
        for told, trust in ((declared, langid.DECLARED), (address, langid.ADDRESS)):
            if told in models.languages:
                score = [s + math.log(trust if x == told else (1 - trust) / (n_langs - 1)) for s, x in zip(score, models.languages, strict=True)]
        own.append((n, mean, score))
    votes = [(h, d, s.index(max(s))) for (_, h, d, _, _), (n, _, s) in zip(rows, own, strict=True) if n]
    count = lambda fits, k: sum(fits(h, d) and g == k for h, d, g in votes)
    out = []
    for (_, host, domain, _, _), (n, mean, score) in zip(rows, own, strict=True):
        if any(h == host for h, _, _ in votes):
            p = [(count(lambda h, d: True, k) + 1) / (len(votes) + n_langs) for k in range(n_langs)]
            for fits in (lambda h, d, x=domain: d == x, lambda h, d, x=host: h == x):
                c = [count(fits, k) for k in range(n_langs)]
                p = [(c[k] + langid.SMOOTHING * p[k]) / (sum(c) + langid.SMOOTHING) for k in range(n_langs)]
            score = [s + math.log(x) for s, x in zip(score, p, strict=True)]
        top = max(score)
        pick, sure = score.index(top), 1 / sum(math.exp(s - top) for s in score)
        kept = n > 0 and sure >= langid.LEAST_POSTERIOR and (n < langid.LEAST_TRIGRAMS or float(mean[pick]) > models.usual[0][pick] - langid.FLOOR)
        out.append((models.languages[pick] if kept else None, round(sure, 6), kept))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    docs = [(k, " ".join(WORDS[x].split()[k % 3 :] * 3), x) for k in range(12) for x in LANGS]
    spark.createDataFrame([(i, t, x) for i, (_, t, x) in enumerate(docs)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    rows = []
    for k in range(60):
        x, y = LANGS[k % 3], LANGS[(k // 3) % 3]
        text = ["", "x", "12", WORDS[x], " ".join(WORDS[x].split()[:2])][k % 5]
        html = None if k == 7 else f"<html{[f' lang={y!r}', '', ' lang=pt', f' data-lang={y!r}'][k % 4]}><p>{text}</p>"
        url = None if k == 9 else f"http://{['www', 'de', 'm'][k % 3]}.h{k % 4}.test/{['en/', 'a/', 'x/fr/', ''][k // 15]}{k}"
        rows.append((k, url, html, text if html else None))
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at), rows


def test_page_query_fuses_all_evidence(spark, corpus):
    at, rows = corpus
    out = {r.page_id: r for r in entry.queries()["op8_language_id"](spark, at).collect()}
    models = langid.learn(spark.read.parquet(f"{at}/documents.parquet"), "text", "lang")
    known = []
    for _, url, html, text in rows:
        host = urlsplit(url).netloc if url else ""
        known.append((text, host, ".".join(host.split(".")[-2:]), brute_markup(html), brute_address(url)))
    want = brute(known, models)
    assert len({w[0] for w in want}) == 4 and len(out) == len(rows)
    for (k, *_), row, (language, sure, kept) in zip(rows, known, want, strict=True):
        r = out[k]
        assert (r.host, r.domain, r.declared, r.address) == row[1:], k
        assert (r.language, r.kept) == (language, kept) and abs(r.confidence - sure) < 2e-6, (k, r, sure)


def test_each_source_decides_where_the_text_is_silent(spark, corpus):
    models = langid.learn(spark.read.parquet(f"{corpus[0]}/documents.parquet"), "text", "lang")
    shape = "text string, host string, domain string, declared string, address string"
    rows = [("x", "a", "d", "fr", None), ("x", "b", "d", None, "de"), *[(WORDS["de"], "c", "e", None, None)] * 40, ("x", "c", "e", None, None), ("x", "f", "e", None, None), ("x", "f", "e", "en", "en")]
    out = langid.identify(spark.createDataFrame(rows, shape).coalesce(1), models, host=F.col("host"), domain=F.col("domain"), declared=F.col("declared"), address=F.col("address")).collect()
    got = [(r.language, round(r.confidence, 6), r.accepted) for r in out]
    assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in brute(rows, models)]
    assert all(abs(g[1] - w[1]) < 2e-6 for g, w in zip(got, brute(rows, models), strict=True))
    assert got[0][0] == "fr" and got[1][0] == "de" and got[-3][0] == got[-2][0] == "de" and got[-1][0] == "en"


def test_many_languages_and_folds(spark):
    rows = [(f"l{k:03}", " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ba", "do", "fi", "gu", "lek", "mor")) + f" x{c}") for k in range(100) for c in "abcd"]
    df = spark.createDataFrame(rows, "lang string, text string")
    models = langid.learn(df, "text", "lang", folds=2)
    assert len(models.languages) == 100 and len(models.tables[0]) == 2
    out = langid.identify(df, models).collect()
    seen = {(f, x) for (x, _), f in zip(rows, [r[0] for r in df.select(langid.fold_of(F.col("text"))).collect()], strict=True)}
    both = [r for r in out if {(0, r.lang), (1, r.lang)} <= seen]
    assert len(both) > 200 and sum(r.language == r.lang for r in both) > 0.9 * len(both)


def test_rows_are_judged_by_models_of_other_rows(spark):
    df = spark.createDataFrame([("aa bb cc dd ee " * 9, "x")] * 30 + [("ff gg hh ii jj " * 9 + str(k), "y") for k in range(8)], "text string, lang string")
    models = langid.learn(df, "text", "lang", folds=2)
    # all copies of the one text are in one fold, so no model that judges them has seen language x
    fold = df.where("lang = 'x'").select(langid.fold_of(F.col("text"))).first()[0]
    assert models.mean("aa bb cc dd ee", fold)[1][0] < models.mean("aa bb cc dd ee", 1 - fold)[1][0]
    assert not any(r.accepted and r.language == "x" for r in langid.identify(df, models).where("lang = 'x'").collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.learn(docs, "text", "lang", folds=langid.FOLDS), host=F.col("source"))
    assert out.where("accepted").count() >= 995 and out.where("accepted and language = lang").count() >= 990
