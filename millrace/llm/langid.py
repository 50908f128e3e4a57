"""Language ID by Bayesian fusion of evidence.

Evidence of a row: the text's likelihood under byte-trigram models of each language, the language its markup declares,
the language its address names (a path segment, a subdomain or a country suffix), and the prior of its host. Host priors come from
grouped counts of first guesses, smoothed hierarchically: host towards its domain, domain towards all rows.

The text models are learned from labelled rows. Where the rows to judge are the labelled rows themselves, they are dealt into FOLDS by
their text, and each is judged by models that saw none of its fold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Names, bounded_batches, discard, scratch, small

BINS = 1 << 16
#: Trigrams of a text that are looked up together.
TOGETHER = 1 << 16
#: Labelled rows per language and fold that the text models are learned from, at most: the first by hash of the text.
SAMPLE_ROWS = 400
FOLDS = 2
#: Languages whose trigram tables are looked up together (256 KB each); any number of languages is so many tables.
TABLES = 64
#: Trigrams overlap and repeat, so each counts for this much evidence, and no more than MAX_EVIDENCE of them.
TEMPER, MAX_EVIDENCE = 0.2, 400
DECLARED, ADDRESS, SMOOTHING = 0.9, 0.8, 20.0
#: A row is rejected if no language reaches this posterior, or its text is this far below what its language's texts score.
LEAST_POSTERIOR, FLOOR = 0.5, 3.0
LEAST_TRIGRAMS = 200
BROADCAST_HOSTS = 50_000
# ASCII letters and all bytes of other letters stay, everything else is a gap.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) if text else b""


def trigrams(data: bytes) -> np.ndarray:
    a = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    return ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64) if data else np.zeros(0, np.int64)


class TextModels:
    """Log-probabilities of trigram bins by language, and what texts of a language score per trigram.

    One set of tables for each fold, learned from the rows of the other folds; a single set without folds. `counts` holds
    (fold, language, bin, n).
    """

    def __init__(self, counts: list[tuple[int, str, int, int]], languages: list[str], folds: int = 1) -> None:
        self.languages, self.folds = sorted(languages), folds
        place = {x: k for k, x in enumerate(self.languages)}
        n = np.zeros((folds, len(place), BINS), np.float32)
        for fold, lang, low, high in counts:
            n[fold, place[lang], low] += high
        self.tables, self.usual = [], []
        for own in n.sum(axis=0) - n if folds > 1 else n:
            total = own.sum(axis=1, keepdims=True, dtype=np.float64)
            # a language that this fold's models have no text of explains nothing
            logs = np.where(total > 0, np.log((own + 0.05) / (total + 0.05 * BINS)), -30.0)
            self.usual.append([float(x) for x in (own * logs).sum(axis=1) / np.maximum(total[:, 0], 1)])
            self.tables.append([np.ascontiguousarray(logs[k : k + TABLES].T, np.float32) for k in range(0, len(place), TABLES)])

    def mean(self, text: str | None, fold: int = 0) -> tuple[int, np.ndarray]:
        """The number of trigrams and the mean log-probability of each language."""
        g = trigrams(letters(text))
        total = [sum((t[g[lo : lo + TOGETHER]].sum(axis=0, dtype=np.float64) for lo in range(0, len(g), TOGETHER)), np.zeros(t.shape[1])) for t in self.tables[fold]]
        return len(g), np.concatenate(total or [np.zeros(0)]) / max(1, len(g))


def fold_of(text: Column) -> Column:
    """Equal texts are in one fold, so no model has seen a copy of what it judges."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (fold, lang), texts in batch.groupby(["fold", "lang"])["text"]:
            n = np.zeros(BINS, np.int64)
            for t in texts:
                n += np.bincount(trigrams(letters(t)), minlength=BINS)
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"fold": fold, "lang": lang, "bin": seen, "n": n[seen]})


def learn(labelled: DataFrame, text: str, lang: str, folds: int = 1, rows: int = SAMPLE_ROWS) -> TextModels:
    """From at most `rows` texts of each language and fold; only counts of trigram bins reach the driver, 65 536 a language and fold at most.

    Null languages and null or blank texts are not learned from. Repeated texts count once.
    """
    bounded_batches(labelled.sparkSession)
    own = labelled.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    own = own.select(F.col(lang).alias("lang"), (fold_of(F.col(text)) if folds > 1 else F.lit(0)).alias("fold"), F.xxhash64(F.col(text), F.lit(8)).alias("h"), F.col(text).alias("text"))
    # of many texts only the part with the lowest hashes, some four times the sample, is ranked
    many = small(scratch(own.groupBy(F.col("lang").alias("_l"), F.col("fold").alias("_f")).agg(F.approx_count_distinct("h").alias("_n")), "lang-sizes"))
    low = own.select("lang", "fold", "h").join(many, (F.col("lang") == F.col("_l")) & (F.col("fold") == F.col("_f"))).where(F.col("h") / F.lit(2.0**64) + 0.5 < 4.0 * rows / F.col("_n"))
    first = Window.partitionBy("lang", "fold").orderBy("h")
    picked = low.select("lang", "fold", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows).select("lang", "fold", "h")
    picked = scratch(picked, "lang-picked")
    found = own.join(small(picked), ["lang", "fold", "h"], "left_semi").dropDuplicates(["lang", "fold", "h"])
    counts = found.select("fold", "lang", "text").mapInPandas(_counted, "fold int, lang string, bin int, n long").groupBy("fold", "lang", "bin").agg(F.sum("n").alias("n"))
    seen, languages = counts.collect(), [r[0] for r in picked.select("lang").distinct().collect()]
    discard(picked)
    return TextModels([tuple(r) for r in seen], languages, folds)


def markup_language(html: Column) -> Column:
    """The primary subtag that `<html lang>` declares, lower-cased; null if none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?[\s\"'](?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})(?![a-z])", 1))
    return F.when(found != "", found)


def address_language(url: Column, languages: list[str]) -> Column:
    """A language code as a path segment, a first host label or a host suffix; null if none or unknown."""
    one = "|".join(map(re.escape, sorted(languages))) or "-"
    found = F.coalesce(*[F.when(F.regexp_extract(F.lower(url), p, 1) != "", F.regexp_extract(F.lower(url), p, 1)) for p in (rf"^[^?#]*?://[^/?#]*/(?:[^?#]*/)?({one})(?:[/?#]|$)", rf"^[^/?#]*://({one})\.", rf"^[^/?#]*://[^/?#:]*\.({one})(?:[:/?#]|$)")])
    return found


def domain_of(host: Column) -> Column:
    """The last two labels of a host, without its port; the host itself if it has fewer or is an address of numbers."""
    name = F.regexp_replace(host, r":\d*$", "")
    found = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return F.when((found != "") & ~name.rlike(r"^[\d.]+$"), found).otherwise(name)


def identify(rows: DataFrame, models: TextModels, text: str = "text", host: Column | None = None, domain: Column | None = None, declared: Column | None = None, address: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows' columns (those of `keep`, or all) with `language` (null if rejected), `confidence`, `accepted` added, replacing such columns.

    Rows without letters are rejected, as are rows that no language explains. Null and unknown declarations, addresses and
    hosts are no evidence. Ties go to the first language by name. Repeated rows get equal results. Without a model
    every row is rejected. Host priors are one row per host, broadcast if few, else joined. Models with folds judge a row by its fold's.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    made = ("language", "confidence", "accepted")
    kept = [c for c in (rows.columns if keep is None else keep) if c not in made]
    langs = models.languages
    if not langs:
        return rows.withColumns({"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "accepted": F.lit(False)}).select(*kept, *made)
    held = spark.sparkContext.broadcast(models)
    name = Names(rows)

    def likelihoods(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, folds in batches:
            both = [held.value.mean(t, f) for t, f in zip(texts, folds, strict=True)]
            yield pd.DataFrame({"n": [n for n, _ in both], "mean": [m for _, m in both]})

    # a filter on what it tells must not run it a second time
    told = F.pandas_udf(likelihoods, "n long, mean array<double>").asNondeterministic()

    def said(value: Column | None, trust: float, k: int) -> Column:
        if value is None or len(langs) < 2:
            return F.lit(0.0)
        known = value.isin(langs)
        return F.when(known, F.when(value == langs[k], math.log(trust)).otherwise(math.log((1 - trust) / (len(langs) - 1)))).otherwise(0.0)

    fold = fold_of(F.col(text)) if models.folds > 1 else F.lit(0)
    ll, score, at, under, prior, all_ = map(name, ("ll", "score", "host", "domain", "prior", "all"))
    n, mean = F.col(ll)["n"], F.col(ll)["mean"]
    spoken = F.array(*[said(declared, DECLARED, k) + said(address, ADDRESS, k) for k in range(len(langs))])
    extra = {ll: told(F.col(text), fold), name("fold"): fold, name("spoken"): spoken}
    if host is not None:
        extra |= {at: host, under: domain if domain is not None else F.lit("")}
    own = rows.withColumns(extra).select(*kept, *extra)
    weight = F.least(n, F.lit(MAX_EVIDENCE)) * TEMPER
    own = own.withColumn(score, F.zip_with(F.transform(mean, lambda m: m * weight), name("spoken"), lambda a, b: a + b))
    best = lambda c: F.array_position(c, F.array_max(c))
    if host is not None:
        own = scratch(own, "lang-told")  # the texts are read once, for the priors and for the rows
        guess = own.where(n > 0).groupBy(F.col(at).alias("h"), F.col(under).alias("d"), best(F.col(score)).cast("int").alias("g")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        guess = scratch(guess, "lang-guesses")
        # counts as arrays by language, of each host within its domain, of domains, of all
        counts = lambda df, *by: df.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("g") == k + 1, F.col("c")).otherwise(0.0)) for k in range(len(langs))]).alias("n"))
        smooth = lambda c, p: F.zip_with(c, p, lambda x, y: (x + SMOOTHING * y) / (F.aggregate(c, F.lit(0.0), lambda s, z: s + z) + SMOOTHING))
        seen = {r["g"]: r["c"] for r in guess.groupBy("g").agg(F.sum("c").alias("c")).collect()}
        whole = [seen.get(k + 1, 0.0) for k in range(len(langs))]
        base = F.array(*[F.lit((x + 1) / (sum(whole) + len(langs))) for x in whole])
        domains = counts(guess, "d").select(F.col("d").alias("dd"), smooth(F.col("n"), base).alias("p"))
        hosts = counts(guess, "h", "d").join(domains, F.col("d").eqNullSafe(F.col("dd")))
        hosts = hosts.select(F.col("h").alias(name("h")), F.col("d").alias(name("d")), F.transform(smooth(F.col("n"), F.col("p")), F.ln).alias(prior))
        hosts = small(scratch(hosts, "lang-priors"), BROADCAST_HOSTS)
        discard(guess)
        own = own.join(hosts, F.col(at).eqNullSafe(F.col(name("h"))) & F.col(under).eqNullSafe(F.col(name("d"))), "left")
        own = own.withColumn(all_, F.when(F.col(prior).isNull(), F.col(score)).otherwise(F.zip_with(score, prior, lambda a, b: a + b)))
    else:
        own = own.withColumn(all_, F.col(score))
    top = F.array_max(all_)
    confidence = 1 / F.aggregate(all_, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    own = own.withColumns({name("pick"): best(F.col(all_)).cast("int"), name("sure"): confidence})
    pick = F.col(name("pick"))
    usual = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, u)) for u in models.usual]), F.col(name("fold")) + 1), pick)
    fits = (n < LEAST_TRIGRAMS) | (F.element_at(mean, pick) > usual - FLOOR)
    accepted = (n > 0) & (F.col(name("sure")) >= LEAST_POSTERIOR) & fits
    language = F.when(accepted, F.element_at(F.array(*map(F.lit, langs)), pick))
    return own.select(*kept, language.alias("language"), F.col(name("sure")).alias("confidence"), accepted.alias("accepted"))
