"""Predicates on text: terms, aliases, match spans and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import ascii_tokens, let, sentences


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """A term as a substring, without word boundaries."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def terms_found(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Names of the term lists that the lower-cased text holds one of, in their order."""
    return F.array_compact(F.array(*[F.when(any_term(F.lower(text), terms), F.lit(name)) for name, terms in table.items()]))


def quoted(term: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in term)


def alias_match(text: Column, alias: str) -> Column:
    """All tokens of the alias stand in the text in any order; or, from four characters on, the alias as a phrase; an alias without ASCII tokens as a substring."""
    import re

    lower, own = alias.lower(), sorted(set(re.findall("[a-z0-9]+", alias.lower())))
    if not own:
        return F.contains(F.lower(text), F.lit(lower))
    every = F.size(F.array_except(F.array(*map(F.lit, own)), ascii_tokens(text))) == 0
    if len(lower) < 4:
        return every
    return every | F.lower(text).rlike(rf"(?<![a-z0-9]){quoted(lower)}(?![a-z0-9])")


def spans(text: Column, pattern: str) -> Column:
    """Matches as array of struct(start, match), start counted from 0; the pattern must have no groups that capture."""

    def located(cut: Column) -> Column:
        found, gaps = cut["found"], cut["gaps"]
        start = lambda i: F.length(F.array_join(F.slice(gaps, F.lit(1), i), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i - 1), ""))
        none = F.array().cast("array<struct<start:int,match:string>>")
        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(start(i).alias("start"), F.element_at(found, i).alias("match")))).otherwise(none)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), located)


def uncaptured(pattern: str) -> str:
    """The pattern with its capturing groups made plain."""
    import re

    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def around(text: Column, span: Column, reach: int) -> Column:
    low = F.greatest(span["start"] - reach, F.lit(0))
    return F.substr(text, low + 1, span["start"] + F.length(span["match"]) + reach - low)


def unguarded(text: Column, pattern: str, negation: str, reach: int) -> Column:
    """Matches without a negation within `reach` characters: array of the matched texts."""
    return F.transform(F.filter(spans(text, uncaptured(pattern)), lambda s: ~around(text, s, reach).rlike(negation)), lambda s: s["match"])


def first_unguarded(text: Column, pattern: str, negation: str, reach: int) -> Column:
    """Whether the first match, if any, has no negation around it."""
    first = F.try_element_at(spans(text, uncaptured(pattern)), F.lit(1))
    return F.coalesce(~around(text, first, reach).rlike(negation), F.lit(False))


def forbidden_hits(text: Column, items: list[str], refusal: str, reach: int = 120) -> Column:
    """Items that the lower-cased text holds without a refusal around their first place; short ones must be whole words."""
    lower, hits = F.lower(text), []
    for item in items:
        needle = item.lower()
        if len(needle) <= 3:
            at = F.length(F.element_at(F.split(lower, rf"(?<![a-z0-9]){quoted(needle)}(?![a-z0-9])", 2), 1))
            found = lower.rlike(rf"(?<![a-z0-9]){quoted(needle)}(?![a-z0-9])")
        else:
            at, found = F.instr(lower, needle) - 1, F.contains(lower, F.lit(needle))
        low = F.greatest(at - reach, F.lit(0))
        hits.append(F.when(found & ~F.substr(lower, low + 1, at + len(needle) + reach - low).rlike(refusal), F.lit(item)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def contradicted(text: Column, refusal: str, unsafe: str, negation: str) -> Column:
    """Sentences with unsafe, unnegated text right after a refusing sentence: how many."""

    def pairs(s: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda i: (i <= F.size(s)) & F.coalesce(F.try_element_at(s, i - 1).rlike(refusal) & F.try_element_at(s, i).rlike(unsafe) & ~F.try_element_at(s, i).rlike(negation), F.lit(False)))).cast("long")

    return let(sentences(text), pairs)


def last_place(text: Column, mark: str) -> Column:
    """Where a mark stands last, from 0; -1 if nowhere."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)).otherwise(F.lit(-1))


def outside_section(text: Column, pattern: str, safe: str, exempt: str, others: tuple[str, ...], reach: int = 40) -> Column:
    """Matches that count: not under the exempt header (the last of the headers before it), nor with a safe word in their line or just before."""

    def counts(s: Column) -> Column:
        before = F.substr(text, F.lit(1), s["start"])
        after = F.substr(text, s["start"] + F.length(s["match"]) + 1, F.length(text))
        line = F.concat(F.substring_index(before, "\n", -1), s["match"], F.substring_index(after, "\n", 1))
        prefix = F.substr(before, F.greatest(s["start"] - reach, F.lit(0)) + 1, F.lit(reach))
        under = last_place(before, exempt)
        covered = F.lit(True)
        for o in others:
            covered = covered & (under > last_place(before, o))
        return ~(covered & (under >= 0)) & ~line.rlike(safe) & ~prefix.rlike(safe)

    return F.size(F.filter(spans(text, uncaptured(pattern)), counts)).cast("long")


def usable_sentence(s: Column, bad: str, least: int = 80, most: int = 320) -> Column:
    return F.length(s).between(least, most) & s.rlike(r"[.!]\z") & ~s.rlike(bad)


def devanagari(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u097F]")


def not_true(flag: Column) -> Column:
    """Anything but true, null included."""
    return ~flag.eqNullSafe(F.lit(True))
