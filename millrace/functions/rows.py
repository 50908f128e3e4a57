"""Row shaping: messages, metadata, families, tags, templates, deterministic choices, set algebra on arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preview(text: Column, size: int = 240) -> Column:
    return F.substring(text, 1, size)


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def or_none(items: Column, kind: str = "array<string>") -> Column:
    """An array, or an empty one for null."""
    return F.coalesce(items, F.array().cast(kind))


def merged(left: Column, right: Column) -> Column:
    """Of two string maps one, where the right one wins."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(right, k), F.try_element_at(left, k))))


def denied(df: DataFrame, prefixes: tuple[str, ...], exact: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns whose lower-case name begins with a prefix or is one of `exact`."""
    return df.select([c for c in df.columns if not c.lower().startswith(prefixes) and c not in exact])


def message_by_role(messages: Column, role: str, fallback: Column) -> Column:
    """The content of the first message of a role, else the fallback; messages are structs (role, content)."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"], fallback)


def message_at(messages: Column, place: int, fallback: Column) -> Column:
    return F.when(F.size(messages) > 0, F.try_element_at(messages, F.lit(place + 1))["content"]).otherwise(fallback)


def first_present(tags: Column, order: tuple[str, ...], default: str | None = None) -> Column:
    """The first of an ordered list that the tags hold."""
    return F.coalesce(*[F.when(F.array_contains(tags, x), F.lit(x)) for x in order], F.lit(default))


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """An ordered CASE."""
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(default))


def last_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """Overrides in order: the last that holds wins."""
    return first_rule(rules[::-1], default)


def prefix_family(key: Column, known: tuple[str, ...]) -> Column:
    """The known prefix before the first underscore, else the first two parts."""
    return F.when(key.rlike(f"^(?:{'|'.join(known)})_"), F.substring_index(key, "_", 1)).otherwise(F.substring_index(key, "_", 2))


def suffix_family(key: Column, skip: int = 4) -> Column:
    """What follows the first `skip` parts, else the key."""
    parts = F.split(key, "_", -1)
    return F.when(F.size(parts) > skip, F.array_join(F.slice(parts, skip + 1, F.size(parts)), "_")).otherwise(key)


def rendered(template: str, /, **values: Column) -> Column:
    """A template's {names} replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), or_empty(value.cast("string")))
    return out


def hash_choice(key: Column, n: int) -> Column:
    """A stable number in [0, n) out of the key's hash."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % n


def stable_index(key: Column) -> Column:
    """The sum of an ASCII key's code points."""
    return F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda s, c: s + F.ascii(c))


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def same_set(a: Column, b: Column) -> Column:
    return subset(a, b) & subset(b, a)


def ordered_distinct(items: Column, key=lambda x: x) -> Column:
    """Items whose key doesn't stand earlier, in order."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    keys = F.transform(items, key)
    return F.transform(F.filter(keyed, lambda s, i: F.array_position(keys, s["k"]) == i + 1), lambda s: s["x"])


def distinct_lines(lines: Column, limit: int) -> Column:
    """Lines once each, compared in lower case with white space collapsed, trimmed, blank ones left out, `limit` at most."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return F.slice(F.transform(ordered_distinct(full, lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))), lambda x: F.trim(x)), 1, limit)


def with_helpers(ids: Column, known: Column, suffix: str = "_helper") -> Column:
    """The ids and those of their helper ids that are known."""
    return F.array_union(ids, F.filter(F.transform(ids, lambda x: F.concat(x, F.lit(suffix))), lambda x: F.array_contains(known, x)))


def risk_order(risk: Column, order: tuple[str, ...] = ("green", "yellow", "red")) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), risk) - 1


def iso_timestamp(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$")


def relative_path(path: Column, root: str) -> Column:
    """The path below the root, or as it is outside of it."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
