"""Sizes, durations, names and settings as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_bytes(text: str | Column) -> Column:
    """Bytes of a size such as 12.5GB, by powers of 1024, rounded down; null where it is none."""
    number, unit = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?\s*$", 1), F.upper(F.regexp_extract(text, r"(?i)^\s*[0-9.]+\s*([KMGT]?)I?B?\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", F.floor(F.try_to_number(number, F.lit("999999999999D999999")).cast("double") * F.pow(F.lit(1024.0), power))).cast("long")


def duration_text(millis: str | Column) -> Column:
    """950ms, 12.3s or 4m 5s."""
    value = F.col(millis) if isinstance(millis, str) else millis
    seconds = F.floor(value / 1000)
    return (
        F.when(value < 1000, F.concat(value.cast("string"), F.lit("ms")))
        .when(value < 60_000, F.concat(F.floor(value / 1000).cast("string"), F.lit("."), F.floor(value % 1000 / 100).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))
    )


def package_of(key: str | Column) -> Column:
    """The package of an installation key: the name before the version, scopes and peers included."""
    return F.regexp_extract(key, r"^(@?[^@(]+)@", 1)


def wildcard(pattern: str) -> str:
    """A pattern with '*' as an anchored regular expression."""
    return "^" + ".*".join(re.escape(part) for part in pattern.split("*")) + "$"


def environment(variables: str | Column, allow: list[str], deny: list[str] = ()) -> Column:
    """The entries of a map whose names an allowed pattern and no denied one matches."""
    named = lambda k, patterns: F.greatest(F.lit(False), F.lit(False), *(k.rlike(wildcard(p)) for p in patterns))
    return F.map_filter(variables, lambda k, v: named(k, allow) & ~named(k, deny))


def task_environment(variables: Column, inherit: Column, passed: Column, set_: Column, provided: Column | None = None) -> Column:
    """What a task sees of a map of variables, by columns: lists of name patterns to inherit or to pass, and maps of those that commands provided and that are set.

    A struct: environment, the map of inherited, passed, provided and set variables, the later of a name counting; keyed, the inherited
    ones that are not set, whose values its key holds; left_out, other names, in order; errors, why the lists contradict each other, in
    order: 'both:NAME' is inherited and passed, 'path:NAME' is a search path that commands provide and a list names. Null maps and lists are empty.
    """
    no_variables, no_names = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), F.array().cast("array<string>")
    variables, set_ = F.coalesce(variables, no_variables), F.coalesce(set_, no_variables)
    provided = no_variables if provided is None else F.coalesce(provided, no_variables)
    shape = lambda p: F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(p, r"([^\w*])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    any_of = lambda patterns, name: F.exists(F.coalesce(patterns, no_names), lambda p: F.rlike(name, shape(p)))
    names = F.array_sort(F.map_keys(variables))
    kept = F.map_filter(variables, lambda k, v: any_of(inherit, k) | any_of(passed, k))
    over = lambda below, above: F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)
    both = F.transform(F.filter(names, lambda n: any_of(inherit, n) & any_of(passed, n)), lambda n: F.concat(F.lit("both:"), n))
    paths = F.transform(F.array_sort(F.filter(F.map_keys(provided), lambda n: (F.upper(n) == "PATH") & (any_of(inherit, n) | any_of(passed, n)))), lambda n: F.concat(F.lit("path:"), n))
    return F.struct(
        over(over(kept, provided), set_).alias("environment"),
        F.map_filter(variables, lambda k, v: any_of(inherit, k) & ~F.map_contains_key(set_, k)).alias("keyed"),
        F.filter(names, lambda n: ~any_of(inherit, n) & ~any_of(passed, n)).alias("left_out"),
        F.concat(both, paths).alias("errors"),
    )


def redacted(variables: str | Column) -> Column:
    """A map with every value that is there replaced."""
    return F.transform_values(variables, lambda k, v: F.when(v.isNotNull(), F.lit("<redacted>")))
