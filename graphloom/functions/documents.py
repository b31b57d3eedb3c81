"""JSON documents: canonical text, digests, recursive differences and comments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from copy import deepcopy

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*[}\]])', re.S)


def canonical(text: str | Column) -> Column:
    """A JSON text with sorted keys at every depth and no spaces; numbers lose their spelling (1.0 is 1)."""
    return F.to_json(F.parse_json(text))


def digest(text: str | Column) -> Column:
    return F.sha2(canonical(text), 256)


def set_digest(column: str | Column) -> Column:
    """An aggregate: the digest of the sorted distinct values."""
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(column))), 256)


def plain_json(text: str) -> str:
    """JSON of a text with comments and trailing commas."""
    return _JSONC.sub(lambda m: m[1] or "", text)


def _children(value: object) -> dict | None:
    return value if isinstance(value, dict) else {str(k): v for k, v in enumerate(value)} if isinstance(value, list) else None


def changes(before: object, after: object) -> Iterator[tuple[str, tuple[str, ...], object, object]]:
    """(kind, path, before, after) of every difference, depth first in the order of keys; a changed leaf's ancestors are Modified too, arrays go by index."""
    waiting = [("Modified", (), before, after)]
    while waiting:
        kind, path, before, after = waiting.pop()
        if path:
            yield kind, path, before, after
        old, new = _children(before), _children(after)
        if kind != "Modified" or old is None or new is None or isinstance(before, dict) != isinstance(after, dict):
            continue
        for key in sorted({*old, *new}, reverse=True):
            if key not in new:
                waiting.append(("Deleted", (*path, key), old[key], None))
            elif key not in old:
                waiting.append(("Added", (*path, key), None, new[key]))
            elif json.dumps(old[key], sort_keys=True) != json.dumps(new[key], sort_keys=True):
                waiting.append(("Modified", (*path, key), old[key], new[key]))


@F.udtf(returnType="kind string, path string, before string, after string")
class JsonDiff:
    """Table function: the differences of two JSON texts, paths joined by dots."""

    def eval(self, before: str, after: str):
        parse = lambda text: json.loads(text) if text is not None else {}
        show = lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"))
        for kind, path, old, new in changes(parse(before), parse(after)):
            yield kind, ".".join(path), None if kind == "Added" else show(old), None if kind == "Deleted" else show(new)


#: Manifest fields that mean nothing to dependents, what a lockfile stands for, and settings that no key holds.
DEPENDENT_IGNORED = "version scripts description keywords author contributors maintainers license homepage repository bugs funding private publishConfig".split()
DECLARATIONS = "dependencies devDependencies peerDependencies peerDependenciesMeta optionalDependencies dependenciesMeta".split()
RESOLUTION_KEYS = "catalog catalogs dedupePeerDependents dedupePeers minimumReleaseAge minimumReleaseAgeExclude overrides patchedDependencies peerDependencyRules resolutionMode".split()
UNKEYED_SETTINGS = (
    "targetDefaults namedInputs $schema extends defaultBase affected parallel tui cli generators release sync s3 nxCloudId nxCloudAccessToken nxCloudUrl "
    "nxCloudEncryptionKey neverConnectToCloud defaultProject"
).split()
UNKEYED_PROJECT = "name targets namedInputs tags implicitDependencies sourceRoot metadata projectType $schema generators release".split()


def uncommented(text: str | Column) -> Column:
    """JSON of a text with comments and trailing commas; what stands in strings stays."""
    pattern = r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/|,(?=\s*[}\]])'
    return F.regexp_replace(text, pattern, "$1")


def entries(text: str | Column) -> Column:
    """The top-level fields of a JSON object as a map of variants; null for anything else."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.from_json(text, "map<string,variant>"))


def without_fields(text: str | Column, names: list[str]) -> Column:
    """A JSON object in canonical form without some of its fields."""
    kept = F.map_filter(entries(text), lambda k, v: ~k.isin(*names))
    return canonical(F.to_json(kept))


def manifest_for_dependents(text: str | Column, lockfile: bool) -> Column:
    """A manifest as dependents read it: without metadata and, where a lockfile records what is installed, without declarations."""
    return without_fields(text, DEPENDENT_IGNORED + (DECLARATIONS if lockfile else []))


def keyed_settings(text: str | Column, own: list[str] = ()) -> Column:
    """Workspace settings that keys hold: of `cli` its packageManager alone; own are further names of a tool that no key holds."""
    manager = F.try_variant_get(F.try_parse_json(text), "$.cli.packageManager", "variant")
    kept = F.map_filter(entries(text), lambda k, v: ~k.isin(*UNKEYED_SETTINGS, *own))
    with_manager = F.map_concat(kept, F.map_from_arrays(F.array(F.lit("cli")), F.array(F.parse_json(F.concat(F.lit('{"packageManager":'), F.to_json(manager), F.lit("}"))))))
    return canonical(F.to_json(F.when(manager.isNotNull(), with_manager).otherwise(kept)))


def keyed_definition(text: str | Column, own: list[str] = ()) -> Column:
    """A target's definition as its key holds it: without what only describes it, and without further names (own) that change no result."""
    return without_fields(text, ["metadata", *own])


def _read(path: str, text: str) -> object:
    """What a JSON or YAML text holds, whatever its parser raises where it isn't its own."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    return json.loads(plain_json(text))


def _projection(value: object, fields: list[str] | None, exclude: list[str]) -> str:
    if fields is not None:
        kept: dict = {}
        for field in fields:
            found, known = value, True
            for part in field.split("."):
                known = known and isinstance(found, dict) and part in found
                found = found[part] if known else None
            if known:
                *parents, last = field.split(".")
                at = kept
                for part in parents:
                    at = at.setdefault(part, {})
                    if not isinstance(at, dict):
                        break
                if isinstance(at, dict):
                    at[last] = found
        value = kept
    for field in exclude:
        *parents, last = field.split(".")
        at = value
        for part in parents:
            at = at.get(part) if isinstance(at, dict) else None
        if isinstance(at, dict):
            at.pop(last, None)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def projection(path: str, text: str, fields: list[str] | None, exclude: list[str]) -> str | None:
    """Some dotted fields of a JSON or YAML text as canonical JSON, less excluded ones; null if it can't be read."""
    try:
        value = _read(path, text)
    except Exception:  # whatever a parser raises on a text that isn't its own
        return None
    return _projection(value, fields, exclude)


def projected(path: str | Column, text: str | Column, fields: list[str] | None = None, exclude: list[str] = ()) -> Column:
    """As projection, of columns, in Arrow batches."""
    exclude = list(exclude)

    @F.pandas_udf("string")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else projection(p or "", t, fields, exclude) for p, t in zip(paths, texts, strict=True)], dtype=object)

    return run(path, text)


def projections(path: str | Column, text: str | Column, *wanted: tuple[list[str] | None, list[str]]) -> Column:
    """An array of what projection gives for each (fields, exclude) wanted; a text is parsed once. Null for a null text."""

    def each(path: str, text: str | None) -> list[str | None] | None:
        if text is None:
            return None
        try:
            value = _read(path, text)
        except Exception:  # as above
            return [None] * len(wanted)
        return [_projection(deepcopy(value) if exclude else value, fields, list(exclude)) for fields, exclude in wanted]

    @F.pandas_udf("array<string>")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([each(p or "", t) for p, t in zip(paths, texts, strict=True)], dtype=object)

    return run(path, text)


def tsconfig_parts(text: str | Column) -> Column:
    """A tsconfig as a struct: rest (canonical JSON), paths (mapping to targets) and references (normalised); references that aren't all plain paths stay in rest."""
    from graphloom.functions.names import posix_join

    plain = uncommented(text)
    fields = entries(plain)
    options = F.from_json(F.to_json(fields["compilerOptions"]), "map<string,variant>")
    paths = F.from_json(F.to_json(options["paths"]), "map<string,array<string>>")
    listed = F.from_json(F.to_json(fields["references"]), "array<map<string,string>>")
    simple = listed.isNotNull() & ~F.exists(listed, lambda x: (F.size(x) != 1) | x["path"].isNull())
    rest_options = F.to_json(F.map_filter(options, lambda k, v: k != "paths"))
    rest = F.map_filter(fields, lambda k, v: ~((k == "references") & simple) & (k != "compilerOptions"))
    rest = F.when(options.isNotNull(), F.map_concat(rest, F.map_from_arrays(F.array(F.lit("compilerOptions")), F.array(F.try_parse_json(rest_options))))).otherwise(
        F.map_filter(fields, lambda k, v: ~((k == "references") & simple))
    )
    references = F.when(simple, F.array_sort(F.array_distinct(F.transform(listed, lambda x: F.regexp_replace(posix_join(F.lit(""), x["path"]), "(.)/$", "$1")))))
    return F.struct(canonical(F.to_json(rest)).alias("rest"), F.coalesce(paths, F.create_map().cast("map<string,array<string>>")).alias("paths"), F.coalesce(references, F.array().cast("array<string>")).alias("references"))
