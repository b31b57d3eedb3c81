"""Lockfiles of version 9 as tables, and what their keys and references name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.formats import package_of
from graphloom.operators.closure import reachable, reachable_pairs
from graphloom.session import counted as checkpointed
from graphloom.session import met

SCHEMA = "path string, kind string, owner string, name string, reference string"


Row = tuple[str, str | None, str | None, str | None]


def _entries(main: dict) -> Iterator[Row]:
    """(kind, owner, name, reference) of what the sections of a workspace document hold."""
    for importer, sections in (main.get("importers") or {}).items():
        yield "importer", importer, None, None
        merged = {name: str(x["version"]) for s in ("dependencies", "devDependencies", "optionalDependencies") for name, x in ((sections or {}).get(s) or {}).items()}
        for name, reference in merged.items():
            yield "direct", importer, name, reference
    for key, snapshot in (main.get("snapshots") or {}).items():
        yield "snapshot", key, None, None
        for name, reference in (((snapshot or {}).get("dependencies") or {}) | ((snapshot or {}).get("optionalDependencies") or {})).items():
            yield "depends", key, name, str(reference)
    for key, package in (main.get("packages") or {}).items():
        yield "resolution", key, None, json.dumps((package or {}).get("resolution"), sort_keys=True, separators=(",", ":"))


def _rows(text: str, part: bool = False) -> Iterator[Row]:
    """(kind, owner, name, reference) of everything a lockfile holds; ValueError if it isn't one of version 9. Of a part of one, what its section holds."""
    import yaml

    if part:
        yield from _entries(yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {})
        return
    main = None
    for document in yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        importers = (document or {}).get("importers") or {}
        if importers and all("configDependencies" in x or "packageManagerDependencies" in x for x in importers.values()):
            yield "environment", None, None, json.dumps(document, sort_keys=True, separators=(",", ":"), default=str)
        elif main is not None:
            raise ValueError("more than one workspace document")
        else:
            main = document
    version = str((main or {}).get("lockfileVersion", ""))
    if version.split(".")[0] != "9":
        raise ValueError(f"lockfile of version {version or 'unknown'}, this code reads 9")
    yield "version", None, None, version
    yield "settings", None, None, json.dumps(main.get("settings"), sort_keys=True, separators=(",", ":"))
    yield from _entries(main)


def scan(files: DataFrame) -> DataFrame:
    """path, kind, owner, name, reference of every entry of lockfiles of files(path, text); a lockfile is one row of files and one text to parse.

    With a column part, rows of which it is true hold some entries of one section.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text, part in zip(frame["path"], frame["text"], frame["part"], strict=True):
                yield pd.DataFrame([(path, *row) for row in _rows(text, part)], columns=["path", "kind", "owner", "name", "reference"], dtype=object)

    part = F.col("part") if "part" in files.columns else F.lit(False)
    return files.select("path", "text", part.alias("part")).mapInPandas(run, SCHEMA)


#: Lines of a section that are parsed together, and more only where one entry has more.
LINES = 4096


def cut(lines: DataFrame, width: int = LINES) -> DataFrame:
    """path, text, part for scan of lockfiles given as lines(path, n, value), n numbering a file's lines, so that no task or row holds a whole one.

    The importers, packages and snapshots of workspace documents are cut between entries, which are keys at two spaces as the package
    manager writes them; what is written in another way stays in one text, as do other sections and documents of an environment.
    """
    n, value = F.col("n"), F.col("value")
    document = F.when(value.rlike(r"^---(\s|$)"), n)
    top = F.when(value.rlike("^[^ #\t\r]"), F.struct(n, F.regexp_extract("value", r"^(importers|packages|snapshots):\s*$", 1).alias("name")))
    rows = lines.select("path", "n", "value", F.floor(n / width).alias("block"), document.alias("document"), top.alias("top"), F.when(value.rlike("^  [^ #:]"), n).alias("head"))
    marks = ["document", "top", "head"]
    here = Window.partitionBy("path", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("path", "block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), n)).alias(c) for c in marks))
    carried = ends.select("path", "block", *(F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in marks))
    placed = rows.select("path", "n", "value", "block", *(F.last(c, ignorenulls=True).over(here).alias(c) for c in marks)).join(carried, ["path", "block"])
    placed = placed.select("path", "n", "value", F.coalesce("document", "_document", F.lit(-1)).alias("document"), F.coalesce("top", "_top").alias("top"), F.coalesce("head", "_head").alias("head"))
    placed = checkpointed(placed.withColumn("head", F.when(F.col("head") > F.col("top.n"), F.col("head"))))
    # a document all of whose importers are an environment's is one text
    inside = F.col("top.name") == "importers"
    counts = placed.where(inside).groupBy("path", "document").agg(F.count_if(n == F.col("head")).alias("all"), F.count_if(value.rlike("^    (configDependencies|packageManagerDependencies):")).alias("own"))
    rest = met(counts.where("own > 0 AND own >= all").select("path", "document", F.lit(True).alias("environment")))
    known = placed.join(rest, ["path", "document"], "left").withColumn("section", F.when(F.col("environment").isNull() & (F.col("top.name") != ""), F.col("top.name")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n").alias("text")
    parts = known.where((F.col("section") != "") & (n != F.col("top.n"))).groupBy("path", "section", F.col("top.n").alias("at"), F.floor(F.col("head") / width).alias("block")).agg(text)
    whole = known.where("section IS NULL").groupBy("path").agg(text)
    return whole.select("path", "text", F.lit(False).alias("part")).unionByName(parts.select("path", F.concat("section", F.lit(":\n"), "text").alias("text"), F.lit(True).alias("part")))


def snapshot_key(name: str | Column, reference: str | Column) -> Column:
    """The installation that a reference points at: a version of the name, or for an alias the whole key; null for a link."""
    name, reference = (F.col(x) if isinstance(x, str) else x for x in (name, reference))
    base = F.substring_index(reference, "(", 1)
    is_key = ~base.contains(":") & base.rlike("^.+@")
    return F.when(~reference.startswith("link:"), F.when(is_key, reference).otherwise(F.concat_ws("@", name, reference)))


def direct(entries: DataFrame) -> DataFrame:
    """importer, name, key of what importers install directly; links are left out."""
    rows = entries.where("kind = 'direct'").select(F.col("owner").alias("importer"), "name", snapshot_key("name", "reference").alias("key"))
    return rows.where("key IS NOT NULL")


def edges(entries: DataFrame) -> DataFrame:
    """source, target: installations and those they depend on."""
    rows = entries.where("kind = 'depends'").select(F.col("owner").alias("source"), snapshot_key("name", "reference").alias("target"))
    return rows.where("target IS NOT NULL")


def installed_as(entries: DataFrame, names: DataFrame) -> DataFrame:
    """name, key of installations of names(name): of the package of the name, and whatever is installed under it as an alias."""
    own = entries.where("kind = 'snapshot'").select(package_of("owner").alias("name"), F.col("owner").alias("key"))
    alias = entries.where("kind IN ('direct', 'depends')").select("name", snapshot_key("name", "reference").alias("key")).where("key IS NOT NULL")
    return own.unionByName(alias).distinct().join(names.select("name").distinct(), "name", "left_semi")


def installed(entries: DataFrame) -> DataFrame:
    """importer, key of all that importers install, directly or not."""
    found = reachable_pairs(direct(entries).select(F.col("importer").alias("group"), F.col("key").alias("id")), edges(entries))
    return found.select(F.col("group").alias("importer"), F.col("id").alias("key"))


def covered(entries: DataFrame, importers: DataFrame, named: DataFrame) -> DataFrame:
    """key of the installations that importers(importer) and named(name) packages cover, and all those reach."""
    starts = direct(entries).join(importers.select("importer").distinct(), "importer", "left_semi").select(F.col("key").alias("id"))
    found = reachable(starts.union(installed_as(entries, named).select("key")).distinct(), edges(entries), dependents=False)
    return found.select(F.col("id").alias("key"))


def external_nodes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(name, package, version), edges(source, target)): a node for each installation, with what importers and installations depend on."""
    key = F.substring_index("owner", "(", 1)
    nodes = entries.where("kind = 'snapshot'").select(F.concat(F.lit("npm:"), F.col("owner")).alias("name"), package_of("owner").alias("package"), F.substring_index(key, "@", -1).alias("version"))
    npm = lambda c: F.concat(F.lit("npm:"), F.col(c))
    both = direct(entries).select(F.col("importer").alias("source"), npm("key").alias("target")).union(edges(entries).select(npm("source"), npm("target")))
    return nodes, both.distinct()
