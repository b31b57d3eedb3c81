"""A small repository of a harbour: projects, what depends on what, and what changes touch, with results derived by hand from the rules."""

from __future__ import annotations

import json

import pytest

from graphloom import api
from graphloom.functions import layers
from graphloom.operators import closure, locators, selection
from graphloom.sources import lockfile, workspace

ROOT = {"name": "harbour", "workspaces": ["front/*", "services/*", "shared/*"], "dependencies": {"chart": "3", "tide": "1"}}
SETTINGS = {"targetDefaults": {"pack": {"cache": True}, "x:ship": {"outputs": ["hold"]}}, "namedInputs": {"policy": ["{workspaceRoot}/rules/*.md", "{workspaceRoot}/licence"]}, "pluginsConfig": {"@nx/js": {"projectsAffectedByDependencyUpdates": "auto"}}}
LOCK = """lockfileVersion: '9.0'
importers:
  front/crane:
    dependencies:
      chart:
        specifier: '3'
        version: {chart}
  services/ledger:
    dependencies:
      tide:
        specifier: '1'
        version: 1.0.0
packages:
  chart@3.0.0: {{resolution: {{integrity: c0}}}}
  chart@3.1.0: {{resolution: {{integrity: c1}}}}
  knot@2.0.0: {{resolution: {{integrity: {knot}}}}}
  tide@1.0.0: {{resolution: {{integrity: t}}}}
snapshots:
  chart@3.0.0: {{}}
  chart@3.1.0: {{}}
  knot@2.0.0: {{}}
  tide@1.0.0: {{dependencies: {{knot: 2.0.0}}}}
"""


def dumped(base: dict, **changed) -> str:
    return json.dumps({k: v for k, v in (base | changed).items() if v is not None})


def harbour(**changed):
    """Five projects: crane (a front end) reads ledger and gauge by its manifest and whatever is tagged core; ledger reads tariff; gauge and tariff read nothing; pier
    leaves crane out of all it would depend on."""
    files = {
        "package.json": dumped(ROOT),
        "nx.json": dumped(SETTINGS),
        "pnpm-lock.yaml": LOCK.format(chart="3.0.0", knot="k0"),
        "tsconfig.base.json": '{"compilerOptions": {"strict": true, "paths": {"@harbour/gauge": ["shared/gauge/src/index.ts"]}}, /* none */ "references": [{"path": "./shared/tariff"}],}',
        "rules/safety.md": "s",
        "licence": "l",
        "docs/readme.txt": "r",
        "front/crane/package.json": json.dumps({"name": "@harbour/crane", "dependencies": {"@harbour/ledger": "workspace:*", "@harbour/gauge": "^1.0.0", "chart": "3"}, "nx": {"tags": ["npm"], "targets": {"ship": {"executor": "x:ship"}}}}),
        "front/crane/project.json": '{"name": "crane", "projectType": "application", // hoists\n "tags": ["ui"], "implicitDependencies": ["tag:core"], "targets": {"pack": {"executor": "x:pack", "inputs": ["policy"]}}}',
        "front/crane/main.ts": "m",
        "services/ledger/package.json": json.dumps({"name": "@harbour/ledger", "version": "1.0.0", "main": "a.js", "dependencies": {"@harbour/tariff": "*", "tide": "1"}, "scripts": {"audit": "a"}}),
        "services/ledger/project.json": '{"name": "ledger", "tags": ["core"], "targets": {"pack": {"executor": "x:pack"}}}',
        "services/ledger/book.ts": "b",
        "services/pier/project.json": '{"name": "pier", "implicitDependencies": ["front/*", "shared/*", "!crane"], "targets": {}}',
        "shared/gauge/package.json": json.dumps({"name": "@harbour/gauge", "version": "1.2.0", "main": "a.js"}),
        "shared/gauge/src/index.ts": "g",
        "shared/tariff/package.json": json.dumps({"name": "@harbour/tariff", "version": "0.1.0", "main": "a.js"}),
        "shared/tariff/project.json": '{"name": "tariff", "tags": ["core"], "targets": {"pack": {"executor": "other:pack"}}}',
        "shared/tariff/rates.ts": "t",
    }
    files.update(changed)
    return {k: v for k, v in files.items() if v is not None}


ALL = ("crane", "ledger", "pier", "@harbour/gauge", "tariff")


def table(spark, files: dict):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def change(spark, before: dict, after: dict):
    rows = [(p, before.get(p), after.get(p)) for p in sorted({*before, *after}) if before.get(p) != after.get(p)]
    return spark.createDataFrame(rows, "path string, before string, after string")


def touched(spark, after: dict, before: dict | None = None):
    rows = api.touched(table(spark, after), change(spark, harbour() if before is None else before, after)).collect()
    return {r.project: r.reasons for r in rows}


def test_projects_and_edges(spark):
    files = table(spark, harbour())
    assert sorted((r.name, r.root, r.project_type, tuple(r.tags)) for r in api.projects(files).collect()) == [
        ("@harbour/gauge", "shared/gauge", None, ()), ("crane", "front/crane", "application", ("npm", "ui")), ("ledger", "services/ledger", None, ("core",)), ("pier", "services/pier", None, ()), ("tariff", "shared/tariff", None, ("core",)),
    ]
    assert {(r.source, r.target, r.kind) for r in api.dependency_edges(files).collect()} == {
        ("crane", "ledger", "static"), ("crane", "@harbour/gauge", "static"), ("ledger", "tariff", "static"), ("crane", "ledger", "implicit"), ("crane", "tariff", "implicit"), ("pier", "@harbour/gauge", "implicit"), ("pier", "tariff", "implicit"),
    }
    assert [r.name for r in api.projects(files, ["tag:ui"]).collect()] == ["crane"]
    assert sorted(r.name for r in api.projects(files, exclude=["tag:core"]).collect()) == ["@harbour/gauge", "crane", "pier"]
    assert sorted(r.name for r in api.projects(files, with_targets=["audit"]).collect()) == ["ledger"]
    nodes, edges = api.graph(files, focus="ledger")
    assert sorted(r.name for r in nodes.collect()) == ["crane", "ledger", "tariff"] and edges.count() == 5
    assert api.target(files, "crane", "ship").count() == 1 and api.project(files, "pier").count() == 1
    assert {(r.code, r.location) for r in api.doctor(files).collect()} == {("unsupported-executor", f"{x}:pack") for x in ("crane", "ledger", "tariff")} | {("unsupported-executor", "crane:ship")}


def test_targets_of_all_layers(spark):
    """A package's targets stay beside project.json's; a local file is above both; defaults are beneath, by executor before name."""
    files = harbour(**{"front/crane/project.local.json": '{"targets": {"ship": {"outputs": ["deck", "..."]}, "pack": {"cache": false}}}'})
    rows = {(r.project, r.target): json.loads(r.definition) for r in workspace.targets(table(spark, files), workspace.load(table(spark, files))).collect()}
    assert rows == {
        ("crane", "ship"): {"executor": "x:ship", "outputs": ["deck", "hold"]},
        ("crane", "pack"): {"executor": "x:pack", "inputs": ["policy"], "cache": False},
        ("ledger", "pack"): {"executor": "x:pack", "cache": True},
        ("ledger", "audit"): {"executor": "nx:run-script", "options": {"script": "audit"}},
        ("tariff", "pack"): {"executor": "other:pack", "cache": True},
    }
    inputs = {(r.project, r.target, r.pattern) for r in workspace.target_inputs(table(spark, files), workspace.load(table(spark, files))).collect()}
    assert {x[2] for x in inputs if x[:2] == ("crane", "pack")} == {"{workspaceRoot}/rules/*.md", "{workspaceRoot}/licence"}
    assert {x[2] for x in inputs if x[:2] == ("ledger", "pack")} == {"{projectRoot}/**/*"}


def test_duplicates_are_refused(spark):
    files = table(spark, harbour(**{"services/pier/project.json": '{"name": "ledger"}'}))
    with pytest.raises(ValueError, match="2 projects with the name ledger"):
        workspace.load(files)


CASES = {
    "a file, one outside, and those that inputs name from the root": ({"shared/tariff/rates.ts": "u", "docs/readme.txt": "s", "rules/safety.md": "t", "licence/full.txt": "t"}, {"tariff": "file:shared/tariff/rates.ts", "crane": "implicit:licence/full.txt;implicit:rules/safety.md"}),
    "a target changed in a project file": ({"shared/tariff/project.json": '{"name": "tariff", "tags": ["core"], "targets": {"pack": {"executor": "other:two"}}}'}, {"tariff": "project-configuration:targets.pack"}),
    "a project file spelt otherwise, with what a default says already, and settings that no key holds": ({"nx.json": dumped(SETTINGS, parallel=9), "shared/tariff/project.json": '{"tags": ["core"], "name": "tariff", "targets": {"pack": {"executor": "other:pack", "cache": true}}}'}, {}),
    "a default touches the targets it reaches, by executor or by name": ({"nx.json": dumped(SETTINGS, targetDefaults={"pack": {"cache": False}, "x:ship": {"outputs": ["deck"]}})}, {"crane": "nx-json:targets.pack;nx-json:targets.ship", "ledger": "nx-json:targets.pack", "tariff": "nx-json:targets.pack"}),
    "settings that keys hold touch all": ({"nx.json": dumped(SETTINGS, plugins=["x"])}, dict.fromkeys(ALL, "nx-json:changed plugins")),
    "a lockfile touches who installs what moved, directly or through others": ({"pnpm-lock.yaml": LOCK.format(chart="3.1.0", knot="k1")}, {"crane": "lockfile:chart@3.0.0;lockfile:chart@3.1.0", "ledger": "lockfile:knot@2.0.0"}),
    "a root dependency touches who installs it": ({"package.json": dumped(ROOT, dependencies={"chart": "4", "tide": "1"})}, {"crane": "root-package:dependencies.chart"}),
    "one that is gone touches all": ({"package.json": dumped(ROOT, dependencies={"chart": "3"})}, dict.fromkeys(ALL, "root-package:dependencies.tide is gone")),
    "a path mapping touches what it points at": ({"tsconfig.base.json": '{"compilerOptions": {"strict": true, "paths": {"@harbour/gauge": ["shared/gauge/src/new.ts"]}}, "references": [{"path": "shared/tariff"}]}'}, {"@harbour/gauge": "tsconfig:path:@harbour/gauge:shared/gauge/src/index.ts;tsconfig:path:@harbour/gauge:shared/gauge/src/new.ts"}),
    "other compiler options touch all": ({"tsconfig.base.json": '{"compilerOptions": {"strict": false}}'}, dict.fromkeys(ALL, "tsconfig:tsconfig")),
}


@pytest.mark.parametrize("case", CASES)
def test_what_changes_touch(spark, case):
    changed, wanted = CASES[case]
    assert touched(spark, harbour(**changed)) == wanted


def test_lockfile_modes(spark):
    """Without a mode a lockfile touches all; a list names projects by selectors; a lockfile of another tool can't be read."""
    of = lambda mode: {"nx.json": dumped(SETTINGS, pluginsConfig={"@nx/js": {"projectsAffectedByDependencyUpdates": mode}} if mode else None)}
    moved = {"pnpm-lock.yaml": LOCK.format(chart="3.1.0", knot="k0")}
    assert touched(spark, harbour(**of(None), **moved), harbour(**of(None))) == dict.fromkeys(ALL, "lockfile:all")
    assert touched(spark, harbour(**of(["tag:core"]), **moved), harbour(**of(["tag:core"]))) == dict.fromkeys(("ledger", "tariff"), "lockfile:listed")
    assert touched(spark, harbour(**{"yarn.lock": "x"})) == dict.fromkeys(ALL, "lockfile:all")


def test_removed_project_touches_its_dependents(spark):
    after = harbour(**{p: None for p in harbour() if p.startswith("shared/tariff/")})
    assert touched(spark, after) == {"crane": "removed:tariff", "ledger": "removed:tariff", "pier": "removed:tariff"}


def test_affected_with_chain(spark):
    after = harbour(**{"shared/gauge/src/index.ts": "h"})
    found = {r.id: (r.parent, r.first, r.reasons, r.chain) for r in api.explain_affected(table(spark, after), change(spark, harbour(), after), ["crane"]).collect()}
    gauge, cause = "@harbour/gauge", "file:shared/gauge/src/index.ts"
    assert found == {gauge: (None, gauge, cause, None), "crane": (gauge, gauge, cause, [gauge, "crane"]), "pier": (gauge, gauge, cause, None)}


def test_affected_tasks(spark):
    """A file of ledger is no input of crane's pack, which reads policies alone, but ledger's pack comes before it."""
    rules = spark.createDataFrame([("pack", "pack", True)], "target string, on_target string, upstream boolean")
    requests = spark.createDataFrame([("crane", "pack")], "project string, target string")

    def tasks(granularity="tasks", **changed):
        after = harbour(**changed)
        rows = api.affected_tasks(table(spark, after), change(spark, harbour(), after), requests, rules, granularity).collect()
        return {(r.project, r.via, r.reasons) for r in rows}

    changed = {"rules/safety.md": "n", "front/crane/main.ts": "n", "nx.json": dumped(SETTINGS, targetDefaults={"pack": {"cache": True}, "x:pack": {"cache": False}, "x:ship": {"outputs": ["hold"]}})}
    assert tasks(**changed) == {("ledger", None, "configuration:definition"), ("crane", None, "configuration:definition;input:rules/safety.md")}


def test_implicit_selectors(spark):
    """Selectors that take away count after all that add; a word in a name, a folder, and what selects nothing."""
    projects = spark.createDataFrame([("a", "x/a", ["t"]), ("b/core", "x/b", []), ("c", "y/c", ["t", "u"])], "name string, root string, tags array<string>")
    implicit = spark.createDataFrame([("c", 0, "!tag:u"), ("c", 1, "x/*"), ("a", 0, "core"), ("a", 1, "gone"), ("b/core", 0, "!a"), ("b/core", 1, "tag:t")], "source string, turn int, pattern string")
    static = spark.createDataFrame([("b/core", "a"), ("a", "c")], "source string, target string")
    found = selection.edges_with_implicit(static, implicit, projects)
    assert {tuple(r) for r in found.collect()} == {("a", "c", "static"), ("c", "a", "implicit"), ("c", "b/core", "implicit"), ("a", "b/core", "implicit"), ("b/core", "c", "implicit")}
    assert [tuple(r) for r in selection.unknown_names(implicit, projects).collect()] == [("a", "gone")]


@pytest.mark.parametrize("seed", range(3))
def test_selectors_in_rows_match_lists(spark, seed):
    import random

    rng = random.Random(seed)
    pool = ["p1", "area1/*", "!p2", "tag:t1", "!tag:t0", "*", "directory:area0/**", "name:p*", "core", "!*/m1?", "nothing", "!directory:area2/m2"]
    projects = [(f"p{k}" if k % 3 else f"x-core{'' if k % 2 else 's'}/{k}", f"area{k % 3}/m{k}", [f"t{k % 2}", f"u{k}"]) for k in range(24)]
    frame = spark.createDataFrame(projects, "name string, root string, tags array<string>")
    lists = {f"o{k}": [rng.choice(pool) for _ in range(rng.randint(1, 4))] for k in range(6)}
    rows = spark.createDataFrame([(o, turn, p) for o, ps in lists.items() for turn, p in enumerate(ps)], "owner string, turn int, pattern string")
    found = {o: set() for o in lists}
    for r in selection.matching(rows, frame).collect():
        found[r.owner].add(r.name)
    one = frame.select("name", "root", frame.tags[0].alias("tag"))
    assert found == {o: {r.name for r in selection.select_projects(one, ps).collect()} for o, ps in lists.items()}


MERGES = [
    ([1, 2], ["...", 3], [1, 2, 3]),
    (None, ["a", "..."], ["a"]),
    ({"a": 1, "b": 2}, {"a": 9, "...": True, "b": 8}, {"a": 1, "b": 8}),
    ({"a": 1}, {"b": 2}, {"b": 2}),
    ({"a": 1}, None, None),
]


@pytest.mark.parametrize("base, new, wanted", MERGES)
def test_values_merge(base, new, wanted):
    assert layers.overlaid(base, new) == wanted


def test_targets_merge():
    base = {"executor": "e", "cache": True, "inputs": ["a"], "options": {"x": 1, "y": [1]}, "configurations": {"dev": {"p": 1}, "ci": {"q": 2}}}
    assert layers.merged(base, {"inputs": ["...", "b"], "options": {"y": ["...", 2]}, "configurations": {"dev": {"r": 3}}}) == {
        "executor": "e", "cache": True, "inputs": ["a", "b"], "options": {"x": 1, "y": [1, 2]}, "configurations": {"dev": {"p": 1, "r": 3}, "ci": {"q": 2}},
    }
    assert layers.merged(base, {"cache": False, "...": True, "inputs": []}) == base | {"inputs": []}
    assert layers.merged(base, {"executor": "other", "cache": False}) == {"executor": "other", "cache": False}
    one, two = ({"executor": "nx:run-commands", "options": {"command": c}} for c in "ab")
    assert not layers.compatible(one, two) and layers.compatible(one, {"options": {}}) and layers.compatible(one, {"executor": "nx:run-commands"})
    assert layers.resolved([{"command": "go", "cache": False}], [{"outputs": ["o"], "options": {"command": "no", "cwd": "."}}]) == {"outputs": ["o"], "options": {"cwd": ".", "command": "go"}, "executor": "nx:run-commands", "cache": False}
    assert layers.resolved([{"executor": "a"}], [{"executor": "b", "cache": True}]) == {"executor": "a"}


def test_not_compared_and_modes(spark):
    projects = spark.createDataFrame([("a", "x"), ("b", "y")], "project string, root string")
    edges = spark.createDataFrame([], "source string, target string")
    deleted = spark.createDataFrame([("x/project.json",)], "path string")
    assert locators.by_removed(projects, projects, edges, edges, deleted, compared=False).count() == 2
    changes, importers = spark.createDataFrame([("i", "k@1")], "importer string, key string"), spark.createDataFrame([("i", "a")], "importer string, project string")
    count = lambda mode, changed=True: locators.by_lockfile(changes, importers, projects, mode, changed).count()
    assert (count("auto"), count(["b"]), count("all"), count("all", False)) == (1, 1, 2, 0)


def test_lockfile_versions(spark):
    with pytest.raises(Exception, match="lockfile of version 6"):
        lockfile.scan(spark.createDataFrame([("l", "lockfileVersion: '6.0'\nimporters: {}\n")], "path string, text string")).count()


def depth_first(edges):
    after, visited, dropped = {}, set(), set()
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def visit(node, path):
        if node in visited:
            return
        visited.add(node)
        for target in sorted(after.get(node, ())):
            if target in path:
                dropped.add((node, target))
            else:
                visit(target, [*path, target])

    for node in sorted({x for e in edges for x in e}):
        visit(node, [node])
    return sorted(set(edges) - dropped)


@pytest.mark.parametrize("seed", range(3))
def test_cycles_are_broken_as_a_depth_first_search_breaks_them(spark, seed):
    import random

    rng = random.Random(seed)
    edges = sorted({(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(30)})
    frame = spark.createDataFrame(edges, "source long, target long")
    left = closure.acyclic(frame)
    assert sorted(tuple(r) for r in left.collect()) == depth_first(edges) and not closure.has_cycle(left)
    way = [r.id for r in sorted(closure.cycle(frame).collect(), key=lambda r: r.place)]
    assert way and all((a, b) in set(edges) for a, b in zip(way, way[1:] + way[:1]))
    with pytest.raises(ValueError):
        closure.longest_paths(spark.range(15).selectExpr("id", "1L AS weight"), frame).count()


def plain_lengths(weights: dict, edges) -> dict:
    """id -> (length, via) of numbered ids whose edges lead to smaller ones."""
    best: dict = {}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    for k in sorted(weights):
        top = max(((best[b][0], -b) for b in near.get(k, ())), default=None)
        best[k] = (weights[k] + (top[0] if top else 0), -top[1] if top else None)
    return best


@pytest.mark.parametrize("small", [100_000, 70])
def test_longest_paths_match_a_plain_version(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(closure, "SMALL", small)
    rng = random.Random(small)
    edges = sorted({(b, a) for a, b in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)) if a < b} | {(k + 1, k) for k in range(41, 60)} | {(k + 2, k - k % 2 + j) for k in range(60, 78) for j in (0, 1)})
    weights = {k: rng.randint(0, 4) for k in range(81)}
    found = closure.longest_paths(spark.createDataFrame(list(weights.items()), "id long, weight long"), spark.createDataFrame(edges, "source long, target long"))
    assert {r.id: (r.length, r.via) for r in found.collect()} == plain_lengths(weights, edges)


@pytest.mark.parametrize("small", [100_000, 5])
def test_what_leads_to_cycles(spark, monkeypatch, small):
    import random

    monkeypatch.setattr(closure, "SMALL", small)
    rng = random.Random(small)
    for n in (20, 45):
        edges = {(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(n)}
        left = set(edges)
        while True:
            held = {(a, b) for a, b in left if any(b == c for c, _ in left)}
            if held == left:
                break
            left = held
        frame = spark.createDataFrame(sorted(edges), "source long, target long")
        assert {tuple(r) for r in closure.cyclic_part(frame).collect()} == left and closure.has_cycle(frame) == bool(left)
        if left:
            with pytest.raises(ValueError, match="cycle"):
                closure.longest_paths(spark.range(40).selectExpr("id", "1L AS weight"), frame).count()
