"""Operators and functions on hand-made tables: cases that the derived views don't hold."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import documents, formats, globs, semver
from graphloom.operators import accesses, closure, history, locate, schedule, selection, storage, tasks
from graphloom.operators.asof import last_before
from graphloom.streaming import watch
from tests import plain_ranges


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


def test_closure_is_safe_on_cycles_and_self_links(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)])
    seeds = spark.createDataFrame([(1,)], "id long")
    for function in (closure.reachable, closure.reachable_by_doubling):
        assert ids(function(seeds, ring)) == [1, 2, 3, 4]
        assert ids(function(seeds, ring, dependents=False)) == [1, 2, 3]
        assert ids(function(seeds.limit(0), ring)) == []
    assert closure.has_cycle(ring) and not closure.has_cycle(edges(spark, [(2, 1), (3, 1), (3, 2)])) and not closure.has_cycle(ring.limit(0))


def test_doubling_gives_shortest_depths(spark):
    chain = [(k, k - 1) for k in range(1, 300)] + [(250, 3), (200, 10)]
    seeds = spark.createDataFrame([(0,)], "id long")
    found = {r.id: r.depth for r in closure.reachable_by_doubling(seeds, edges(spark, chain)).collect()}
    assert found[9] == 9 and found[199] == 199 and found[200] == 11 and found[250] == 4 and found[299] == 53 and len(found) == 300


def test_explanations_follow_the_queue(spark):
    found = {r.id: r for r in closure.explained(spark.createDataFrame([(1,), (2,)], "id long"), edges(spark, [(5, 2), (5, 1), (6, 5), (6, 2), (7, 6), (7, 5), (2, 1)])).collect()}
    assert (found[2].parent, found[2].first) == (None, 2) and (found[5].parent, found[5].first, found[5].also) == (1, 1, [2])
    assert (found[6].parent, found[6].first) == (2, 2) and (found[7].parent, found[7].first, found[7].also) == (5, 1, [6])
    rows = spark.createDataFrame(list(found.values()), "id long, depth int, parent long, first long, rank long, also array<long>")
    assert {r.id: r.chain for r in closure.chains(rows, rows.where("id >= 6").select("id")).collect()} == {6: [2, 6], 7: [1, 5, 7]}


def test_all_chains_match_a_plain_walk(spark):
    rng = random.Random(4)
    parents = {k: None if k % 50 == 0 else rng.randint(k - k % 50, k - 1) for k in range(200)} | {200: 0} | {k: k - 1 for k in range(201, 260)}
    found = {r.id: r.chain for r in closure.chains(spark.createDataFrame(list(parents.items()), "id long, parent long")).collect()}
    plain = {k: [k] for k, up in parents.items() if up is None}
    for k in sorted(parents):
        plain.setdefault(k, plain.get(parents[k], []) + [k])
    assert found == plain


def test_affected_causes_hold_whole_chains(spark, tmp_path):
    from graphloom.plans import registry

    spark.range(1, 2001).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES["g4_affected_cause"](spark, str(tmp_path)).collect()
    chains = {r.id: [int(x) for x in r.chain.split(">")] for r in found}
    for r in found:
        chain = chains[r.id]
        assert (chain[0], chain[-1], len(chain) - 1) == (r.first, r.id, r.depth) and chain[0] % 97 == 5
        assert chain[:-1] == (chains[r.parent] if r.parent is not None else [])
        assert all(a in (b // 2, b // 3) for a, b in zip(chain, chain[1:]))
    assert max(map(len, chains.values())) > 5


def test_longest_paths_break_ties_by_order(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 5), (3, 2), (4, 0), (9, 0)], "id long, weight long")
    graph = edges(spark, [(3, 2), (3, 1), (4, 3), (3, 77)])
    found = {r.id: (r.length, r.via) for r in closure.longest_paths(nodes, graph).collect()}
    assert found == {1: (5, None), 2: (5, None), 3: (7, 1), 4: (7, 3), 9: (0, None)}
    assert {r.id: r.wave for r in schedule.waves(nodes, graph).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 9: 0}
    assert [r.id for r in closure.critical_path(nodes, graph).orderBy("position").collect()] == [1, 3]
    assert closure.critical_path(nodes.where("weight = 0"), graph).count() == 0
    with pytest.raises(ValueError):
        closure.longest_paths(nodes, edges(spark, [(1, 2), (2, 1)]))


def test_upper_median_prefers_the_newer_of_equals(spark):
    rows = [("a", k, "miss", "success", 100 - k, 10 if k < 4 else 20, k, k) for k in range(4)] + [("b", 9, "local-hit", "success", 1, 1, 1, 1), ("c", 9, "miss", "cancelled", 1, 1, 1, 1)]
    log = spark.createDataFrame(rows, "task string, execution long, cache string, status string, started long, millis long, cores long, memory long")
    assert [tuple(r) for r in history.expected(log).collect()] == [("a", 10, 2, 3)]


@pytest.mark.parametrize(
    ("glob", "path", "wanted"),
    [("*.js", "a.js", True), ("*.js", "b/a.js", False), ("**/*.js", "a.js", True), ("**/*.js", "x/y/a.js", True), ("src/**", "src", False), ("src/**", "src/a/b", True), ("a/**/b", "a/b", True),
     ("{a,b{c,d}}/x?", "bd/xy", True), ("{a,b{c,d}}/x?", "b/xy", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.b+(c)", "a.b+(c)", True), ("*", ".hidden", True), ("", "", True)],
)
def test_globs(spark, glob, path, wanted):
    assert spark.range(1).select(globs.matches(F.lit(path), glob)).first()[0] is wanted


def test_globs_without_dot_and_prefixes(spark):
    assert spark.range(1).select(globs.matches(F.lit(".hidden"), "*", dot=False)).first()[0] is False
    assert globs.literal_prefix("src/app/*.ts") == "src/app/" and globs.literal_prefix("plain") == "plain"


def test_semver(spark):
    cases = [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.1", True), ("0.3.0", "^0.2.1", False), ("0.0.3", "^0.0.3", True), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2", True), ("1.3.0", "~1.2", False),
     ("1.5.0", "1.x", True), ("2.0.0", "1.x", False), ("1.0.0", "*", True), ("1.0.0", "", True), ("2.3.4", "1.2.3 - 2.3.4", True), ("1.2.3-beta.2", ">=1.2.3-beta.1", True), ("1.2.3-beta.10", ">1.2.3-beta.9", True),
     ("1.2.3-alpha", "<1.2.3", True), ("3.0.0", "<2 || >=3", True), ("2.5.0", "<2 || >=3", False), ("1.0.0", ">x", False), ("1.0.0", "<*", False), ("bad", "*", False), ("1.0.0", "not-a-range", False), (None, "*", False), ("1.0.0", None, False)]
    found = semver.with_satisfies(spark.createDataFrame(cases, "version string, wanted string, found boolean"), "version", "wanted")
    assert found.where("found <> satisfied").collect() == [] and found.count() == len(cases)
    assert "Python" not in found._jdf.queryExecution().toString()


def _ranges(seed: int, n: int):
    draw = random.Random(seed)
    pick = draw.choice
    tail = ["", "", "", "-alpha", "-alpha.1", "-alpha.beta", "-1", "-10.a", "-2", "-a-b", "-a..b"]
    version = lambda: f"{pick(['', 'v', '= '])}{pick([0, 0, 1, 2, 10, '007'])}.{pick([0, 1, 2, 10])}.{pick([0, 3, 12, 10**24])}{pick(tail)}{pick(['', '+b1'])}"
    part = lambda: pick(["", ">", ">=", "<", "<=", "=", "^", "~", "~>"]) + pick(["", " "]) + ".".join(pick(["0", "1", "2", "10", "x", "*"]) for _ in range(pick([1, 2, 3]))) + pick(tail)
    whole = lambda: pick([f"{version()} - {version()}", pick(["", "*", "bad", "||", "1 || ", " ^1.2 "]), part(), f"{part()}  {part()}", f"{part()} || {part()}"])
    return [(pick([version(), version(), version(), "1.2", None]), whole()) for _ in range(n)]


def test_semver_is_as_plain_ranges_say(spark):
    rows = [*_ranges(7, 1500), ("1.0.0", None), (None, None)]
    found = semver.with_satisfies(spark.createDataFrame(rows, "version string, wanted string"), "version", "wanted").collect()
    assert [tuple(r) for r in found if r[2] != plain_ranges.satisfies(r[0], r[1])] == []


def test_newest_within_ranges(spark):
    versions = [(name, v) for name, seed, n in (("hot", 8, 400), ("rare", 9, 4)) for v, _ in _ranges(seed, n)] + [("rare", "1.0.0"), ("rare", "v1.0.0"), (None, "1.0.0")]
    wanted = [(name, r) for name in ("hot", "rare", "none") for _, r in _ranges(10, 60)] + [("rare", "1.0.0"), ("rare", None)]
    found = semver.newest_within(spark.createDataFrame(wanted, "name string, range string"), spark.createDataFrame(versions, "name string, version string")).collect()
    parsed = [(name, plain_ranges.parse(v), v) for name, v in versions if plain_ranges.parse(v)]
    for name, wish in set(wanted):
        held = [(p, v) for n, p, v in parsed if n == name and plain_ranges.satisfies(v, wish)]
        best = min((v for p, v in held if p == max(held)[0]), default=None)
        assert [r.version for r in found if (r.name, r.range) == (name, wish)] == [best]


def test_last_before_carries_over_blocks(spark):
    rows = [(k, n, n if n % 7 == 0 and k else None) for k in ("a", "b", None) for n in range(100)]
    found = last_before(spark.createDataFrame(rows, "k string, n int, v int").withColumn("block", F.floor(F.col("n") / 3)), ["k"], "block", ["n"], "v").collect()
    assert {(r.k, r.n): r.last for r in found} == {(k, n): ((n - 1) // 7 * 7 if k and n else None) for k, n, _ in rows}


def test_json_documents(spark):
    assert json.loads(documents.plain_json('{"a": 1, /* x */ "b": ["//no", 2,], // end\n}')) == {"a": 1, "b": ["//no", 2]}
    found = list(documents.changes({"a": {"b": 1}, "c": [1, 2], "d": 0}, {"a": {"b": 2}, "c": [1], "e": None}))
    assert [(k, ".".join(p)) for k, p, _, _ in found] == [("Modified", "a"), ("Modified", "a.b"), ("Modified", "c"), ("Deleted", "c.1"), ("Deleted", "d"), ("Added", "e")]
    same = spark.createDataFrame([('{"b":1,"a":{"d":2,"c":3}}',), ('{ "a": {"c":3, "d":2}, "b": 1 }',)], "t string").select(documents.digest("t").alias("d")).distinct()
    assert same.count() == 1


def test_selectors_fall_back_to_directories(spark):
    projects = spark.createDataFrame([("web", "front", "apps/web"), ("web-e2e", "test", "apps/web-e2e"), ("core", "lib", "libs/core"), ("@org/ui-core", "lib", "libs/ui")], "name string, tag string, root string")
    names = lambda *patterns: sorted(r.name for r in selection.select_projects(projects, list(patterns)).collect())
    assert names("libs/*") == ["@org/ui-core", "core"]
    assert names("core") == ["core"]
    assert names("!tag:lib") == ["web", "web-e2e"]
    assert names("*", "!web*", "web-e2e") == ["@org/ui-core", "core", "web-e2e"]
    assert names() == [] and names("tag:l*", "!directory:libs/ui") == ["core"]


def test_owners_take_the_longest_root(spark):
    paths = spark.createDataFrame([("apps/web/src/a.ts",), ("apps/webby/b.ts",), ("README.md",)], "path string")
    roots = spark.createDataFrame([("apps/web",), ("apps",), ("apps/web/src/a.ts/x",)], "root string")
    assert {r.path: r.owner for r in locate.owners(paths, roots).collect()} == {"apps/web/src/a.ts": "apps/web", "apps/webby/b.ts": "apps", "README.md": "."}


def test_reads_after_own_writes(spark):
    rows = [(1, 1, "p", "read"), (2, 1, "p", "write"), (3, 1, "p", "read"), (4, 2, "p", "read"), (5, 2, "q", "missing")]
    log = spark.createDataFrame(rows, "seq long, task long, path string, operation string")
    assert sorted((r.task, r.n) for r in accesses.outside_reads(log).collect()) == [(1, 1), (2, 1)]
    assert [r.seq for r in accesses.generated(log).collect()] == [3]
    declared = spark.createDataFrame([(2, "p"), (2, "z")], "task long, path string")
    found = {r.seq: r.category for r in accesses.categories(log, declared, spark.createDataFrame([("q",)], "path string")).collect()}
    assert found == {1: "uncovered", 2: "output", 3: "generated", 4: "input", 5: "dependency-output"}


def test_shared_blobs_go_with_their_last_entry(spark):
    entries = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 30, 5)], "entry long, used long, size long")
    blobs = spark.createDataFrame([(7, 100), (8, 50), (9, 1000)], "blob long, size long")
    cites = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8)], "entry long, blob long")
    gone = lambda limit, before: sorted((r.entry, r.freed) for r in storage.evictions(entries, cites, blobs, limit, before).collect())
    assert gone(1000, 0) == []
    assert gone(160, 0) == [(1, 5), (2, 105)]
    assert gone(1000, 25) == [(1, 5), (2, 105)]
    assert storage.evictions(entries.limit(0), cites.limit(0), blobs, 10, 0).count() == 0


def test_capped_debounce():
    batch = watch.Debounce(gap=150, cap=1000)
    out = [batch.add(at, path) for at, path in [(0, "a"), (100, "a"), (140, "b"), (280, "c"), (400, "c"), (429, "d"), (900, "e")]]
    assert [x for x in out if x] == [(0, 4)] and batch.close() == (900, 1)
    batch = watch.Debounce(gap=150, cap=300)
    out = [batch.add(100 * k, str(k)) for k in range(8)]
    assert [x for x in out if x] == [(0, 3), (300, 3)] and batch.close() == (600, 2) and batch.close() is None


def test_watch_stream_puts_out_what_the_batch_form_does(spark, tmp_path):
    rows = [(w, f"p{k % 4}", 1_700_000_000_000 + 70 * k + 1000 * (k // 5)) for w in (1, 2) for k in range(20)]
    frame = spark.createDataFrame(rows, "watcher long, path string, at long")
    wanted = sorted(tuple(r) for r in watch.capped_batches(frame, 150, 400).collect())
    source = frame.select("watcher", "path", F.timestamp_millis("at").alias("ts"))
    last = spark.createDataFrame([(3, "z", 1_800_000_000_000), ], "watcher long, path string, at long").select("watcher", "path", F.timestamp_millis("at").alias("ts"))
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    run = lambda: watch.capped_stream(stream, 150, 400).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    last.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    found = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("watcher < 3").collect())
    assert found == wanted


def test_sizes_durations_and_environment(spark):
    from graphloom.functions import formats

    rows = spark.createDataFrame([("12.5GB", 950), ("1k", 12_345), ("7", 245_000), ("x", 0)], "s string, m long")
    assert [tuple(r) for r in rows.select(formats.size_bytes("s"), formats.duration_text("m")).collect()] == [(13421772800, "950ms"), (1024, "12.3s"), (7, "4m 5s"), (None, "0ms")]
    kept = spark.range(1).select(formats.redacted(formats.environment(F.create_map(F.lit("A_X"), F.lit("1"), F.lit("B"), F.lit(None)), ["A_*", "B"])).alias("m")).first().m
    assert kept == {"A_X": "<redacted>", "B": None}


def test_dotenv_expands_in_order():
    from graphloom.sources.logs import dotenv

    text = "A=1\nexport B=\"x $A\\n\" # note\nC='$A'\nD=${B}y\n# E=2\nF = plain value # c\nG=$H"
    assert dotenv(text, {"H": "h"}) == {"A": "1", "B": "x 1\n", "C": "$A", "D": "x 1\ny", "F": "plain value", "G": "h"}


def test_history_store_replaces_runs_and_reads_older_versions(spark, tmp_path):
    from graphloom.sources import history_store

    path = f"{tmp_path}/history"
    run = lambda r, n: spark.createDataFrame([(r, f"t{k}", 10 * k) for k in range(n)], "run string, task string, started long")
    history_store.write_run(run("a", 3), path)
    history_store.write_run(run("b", 2), path)
    history_store.write_run(run("a", 1).withColumn("cores", F.lit(4)), path)
    found = history_store.read_history(spark, path)
    assert sorted((r.run, r.task, r.cores) for r in found.collect()) == [("a", "t0", 4), ("b", "t0", None), ("b", "t1", None)]
    assert [r.run for r in history_store.stale_runs(found, 1).collect()] == ["a"]
    spark.createDataFrame([("c", "t", 1, 99)], "run string, task string, started long, schema_version int").write.mode("append").partitionBy("run").parquet(path)
    with pytest.raises(ValueError):
        history_store.read_history(spark, path)


def test_task_plans_look_through_projects_without_the_target(spark):
    from graphloom.operators import affected

    graph = spark.createDataFrame([("app", "empty"), ("empty", "lib"), ("app", "lib2"), ("lib", "app")], "source string, target string")
    has = spark.createDataFrame([("app", "build"), ("app", "prepare"), ("lib", "build"), ("lib2", "test")], "project string, target string")
    rules = spark.createDataFrame([("build", "build", True), ("build", "prepare", False), ("prepare", "prepare", False)], "target string, on_target string, upstream boolean")
    tasks, links = affected.plan_tasks(spark.createDataFrame([("app", "build"), ("lib2", "build")], "project string, target string"), has, rules, graph)
    assert sorted(map(tuple, tasks.collect())) == [("app", "build"), ("app", "prepare"), ("lib", "build")]
    assert sorted(map(tuple, links.select("project", "target", "on_project", "on_target").collect())) == [("app", "build", "app", "prepare"), ("app", "build", "lib", "build"), ("lib", "build", "app", "build")]


def test_audit_shares_are_of_tasks_that_went_beyond(spark):
    from graphloom.operators import findings

    rows = [(f"t{k}", "undeclared-read", "src/a.ts") for k in range(3)] + [("t3", "stray-write", ".git/index")]
    rows += [(f"q{k}", kind, detail) for k, (kind, detail) in enumerate([("unkeyed-read", ".git/HEAD"), ("unkeyed-package", "p"), ("hoisted-package", "q")] * 4)]
    found = findings.audit_summary(spark.createDataFrame(rows, "task string, kind string, detail string"))
    wanted = [("shared hoisted-package", "q", 4), ("shared undeclared-read", "src/a.ts", 3), ("shared unkeyed-package", "p", 4), ("stray-write", None, 1), ("unkeyed-read", None, 4)]
    assert sorted((r.kind, r.detail, r.tasks) for r in found.collect()) == wanted


def test_waits_for_slots_and_load_while_tasks_wait(spark):
    from graphloom.operators import history

    records = spark.createDataFrame([(1, "a", 0, 100, 0), (1, "b", 150, 300, 20), (1, "c", 400, 500, None), (1, "d", 50, 60, 0)], "run long, task string, started long, ended long, memory_wait long")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("c", "gone")], "src string, dst string")
    waits = history.slot_waits(records, edges)
    assert sorted(tuple(r) for r in waits.select("task", "ready", "wait").collect()) == [("a", 0, 0), ("b", 100, 30), ("c", 300, 100), ("d", 0, 50)]
    samples = spark.createDataFrame([(1, t, 0.5) for t in (0, 49, 50, 99, 100, 150, 299, 300, 399, 400)] + [(2, 7, 1.0)], "run long, at long, load double")
    for width in (1, 64, 1000):
        marked = history.load_while_waiting(samples, waits, width).collect()
        assert sorted(r["at"] for r in marked if r.waiting) == [0, 49, 100, 300, 399] and len(marked) == 11


def test_environment_of_a_task(spark):
    variables = F.create_map(*(F.lit(x) for x in ("A_1", "1", "B", "2", "Q.E", "3", "PATH", "/bin", "C", "4")))
    names = lambda *x: F.array(*map(F.lit, x))
    see = lambda *columns: spark.range(1).select(formats.task_environment(variables, *columns).alias("e")).first().e
    found = see(names("A_*", "B"), names("*.E"), F.create_map(F.lit("B"), F.lit("set"), F.lit("NEW"), F.lit("x")))
    assert found.environment == {"A_1": "1", "B": "set", "NEW": "x", "Q.E": "3"} and found.keyed == {"A_1": "1"} and found.left_out == ["C", "PATH"] and found.errors == []
    none = F.lit(None)
    clash = see(names("*"), names("B", "qxe"), none.cast("map<string,string>"), F.create_map(F.lit("PATH"), F.lit("/made")))
    assert clash.errors == ["both:B", "path:PATH"] and clash.environment["PATH"] == "/made"
    empty = see(none.cast("array<string>"), none.cast("array<string>"), none.cast("map<string,string>"))
    assert empty.environment == {} and len(empty.left_out) == 5


def test_pinned_blobs_stay_and_failed_projections_keep_all(spark):
    entries = spark.createDataFrame([(1, 1, 10), (2, 2, 10)], "entry long, used long, size long")
    cites, blobs = spark.createDataFrame([(1, 7), (2, 8)], "entry long, blob long"), spark.createDataFrame([(7, 100), (8, 100)], "blob long, size long")
    gone = lambda pins: sorted((r.entry, r.freed) for r in storage.evictions(entries, cites, blobs, 10_000, 9, pins).collect())
    assert gone(None) == [(1, 110), (2, 110)] and gone(spark.createDataFrame([(8,), (8,), (99,)], "blob long")) == [(1, 110), (2, 10)]
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    artifacts, failed = spark.createDataFrame([("made", "1", "2"), ("same", "1", "1")], "path string, before string, after string"), spark.createDataFrame([("r", "no output")], "rule string, why string")
    left = lambda rows: sorted(r.path for r in locate.substituted(paths, paths.where("path = 'a'"), artifacts, rows).collect())
    assert left(None) == left(failed.limit(0)) == ["b", "made"] and left(failed) == ["a", "b"]


def test_gaps_in_imports_keep_what_they_may_hide(spark):
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("g", "h"), ("h", "g")], "file string, imported string")
    ids = lambda *names: spark.createDataFrame([(x,) for x in names], "id string")
    lost = spark.createDataFrame([("b", "./z"), ("e", "./y"), ("e", "./x"), ("f", "./w")], "file string, specifier string")
    answers = tasks.import_answers(ids("a", "d", "g", "e"), ids("c", "nowhere"), imports, lost)
    assert {r.id: (r.chain, r.gap, r.specifier) for r in answers.collect()} == {"a": (["c", "b", "a"], None, None), "d": (None, ["e", "d"], "./x"), "e": (None, ["e"], "./x")}
    causes = spark.createDataFrame([(1, None, False), (2, None, False), (3, None, False), (4, None, True), (5, "p", False), (6, None, True), (7, None, True)], "task long, via string, by_cases boolean")
    of = lambda *rows: spark.createDataFrame(rows, "task long, file string")
    found = tasks.decided_by_imports(causes, spark.createDataFrame([(7, "settings", False), (4, "file", True)], "task long, reason string, carried boolean"), of((1, "a"), (2, "d"), (2, "g"), (3, "g")), of((4, "a"), (4, "g"), (4, "e"), (7, "a")), answers)
    assert {r.task: (r.decision, r.detail) for r in found.collect()} == {
        1: ("whole", "anchor:a"), 2: ("whole", "gap:d:./x"), 3: ("left-out", None), 4: ("cases", "2 of 3"), 5: ("whole", "task:p"), 6: ("whole", "nothing:cases"), 7: ("whole", "reason:settings"),
    }
