"""Traces against a plain reading, one call after another, and calls of every form by hand."""

from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from graphloom.sources import traces

LINES = "process long, seq long, value string"


@pytest.mark.parametrize(
    ("call", "known", "result", "found"),
    [
        ('openat(AT_FDCWD</w>, "a/b", O_RDONLY|O_CLOEXEC) = 3</w/a/b>', True, "success", [("read", "/w/a/b", "/w/a/b")]),
        ('openat(7</fd/k>, "x", O_RDWR|O_CREAT, 0644) = 4', True, "success", [("read", "/fd/k/x", None), ("write", "/fd/k/x", None)]),
        ('openat(7<pipe:[9]>, "x", O_RDONLY) = 4', False, "success", []),
        ('open("d", O_RDONLY|O_PATH) = 3', True, "success", [("metadata", "d", None)]),
        ('creat("d", 0644) = -1 EACCES (Permission denied)', True, "EACCES", [("write", "d", None)]),
        ('stat("x\\303\\251\\n\\"", {st_mode=S_IFREG|0644, st_size=1, ...}) = -1 ENOENT (No such file)', True, "missing", [("metadata", 'xé\n"', None)]),
        ('open("cut"..., O_RDONLY) = 3', False, "success", []),
        ('open("\\377", O_RDONLY) = 3', False, "success", []),
        ('renameat2(AT_FDCWD, "a", 5</q>, "b,(c", 0) = 0', True, "success", [("delete", "a", None), ("rename", "/q/b,(c", None)]),
        ('linkat(3</s>, "a", 4</t>, "b", 0) = 0', True, "success", [("metadata", "/s/a", None), ("write", "/t/b", None)]),
        ("getdents64(3</d (deleted)>, 0x1 /* 3 entries */, 32768) = 80", True, "success", [("list", "/d", None)]),
        ("getdents64(3<socket:[1]>, 0x1, 32768) = 80", False, "success", []),
        ('newfstatat(3</e>, "", {st_mode=S_IFREG}, AT_EMPTY_PATH) = 0', True, "success", [("metadata", "/e", None)]),
        ("newfstatat(3</e>, NULL, {st_mode=S_IFREG}, AT_EMPTY_PATH) = 0", True, "success", [("metadata", "/e", None)]),
        ('newfstatat(3<pipe:[1]>, "", {st_mode=S_IFIFO}, AT_EMPTY_PATH) = 0', True, "success", []),
        ("statx(AT_FDCWD, NULL, 0, 0, NULL) = -1 EFAULT (Bad address)", True, "EFAULT", []),
        ("utimensat(3</u>, NULL, [UTIME_NOW], 0) = 0", True, "success", [("write", "/u", None)]),
        ('stat("x", 0x1) = ?', True, None, []),
        ('rename("a", "b") = ?', True, "unknown", [("delete", "a", None), ("rename", "b", None)]),
        ('execve("/bin/ls", ["ls", "-l"], 0x7 /* 3 vars */) = 0', True, "success", []),
        ("exit_group(0) = ?", True, None, []),
        ("kill(7, SIGTERM", True, None, []),
        ("strange(1) = 0", False, "success", []),
        ("no call at all", False, None, []),
    ],
)
def test_calls(call, known, result, found):
    name, *told = traces.decoded(call)
    assert told[:3] == [known, result, found] and name == call.split("(")[0]


def test_torn_calls_and_odd_lines(spark):
    rows = [
        (1, 1, '1.0 open("a", <unfinished ...>'), (1, 2, '2.0 <... open resumed>O_RDONLY) = 3'), (1, 3, "3.0 <... open resumed>) = 3"), (1, 4, "4.0 --- SIGCHLD ---"), (1, 5, "x stat(1) = 0"), (1, 6, "short"), (1, 7, None),
        (2, 1, '1.5 stat("b" <unfinished ...>'), (2, 2, '1.6 stat("c" <unfinished ...>'), (2, 3, "1.7 <... stat resumed>, 0x1) = 0"), (2, 4, '1.8 stat("d" <unfinished ...>'), (3, 1, "5.0 <... read resumed"), (3, 2, "6.0 +++ exited with 0 +++"),
    ]
    found = traces.calls(spark.createDataFrame(rows, LINES))
    assert sorted(((r.process, r.seq, r.time, r.call, r.problem) for r in found.collect()), key=repr) == sorted(
        [(1, 2, 1.0, 'open("a", O_RDONLY) = 3', None), (1, 3, 3.0, None, "unmatched"), (1, 5, None, "stat(1) = 0", "bad-time"), (2, 3, 1.6, 'stat("c" , 0x1) = 0', None), (2, 4, 1.8, 'stat("d" <unfinished ...>', "unfinished"), (3, 1, 5.0, None, "unmatched")],
        key=repr,
    )
    told = traces.diagnostics(found, traces.decode(found)).collect()
    assert sorted(((r.problem, r.detail, r.n) for r in told), key=repr) == [("bad-time", None, 1), ("unfinished", None, 1), ("unmatched", "1", 1), ("unmatched", "3", 1)]


def test_paths_of_many_processes_are_as_a_plain_reading_finds(spark):
    draw = random.Random(5)
    pick = draw.choice
    rows, clock = [], 0.0
    for n in range(1500):
        clock += pick([0.0, 0.001, 0.4])
        process = pick([1, 1, 1, 2, 3, 4, 5])  # one has near half of all calls
        call = pick([
            f'chdir("{pick(["x", "..", "../../..", "y/./z", "/abs", "/", "a/"])}") = {pick(["0", "0", "-1 ENOENT (No such file)"])}', "fchdir(3</held/by>) = 0", 'getcwd("/told", 4096) = 6', f"clone(flags=SIGCHLD) = {pick([2, 3, 4, 5, 6])}",
            'stat("f", 0x1) = 0', 'openat(AT_FDCWD, "../g/", O_RDONLY) = 3', 'unlink("/w/../h") = 0', 'openat(4</fd>, "../i", O_WRONLY) = 5',
        ])
        rows.append((process, n, f"{clock:.3f} {call}"))
    known = traces.decode(traces.calls(spark.createDataFrame(rows, LINES)))
    found = {(r.process, r.seq): (r.path, r.operation) for r in traces.accesses(known, "/start/at").collect()}
    here, wanted = {}, {}
    norm = lambda *p: "/" + posixpath.normpath(posixpath.join(*p)).lstrip("/")
    for process, n, value in sorted(rows, key=lambda r: (float(r[2].split()[0]), r[0], r[1])):
        at = here.setdefault(process, "/start/at")
        call = value.split(" ", 1)[1]
        if call.startswith("chdir") and call.endswith("= 0"):
            here[process] = norm(at, call.split('"')[1])
        elif call.startswith(("fchdir", "getcwd")):
            here[process] = "/held/by" if call.startswith("f") else "/told"
        elif call.startswith("clone"):
            here[int(call.split()[-1])] = at
        elif not call.startswith("chdir"):
            base, operation = {"s": (at, "metadata"), "A": (at, "read"), "u": (at, "delete"), "4": ("/fd", "write")}["s" if call[0] == "s" else "u" if call[0] == "u" else call[7]]
            wanted[process, n] = (norm(base, call.split('"')[1]), operation)
    assert found == wanted


def test_no_lines_give_no_accesses(spark):
    known = traces.decode(traces.calls(spark.createDataFrame([], LINES)))
    assert traces.accesses(known, "/w").count() == 0 and traces.diagnostics(traces.calls(spark.createDataFrame([], LINES)), known).count() == 0


def test_a_long_chain_of_relative_folders_takes_few_rounds(spark):
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("process"), F.col("id").alias("seq"), F.concat(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ' chdir("in") = 0').otherwise(' chdir("..") = 0')).alias("value"))
    last = spark.createDataFrame([(1, 4000, '4000 stat("f", 0x1) = 0')], LINES)
    assert [r.path for r in traces.accesses(traces.decode(traces.calls(rows.unionByName(last))), "/w").collect()] == ["/w/f"]
