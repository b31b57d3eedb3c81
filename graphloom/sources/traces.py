"""System-call traces as accesses: calls torn by others put together, working folders carried along and inherited, paths relative
to folders and descriptors resolved, budgets kept, and what was not understood told.

lines(process, seq, value): the lines of each process's trace in order, '<seconds> <call>'. Null values and lines of other
shapes are left out. Python parses a call's arguments, one batch at a time; everything between calls is joins and orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import posix_join
from graphloom.operators.asof import last_before
from graphloom.operators.storage import ranked, sums_before
from graphloom.session import checkpointed, importable

# What calls do at which argument, 'operation path' or 'operation path@folder'.
_CALLS = {
    "access stat lstat stat64 lstat64 statfs statfs64 getxattr lgetxattr listxattr llistxattr": "metadata 0",
    "inotify_add_watch": "metadata 1",
    "newfstatat fstatat64 statx faccessat faccessat2 name_to_handle_at": "metadata 1@0",
    "readlink": "readlink 0",
    "readlinkat": "readlink 1@0",
    "unlink rmdir": "delete 0",
    "unlinkat": "delete 1@0",
    "rename": "delete 0, rename 1",
    "renameat renameat2": "delete 1@0, rename 3@2",
    "mkdir truncate chmod chown lchown utime utimes mknod setxattr lsetxattr removexattr lremovexattr": "write 0",
    "mkdirat fchmodat fchmodat2 fchownat utimensat mknodat futimesat": "write 1@0",
    "symlink": "write 1",
    "symlinkat": "write 2@1",
    "link": "metadata 0, write 1",
    "linkat": "metadata 1@0, write 3@2",
    "open creat": "open 0",
    "openat openat2": "open 1@0",
    "execve execveat wait4 waitid close dup dup2 dup3 pidfd_open": "",
}
#: Calls that may stay without a result: endings and signals.
_SILENT = frozenset("exit exit_group ??? kill tkill tgkill rt_sigqueueinfo rt_tgsigqueueinfo pidfd_send_signal".split())
#: Where calls that may take an empty path in place of their descriptor's hold their flags.
_EMPTY_FLAGS = {"newfstatat": 3, "fstatat64": 3, "faccessat2": 3, "statx": 2, "name_to_handle_at": 4, "faccessat": None}
_FORKS = ("clone", "clone3", "fork", "vfork")
_RULES = {name: [(op, *map(int, at.split("@"))) for op, at in (r.split() for r in rules.split(",") if r)] for names, rules in _CALLS.items() for name in names.split()}

_CALL = regex.compile(r"(?P<name>[^(]*)\((?P<arguments>.*)\)\s* = (?P<result>.*)", regex.S)
_ARGUMENT = regex.compile(r'(?:"(?:[^"\\]|\\.)*+"?|(?P<nest>[(\[{<](?:"(?:[^"\\]|\\.)*+"?|(?&nest)|[^"()\[\]{}<>])*+[)\]}>])|[^",])++|(?<=,)(?=,|$)', regex.S)
_ESCAPE = regex.compile(rb"\\(?:([0-7]{1,3})|(.))", regex.S)
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"\\": b"\\", b'"': b'"'}

DECODED = "name string, known boolean, result string, accesses array<struct<operation:string,path:string,resolved:string>>, folder string, child long"


class _Unknown(Exception):
    """A call whose arguments don't tell what it does."""


def _quoted(argument: str) -> str:
    m = regex.fullmatch(r'"((?:[^"\\]|\\.)*+)"[^.]*', argument, regex.S)
    if not m:
        raise _Unknown

    def plain(e) -> bytes:
        code = int(e[1], 8) if e[1] else None
        if code is None and e[2] not in _LETTERS or code is not None and code > 255:
            raise _Unknown
        return _LETTERS[e[2]] if code is None else bytes([code])

    try:
        return _ESCAPE.sub(plain, m[1].encode()).decode()
    except UnicodeDecodeError as error:
        raise _Unknown from error


def _descriptor(argument: str) -> str | None:
    """The file a descriptor stands for, '3</src>'."""
    m = regex.fullmatch(r"[^<]*<(/.*?)(?: \(deleted\))?>", argument, regex.S)
    return m[1] if m else None


def _place(arguments: list[str], at: int, folder: int | None = None) -> str:
    """The path at an argument: whole, or relative to the working folder."""
    path = _quoted(arguments[at])
    if folder is None or path.startswith("/"):
        return path
    base = _descriptor(arguments[folder])
    if base is None and not arguments[folder].startswith("AT_FDCWD"):
        raise _Unknown
    return f"{base}/{path}" if base else path


def _accesses(name: str, arguments: list[str], result: str, ok: bool) -> list[tuple[str, str, str | None]]:
    if name == "getdents64":
        listed = _descriptor(arguments[0])
        if listed is None:
            raise _Unknown
        return [("list", listed, None)]
    if name == "utimensat" and arguments[1] == "NULL" or name in _EMPTY_FLAGS and arguments[1] in ("NULL", '""'):
        held, flags = _descriptor(arguments[0]), _EMPTY_FLAGS.get(name)
        named = arguments[1] != "NULL" or name == "utimensat" or flags is not None and flags < len(arguments) and "AT_EMPTY_PATH" in arguments[flags]
        here = arguments[0].startswith("AT_FDCWD")
        if not named or held is None and "<" in arguments[0] and name != "utimensat":
            return []  # a probe of the call, or a descriptor of what is no file
        if held is None and (not here or name == "utimensat"):
            raise _Unknown
        return [("write" if name == "utimensat" else "metadata", held or "", None)]
    found = []
    for operation, at, *folder in _RULES[name]:
        path = _place(arguments, at, *folder)
        if operation != "open":
            found.append((operation, path, None))
            continue
        flags = "" if name == "creat" or at + 1 >= len(arguments) else arguments[at + 1]
        resolved = _descriptor(result) if ok else None
        if "O_PATH" in flags:
            found.append(("metadata", path, resolved))
        elif name != "creat" and "O_WRONLY" not in flags:
            found.append(("read", path, resolved))
        if name == "creat" or any(f in flags for f in ("O_WRONLY", "O_RDWR", "O_CREAT", "O_TRUNC")):
            found.append(("write", path, resolved))
    return found


def decoded(call: str) -> tuple:
    """A call as a row of DECODED: what it accesses, the folder it changes to and the process it makes; known is false where it can't be told."""
    name = call.split("(", 1)[0]
    if "(" in call and name in _SILENT:
        return name, True, None, [], None, None
    m = _CALL.fullmatch(call)
    if not m:
        return name, False, None, [], None, None
    result = m["result"]
    arguments = [a[0].strip() for a in _ARGUMENT.finditer(m["arguments"])] or [""]
    cut, failed = result.startswith("?"), result.startswith("-1")
    if cut and (name == "getdents64" or any(op in ("metadata", "readlink") for op, *_ in _RULES.get(name, [])) and name not in ("link", "linkat", "inotify_add_watch")):
        return name, True, None, [], None, None
    words = result.split()
    status = "missing" if failed and words[1:2] and words[1].startswith("ENOENT") else (words[1] if len(words) > 1 else "failed") if failed else "unknown" if cut else "success"
    ok = status == "success"
    try:
        folder, child, found = None, None, []
        if name in _FORKS:
            child = int(words[0]) if ok and words and words[0].isdigit() else None
        elif name in ("chdir", "getcwd"):
            folder = _quoted(arguments[0]) if ok else None
        elif name == "fchdir":
            folder = _descriptor(arguments[0]) if ok else None
            if ok and folder is None:
                raise _Unknown
        elif name in _RULES or name == "getdents64":
            found = _accesses(name, arguments, result, ok)
        else:
            raise _Unknown
    except (_Unknown, IndexError):
        return name, False, status, [], None, None
    return name, True, status, found, folder, child


def calls(lines: DataFrame) -> DataFrame:
    """process, seq, time, call, problem of lines: a call that another process's broke in two is one, from when it began.

    problem is null for calls, else bad-time, unmatched (an end without its beginning) or unfinished (a beginning that was last).
    """
    text = F.trim(F.regexp_replace("value", r"^\S* ", ""))
    time = F.expr("try_cast(split_part(value, ' ', 1) AS double)")
    timed = lines.where("instr(value, ' ') > 0").select("process", "seq", time.alias("time"), text.alias("call")).where("time IS NULL OR NOT rtrim(call) RLIKE '^(---|[+]{3})'")
    open_ = F.col("call").endswith("<unfinished ...>")
    kind = F.when(F.col("time").isNull(), "bad-time").when(open_, "open").when(F.col("call").startswith("<..."), "close").otherwise("whole")
    marked = timed.withColumn("kind", kind)
    torn = marked.where("kind IN ('open', 'close')").withColumn("part", F.struct("kind", "time", "call")).withColumn("block", F.floor(F.col("seq") / 4096))
    backward = torn.withColumn("block", -F.col("block")).withColumn("order", -F.col("seq"))
    ends = last_before(torn, ["process"], "block", ["seq"], "part")
    begun, suffix = F.regexp_replace("last.call", r"<unfinished \.\.\.>$", ""), F.regexp_extract("call", r"(?s)^.*?resumed>(.*)$", 1)
    matched = (F.col("last.kind") == "open") & F.col("call").contains("resumed>")
    joined = ends.where("kind = 'close'").select("process", "seq", F.when(matched, F.col("last.time")).otherwise(F.col("time")).alias("time"), F.when(matched, F.concat(begun, suffix)).alias("call"), F.when(~F.coalesce(matched, F.lit(False)), "unmatched").alias("problem"))
    last = last_before(backward, ["process"], "block", ["order"], "part").where("kind = 'open' AND last IS NULL").select("process", "seq", "time", "call", F.lit("unfinished").alias("problem"))
    whole = marked.where("kind IN ('whole', 'bad-time')").select("process", "seq", "time", "call", F.when(F.col("kind") == "bad-time", "bad-time").alias("problem"))
    return whole.unionByName(joined).unionByName(last)


def within_budget(found: DataFrame, records: int = 200_000, size: int = 32 * 1024 * 1024) -> DataFrame:
    """The calls with over: true from the first on that the budget doesn't hold, by process as text and seq: records calls, or their bytes beyond size."""
    placed = ranked(found.where("problem IS NULL").withColumn("_p", F.col("process").cast("string")), "_p", "seq").withColumn("_size", F.octet_length("call"))
    return sums_before(placed, "rank", "_size").withColumn("over", (F.col("rank") > records) | (F.col("before") > size)).select(*found.columns, "over")


def decode(found: DataFrame) -> DataFrame:
    """process, seq, time, call and DECODED of calls."""
    importable(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DECODED.split(", ")]
        for batch in batches:
            rows = [decoded(call) for call in batch["call"]]
            out = pd.DataFrame(rows, columns=names)
            out["accesses"] = [[{"operation": o, "path": p, "resolved": r} for o, p, r in found] for found in out["accesses"]]
            out["child"] = out["child"].astype("Int64")
            yield pd.concat([batch.reset_index(drop=True), out], axis=1)

    return found.where("problem IS NULL").select("process", "seq", "time", "call").mapInPandas(run, "process long, seq long, time double, call string, " + DECODED)


def _reduced(path: Column) -> Column:
    """Without '.', '..' and doubled slashes, as far as they can be told; a leading '/' stays and is left by no '..'."""
    inner = posix_join(F.lit(""), F.regexp_replace(path, "/+$", ""))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.regexp_replace(inner, r"^(\.\.(/|$))+|^\.$", ""))).otherwise(inner)


def _under(base: Column, path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))


def folders(known: DataFrame, width: float = 1.0) -> DataFrame:
    """process, seq, base of decoded calls: the working folder each began in, relative to the first one's if nothing whole is known.

    A call that changes its folder, or a process made, is a state of its process that points to the state before it: its own
    earlier one, or its maker's at that time. Pointers double in length each round, so a chain of n relative changes takes
    log n rounds. A state is looked up among a process's states of a range of width seconds, or its last one before.
    """
    order = ["time", "by", "seq"]
    base = known.select(F.col("process").alias("owner"), "time", F.col("process").alias("by"), "seq", F.when(F.col("folder").isNotNull(), F.struct("process", "seq")).alias("state"))
    made = known.where("child IS NOT NULL").select(F.col("child").alias("owner"), "time", F.col("process").alias("by"), "seq", F.struct("process", "seq").alias("state"))
    rows = base.unionByName(made).withColumn("block", F.floor(F.col("time") / width))
    own = checkpointed(last_before(rows, ["owner"], "block", order, "state").where("owner = by").select(F.col("owner").alias("process"), "seq", F.col("last").alias("up")))
    moved = known.where("folder IS NOT NULL OR child IS NOT NULL").select("process", "seq", F.coalesce("folder", F.lit("")).alias("part"))
    states = moved.join(own, ["process", "seq"])
    whole = F.col("part").startswith("/")
    states = checkpointed(states.select(F.struct("process", "seq").alias("id"), F.when(~whole, F.col("up")).alias("up"), _reduced(F.col("part")).alias("part")))
    while states.where("up IS NOT NULL").limit(1).count():
        above = states.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("part").alias("_part"))
        states = checkpointed(states.join(above, "up", "left").select("id", F.col("_up").alias("up"), F.when(F.col("_part").isNull(), F.col("part")).otherwise(_reduced(_under(F.col("_part"), F.col("part")))).alias("part")))
    return own.join(states.select(F.col("id").alias("up"), "part"), "up", "left").select("process", "seq", F.coalesce("part", F.lit(".")).alias("base"))


def accesses(known: DataFrame, cwd: str) -> DataFrame:
    """process, seq, place, time, path, resolved, operation, result of decoded calls, paths whole; the first working folder is cwd. Order by time, process, seq, place."""
    seen = known.where("size(accesses) > 0").select("process", "seq", "time", "result", F.posexplode("accesses").alias("place", "a"))
    whole = F.col("a.path").startswith("/")
    path = _reduced(_under(F.coalesce(_under(F.lit(cwd), F.col("base")), F.lit(cwd)), F.col("a.path")))
    based = seen.where(~whole).join(folders(known), ["process", "seq"], "left").unionByName(seen.where(whole).withColumn("base", F.lit(None).cast("string")))
    return based.select("process", "seq", "place", "time", path.alias("path"), F.col("a.resolved").alias("resolved"), F.col("a.operation").alias("operation"), "result")


def diagnostics(found: DataFrame, known: DataFrame) -> DataFrame:
    """problem, detail, n: lines and calls that were not understood: bad-time and unfinished, unmatched by process, undecoded by name."""
    torn = found.where("problem IS NOT NULL").groupBy("problem", F.when(F.col("problem") == "unmatched", F.col("process").cast("string")).alias("detail")).agg(F.count("*").alias("n"))
    return torn.unionByName(known.where("NOT known").groupBy(F.lit("undecoded").alias("problem"), F.col("name").alias("detail")).agg(F.count("*").alias("n")))
