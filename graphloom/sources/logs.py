"""Decoders of text lines: system-call traces, key listings and dotenv files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CALL = r'^\s*(?:(\d+)\s+)?(\w+)\((?:AT_FDCWD, |\d+, )?"((?:[^"\\]|\\.)*)"([^)]*)\)\s*=\s*(-?\d+)(?:\s+([A-Z]+))?'
_VARIABLE = re.compile(r"""^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*=\s*(?:'([^']*)'|"((?:[^"\\]|\\.)*)"|([^#\n]*?))\s*(?:#.*)?$""", re.M)


def trace_accesses(lines: DataFrame) -> DataFrame:
    """seq, process, path, operation, result of lines(seq, value) that are calls on a path; other lines are left out."""
    part = lambda n: F.regexp_extract("value", _CALL, n)
    call, flags = part(2), part(4)
    write = call.isin("unlink", "unlinkat", "rename", "mkdir", "creat") | (call.isin("open", "openat") & flags.rlike("O_WRONLY|O_RDWR|O_CREAT|O_TRUNC"))
    listing = call.isin("open", "openat") & flags.contains("O_DIRECTORY")
    operation = F.when(write, "write").when(listing, "list").when(call.isin("open", "openat", "execve", "readlink"), "read").otherwise("metadata")
    result = F.when(part(6) == "ENOENT", "missing").when(part(5).startswith("-"), "failed").otherwise("ok")
    return lines.where(F.col("value").rlike(_CALL)).select("seq", F.expr("nullif(regexp_extract(value, '^ *([0-9]+) ', 1), '')").cast("int").alias("process"), part(3).alias("path"), operation.alias("operation"), result.alias("result"))


def listed_keys(lines: DataFrame) -> DataFrame:
    """key, time: the latest time of each key of lines(value) of the form '<16 or more hex digits> <milliseconds>'; other lines are left out."""
    shape = r"^([0-9a-f]{16,}) (\d+)$"
    part = lambda n: F.regexp_extract("value", shape, n)
    return lines.where(F.col("value").rlike(shape)).select(part(1).alias("key"), part(2).cast("long").alias("time")).groupBy("key").agg(F.max("time").alias("time"))


def dotenv(text: str, known: dict[str, str] | None = None) -> dict[str, str]:
    """Variables of a dotenv text; $NAME and ${NAME} are expanded from earlier ones and known, not within single quotes."""
    out: dict[str, str] = {}
    for m in _VARIABLE.finditer(text):
        if m[2] is not None:
            out[m[1]] = m[2]
            continue
        value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[3]) if m[3] is not None else m[4]
        out[m[1]] = re.sub(r"\$\{?([A-Za-z_]\w*)\}?", lambda v: out.get(v[1], (known or {}).get(v[1], "")), value)
    return out


def dotenv_pairs(text: str):
    """A column of dotenv texts as arrays of name and value, in order."""
    @F.pandas_udf("array<struct<name:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": k, "value": v} for k, v in dotenv(t or "").items()])

    return run(text)
