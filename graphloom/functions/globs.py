"""Globs as Java regular expressions, with the literal prefix that a scan can push down.

'*' and '?' stay within a segment, '**' as a whole segment spans any number of them (at least one at the
end), '[...]' is a class and '{a,b}' alternatives. A leading '!' is the caller's affair.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"[*?\[{]")


def braces(glob: str) -> list[str]:
    """The glob's alternatives, nested braces included."""
    begin = glob.find("{")
    if begin < 0:
        return [glob]
    level, cuts = 0, [begin]
    for at in range(begin, len(glob)):
        level += {"{": 1, "}": -1}.get(glob[at], 0)
        if level == 1 and glob[at] == ",":
            cuts.append(at)
        if level == 0:
            cuts.append(at)
            choices = [glob[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
            return [whole for choice in choices for whole in braces(glob[:begin] + choice + glob[at + 1 :])]
    return [glob]


def to_regex(glob: str, dot: bool = True) -> str:
    """An anchored regular expression; without dot, wildcards match no name that begins with one."""
    return "^(?:" + "|".join(_one(x, dot) for x in braces(glob)) + ")$"


def _one(glob: str, dot: bool) -> str:
    hidden = "" if dot else r"(?!\.)"
    segments, out = glob.split("/"), ""
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out += f"(?:{hidden}[^/]+/)*{hidden}[^/]+" if last else f"(?:{hidden}[^/]+/)*"
            continue
        out += hidden if segment[:1] in ("*", "?", "[") else ""
        out += _segment(segment) + ("" if last else "/")
    return out


def _segment(text: str) -> str:
    out, at = "", 0
    while at < len(text):
        char = text[at]
        if char == "*":
            out += "[^/]*"
        elif char == "?":
            out += "[^/]"
        elif char == "[" and (end := text.find("]", at + 2)) > 0:
            inner = text[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            at = end
        else:
            out += "\\" + char if not char.isalnum() and char != "_" else char
        at += 1
    return out


def literal_prefix(glob: str) -> str:
    """What every match begins with."""
    m = _SPECIAL.search(glob)
    return glob[: m.start()] if m else glob


def matches(column: str | Column, glob: str, dot: bool = True) -> Column:
    """Whether a path matches; the literal prefix stands as a startswith, which reaches a Parquet scan."""
    path = F.col(column) if isinstance(column, str) else column
    prefix = literal_prefix(glob)
    found = path.rlike(to_regex(glob, dot))
    return path.startswith(prefix) & found if prefix else found


_GROUP = {"@": "", "+": "+", "*": "*", "?": "?"}


def extended_regex(glob: str) -> str:
    """An anchored regular expression of the dialect of outputs and filesets: as to_regex, and '\\' escapes, '@(a|b)', '+(...)', '*(...)', '?(...)' and '!(...)' groups."""
    return "^(?:" + "|".join(_extended(x) for x in braces(glob)) + ")$"


def _extended(glob: str) -> str:
    segments, out = _outer_split(glob, "/"), ""
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out += "(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*"
        else:
            out += _extended_segment(segment) + ("" if last else "/")
    return out


def _outer_split(text: str, mark: str) -> list[str]:
    """text cut at marks outside groups, classes and escapes."""
    parts, level, at = [""], 0, 0
    while at < len(text):
        char = text[at]
        if char == "\\" and at + 1 < len(text):
            parts[-1] += text[at : at + 2]
            at += 2
            continue
        level += (char == "(") - (char == ")")
        if char == mark and level <= 0:
            parts.append("")
        else:
            parts[-1] += char
        at += 1
    return parts


def _extended_segment(text: str) -> str:
    out, at = "", 0
    while at < len(text):
        char = text[at]
        if char == "\\" and at + 1 < len(text):
            out, at = out + re.escape(text[at + 1]), at + 2
            continue
        if text[at + 1 : at + 2] == "(" and char in "@+*?!" and (end := _closing(text, at + 1)) > 0:
            inner = "|".join(_extended(x) for x in _outer_split(text[at + 2 : end], "|"))
            rest = _extended_segment(text[end + 1 :])
            if char == "!":
                return out + f"(?!(?:{inner}){rest}(?:/|$))[^/]*{rest}"
            return out + f"(?:{inner}){_GROUP[char]}" + rest
        if char == "[" and (end := text.find("]", at + 2)) > 0:
            out, at = out + _segment(text[at : end + 1]), end + 1
            continue
        out, at = out + _segment(char), at + 1
    return out


def _closing(text: str, at: int) -> int:
    """The ')' of the '(' at a place, or -1."""
    level = 0
    for k in range(at, len(text)):
        level += (text[k] == "(") - (text[k] == ")")
        if level == 0:
            return k
    return -1


def literal_folder(glob: str) -> str:
    """The folders, or the whole path, that a glob starts with before any pattern, escapes read; '.' for none."""
    names = []
    for segment in _outer_split(glob, "/"):
        if re.search(r"(?<!\\)[*?\[{(!]|(?<!\\)[@+]\(", segment):
            break
        names.append(re.sub(r"\\(.)", r"\1", segment))
    return "/".join(names) or "."
