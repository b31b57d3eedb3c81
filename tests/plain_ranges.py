"""Version ranges judged one by one in plain Python, to hold graphloom.functions.semver against."""

from __future__ import annotations

import re

_VERSION = re.compile(r"^[v=\s]*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")
_PARTIAL = re.compile(r"^([<>]=?|=|\^|~>?)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*])(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)?$")
_LAST = ((2, 0, ""),)


def _pre(text: str | None) -> tuple:
    """Sorts before release (which is _LAST); numbers before words."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in text.split(".")) if text else _LAST


def parse(version: str | None) -> tuple | None:
    m = _VERSION.match(version.strip()) if version is not None else None
    return (int(m[1]), int(m[2]), int(m[3]), _pre(m[4])) if m else None


def _bounds(part: str) -> list[tuple[str, tuple]] | None:
    """Comparators (operator, version) that a single range word stands for; None if it is invalid."""
    m = _PARTIAL.match(part)
    if not m:
        return [] if part in ("", "*", "x", "X") else None
    operator, *numbers = m[1] or "", m[2], m[3], m[4]
    known = []
    for x in numbers:
        if x is None or not x.isdigit():
            break
        known.append(int(x))
    low = (*known, *[0] * (3 - len(known)))
    pre = _pre(m[5]) if len(known) == 3 else _LAST
    start = (*low, pre if m[5] and len(known) == 3 else _LAST)
    first = (*low, ())  # before every prerelease
    after = lambda k: (*low[: k - 1], low[k - 1] + 1, *[0] * (3 - k), ())
    if operator in ("", "="):
        return [("=", start)] if len(known) == 3 else [(">=", first), ("<", after(len(known)))] if known else []
    if operator in ("~", "~>"):
        return [(">=", start if len(known) == 3 else first), ("<", after(min(2, len(known))))] if known else []
    if operator == "^":
        if not known:
            return []
        place = next((k for k in range(len(known)) if known[k]), len(known) - 1)
        return [(">=", start if len(known) == 3 else first), ("<", after(place + 1))]
    if not known:
        return [] if operator in (">=", "<=") else [("<", (0, 0, 0, ()))]
    if len(known) == 3:
        return [(operator, start)]
    return {">": [(">=", after(len(known)))], ">=": [(">=", first)], "<": [("<", first)], "<=": [("<", after(len(known)))]}[operator]


def satisfies(version: str | None, wanted: str | None) -> bool:
    """Whether a version is within a range."""
    found = parse(version)
    if found is None or wanted is None:
        return False
    for choice in wanted.split("||"):
        text = choice.strip()
        hyphen = re.match(r"^(\S+)\s+-\s+(\S+)$", text)
        words = [f">={hyphen[1]}", f"<={hyphen[2]}"] if hyphen else re.sub(r"([<>]=?|=|\^|~>?)\s+", r"\1", text).split()
        bounds = [_bounds(word) for word in words]
        if any(b is None for b in bounds):
            continue
        if all(_holds(found, operator, limit) for b in bounds for operator, limit in b):
            return True
    return False


def _holds(found: tuple, operator: str, limit: tuple) -> bool:
    return {"=": found == limit, ">": found > limit, ">=": found >= limit, "<": found < limit, "<=": found <= limit}[operator]
