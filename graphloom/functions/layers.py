"""Layers of target definitions merged over one another, in which the order of keys counts: what stands before a "..." key yields to
the layer below, what stands after it wins. Column functions take and give JSON texts that keep their order."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark of what is below, and the executors that run a command or a script.
SPREAD, COMMANDS, SCRIPT = "...", "nx:run-commands", "nx:run-script"


def overlaid(base: object, new: object) -> object:
    """new over base: it replaces base, but an array's "..." item and an object's "...": true stand for what base holds."""
    if isinstance(new, list) and SPREAD in new:
        below = base if isinstance(base, list) else []
        return [x for item in new for x in (below if item == SPREAD else [item])]
    if isinstance(new, dict) and new.get(SPREAD) is True:
        out: dict = {}
        for key, value in new.items():
            out.update({key: value} if key != SPREAD else base if isinstance(base, dict) else {})
        return out
    return new


def _by_key(base: object, new: object) -> dict:
    """Objects merged key by key."""
    base, new = (x if isinstance(x, dict) else {} for x in (base, new))
    if new.get(SPREAD) is True:
        return overlaid(base, new)
    return base | {key: overlaid(base.get(key), value) for key, value in new.items()}


def _named(base: object, new: object) -> dict:
    """Configurations merged by name, each key by key; names before a "..." key are the base's if it has them."""
    base, new = (x if isinstance(x, dict) else {} for x in (base, new))
    names = list(new)
    early = set(names[: names.index(SPREAD)]) if SPREAD in new else set()
    return {name: base[name] if name in early and name in base else _by_key(base.get(name), new.get(name)) for name in dict.fromkeys([*base, *new]) if name != SPREAD}


def _runs(target: dict) -> object:
    """What a target runs besides its executor, if that tells targets apart."""
    options = target.get("options") if isinstance(target.get("options"), dict) else {}
    if target.get("executor") == COMMANDS:
        return options.get("command") or options.get("commands") or target.get("command")
    return options.get("script") if target.get("executor") == SCRIPT else None


def compatible(one: dict, other: dict) -> bool:
    """Whether two layers of a target go together: one has no executor, or both have the same and none runs another command or script."""
    if not one.get("executor") or not other.get("executor"):
        return True
    if one["executor"] != other["executor"]:
        return False
    return not _runs(one) or not _runs(other) or _runs(one) == _runs(other)


def plain(target: dict) -> dict:
    """A target whose command shorthand is spelled out."""
    if not target.get("command"):
        return target
    options = target["options"] if isinstance(target.get("options"), dict) else {}
    rest = {k: v for k, v in target.items() if k not in ("command", "options")}
    return {"executor": COMMANDS} | rest | {"options": options | {"command": target["command"]}}


def merged(base: dict | None, new: dict) -> dict:
    """A target's layer over the layers so far; a base it isn't compatible with is dropped."""
    base = base if base and compatible(base, new) else {}
    names = list(new)
    early = set(names[: names.index(SPREAD)]) if SPREAD in new else set()
    out = {}
    for key in dict.fromkeys([*base, *new]):
        if key == "options":
            out[key] = _by_key(base.get(key), new.get(key))
        elif key == "configurations":
            out[key] = _named(base.get(key), new.get(key))
        elif key != SPREAD:
            out[key] = base[key] if key in base and (key in early or key not in new) else overlaid(base.get(key), new.get(key))
    return out


def default_for(entry: dict, target: dict) -> dict | None:
    """A default as the layer beneath target: it takes the target's executor, and the command that this runs; None if it is for another executor."""
    entry = plain({k: v for k, v in entry.items() if k != "filter"})
    executor = target.get("executor")
    if executor and entry.get("executor") and entry["executor"] != executor:
        return None
    out = dict(entry)
    if executor:
        out["executor"] = executor
    own = {k: v for k, v in (target.get("options") or {}).items() if k in ("command", "commands")} if executor == COMMANDS else {}
    if own:
        out["options"] = {k: v for k, v in (out.get("options") or {}).items() if k not in ("command", "commands")} | own
    return out


def resolved(layers: list[dict], defaults: list[dict]) -> dict:
    """A target of its files' layers, lowest first, over the defaults chosen for it; a layer that runs something else than those before it starts from the defaults anew."""
    layers = [plain(x) for x in layers]
    staged = reduce(merged, layers, {})
    beneath = reduce(merged, [d for d in (default_for(x, staged) for x in defaults) if d is not None], {})
    found = beneath
    for layer in layers:
        found = merged(found if compatible(found, layer) else beneath, layer)
    return found


def _texts(function, *columns: Column) -> Column:
    """A column of JSON texts from columns of arrays of JSON texts, in Arrow batches."""

    @F.pandas_udf("string")
    def run(*parts: pd.Series) -> pd.Series:
        parse = lambda texts: [plain(json.loads(t)) for t in (texts if texts is not None else []) if t is not None]
        return pd.Series([json.dumps(function(*map(parse, row)), ensure_ascii=False) for row in zip(*parts, strict=True)], dtype=object)

    return run(*columns)


def staged_text(layers: Column) -> Column:
    """The layers of an array, lowest first, as one target."""
    return _texts(lambda found: reduce(merged, found, {}), layers)


def resolved_text(layers: Column, defaults: Column) -> Column:
    """As resolved, of columns; no defaults may be null."""
    return _texts(resolved, layers, defaults)
