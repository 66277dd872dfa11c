"""Differences of nested JSON values, and their application."""

from __future__ import annotations

from typing import Any


def deep_equal(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) else a == b


def _key(v: Any) -> str:
    import json

    return json.dumps(v, sort_keys=True)


def calculate_delta(before: Any, after: Any, path: tuple[str, ...] = ()) -> list[dict]:
    """Changes by path: set, remove; of arrays the elements added and removed, or a reorder."""
    if deep_equal(before, after):
        return []
    if isinstance(before, dict) and isinstance(after, dict):
        out = []
        for k in sorted({*before, *after}):
            here = (*path, k)
            if k not in after:
                out.append({"op": "remove", "path": here, "value": None})
            elif k not in before:
                out.append({"op": "set", "path": here, "value": after[k]})
            else:
                out += calculate_delta(before[k], after[k], here)
        return out
    if isinstance(before, list) and isinstance(after, list):
        was, now = [_key(v) for v in before], [_key(v) for v in after]
        if sorted(was) == sorted(now):
            return [{"op": "reorder", "path": path, "value": after}]
        left, gone = list(was), []
        added = []
        for v, k in zip(after, now, strict=True):
            if k in left:
                left.remove(k)
            else:
                added.append(v)
        rest = list(now)
        for v, k in zip(before, was, strict=True):
            if k in rest:
                rest.remove(k)
            else:
                gone.append(v)
        return [{"op": "array", "path": path, "value": {"added": added, "removed": gone, "result": after}}]
    return [{"op": "set", "path": path, "value": after}]


def apply_delta(value: Any, delta: list[dict]) -> Any:
    import copy

    out = copy.deepcopy(value)
    for change in delta:
        new = change["value"]["result"] if change["op"] == "array" else change["value"]
        if not change["path"]:
            out = new
            continue
        at = out
        for part in change["path"][:-1]:
            at = at.setdefault(part, {})
        if change["op"] == "remove":
            at.pop(change["path"][-1], None)
        else:
            at[change["path"][-1]] = new
    return out


def paths_conflict(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Equal, or one above the other."""
    n = min(len(a), len(b))
    return tuple(a[:n]) == tuple(b[:n])


def conflicting_paths(a: list[dict], b: list[dict]) -> list[tuple[str, ...]]:
    return sorted({tuple(x["path"]) for x in a for y in b if paths_conflict(tuple(x["path"]), tuple(y["path"]))})


def deltas_conflict(a: list[dict], b: list[dict]) -> bool:
    return bool(conflicting_paths(a, b))


def merge_deltas(a: list[dict], b: list[dict]) -> list[dict]:
    """Both, if none of their paths conflict."""
    if deltas_conflict(a, b):
        raise ValueError(f"conflicting paths: {conflicting_paths(a, b)}")
    return [*a, *b]


def apply_patches(value: dict, patches: list[dict]) -> dict:
    """Patches (op replace, add or remove; path; value) in order; missing parents are made."""
    return apply_delta(value, [{"op": "remove" if p["op"] == "remove" else "set", "path": tuple(p["path"]), "value": p.get("value")} for p in patches])
