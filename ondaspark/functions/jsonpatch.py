"""JSON patches (RFC 6902): difference and application."""

from __future__ import annotations

import copy
from typing import Any


def _escape(key: Any) -> str:
    return str(key).replace("~", "~0").replace("/", "~1")


def diff(old: Any, new: Any, path: str = "") -> list[dict]:
    """Operations that turn old into new."""
    if type(old) is type(new) and isinstance(old, dict):
        out = [{"op": "remove", "path": f"{path}/{_escape(k)}"} for k in old if k not in new]
        for k, v in new.items():
            at = f"{path}/{_escape(k)}"
            out += diff(old[k], v, at) if k in old else [{"op": "add", "path": at, "value": v}]
        return out
    if type(old) is type(new) and isinstance(old, list):
        out = []
        for i, (a, b) in enumerate(zip(old, new, strict=False)):
            out += diff(a, b, f"{path}/{i}")
        out += [{"op": "remove", "path": f"{path}/{i}"} for i in range(len(old) - 1, len(new) - 1, -1)]
        return out + [{"op": "add", "path": f"{path}/-", "value": v} for v in new[len(old) :]]
    return [] if type(old) is type(new) and old == new else [{"op": "replace", "path": path, "value": new}]


def _find(document: Any, path: str) -> tuple[Any, Any]:
    """(container, last key) of a path that isn't the root."""
    keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
    for k in keys[:-1]:
        document = document[int(k)] if isinstance(document, list) else document[k]
    last = keys[-1]
    return document, (last if not isinstance(document, list) or last == "-" else int(last))


def apply(document: Any, patch: list[dict]) -> Any:
    """A patched copy."""
    document = copy.deepcopy(document)
    for step in patch:
        op, path = step["op"], step["path"]
        value = copy.deepcopy(step.get("value"))
        if op in ("move", "copy"):
            box, key = _find(document, step["from"])
            value = copy.deepcopy(box[key])
            if op == "move":
                del box[key]
            op = "add"
        if path == "":
            if op == "remove":
                raise ValueError("the root can't be removed")
            if op == "test" and document != value:
                raise ValueError("test failed at the root")
            document = document if op == "test" else value
            continue
        box, key = _find(document, path)
        if op == "test":
            if box[key] != value:
                raise ValueError(f"test failed at {path}")
        elif op == "remove":
            del box[key]
        elif op == "add" and isinstance(box, list):
            box.insert(len(box) if key == "-" else key, value)
        elif op in ("add", "replace"):
            if op == "replace":
                box[key]  # must exist
            box[key] = value
        else:
            raise ValueError(f"unknown operation {op!r}")
    return document
