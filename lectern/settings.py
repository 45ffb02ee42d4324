"""Settings of a driver: nested values from files, overridden by the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any


def merged(base: Mapping[str, Any], over: Mapping[str, Any] | None) -> dict[str, Any]:
    """Both mappings as one: values of ``over`` win, mappings on both sides are merged in turn. Neither is changed."""
    out = dict(base)
    for name, value in (over or {}).items():
        both = isinstance(value, Mapping) and isinstance(out.get(name), Mapping)
        out[name] = merged(out[name], value) if both else value
    return out


def from_environment(prefix: str, names: Mapping[str, tuple[str, ...]], environment: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings that environment variables give: ``names`` maps a variable, without its prefix, to the path of its setting. Empty variables say nothing."""
    there = os.environ if environment is None else environment
    out: dict[str, Any] = {}
    for name, path in names.items():
        if said := there.get(f"{prefix}{name}"):
            nested: Any = said
            for part in reversed(path):
                nested = {part: nested}
            out = merged(out, nested)
    return out


def watched_paths(given: list[str | Mapping[str, Any]]) -> list[tuple[str, str | None]]:
    """``(path, index)`` of watched folders given as paths or as mappings; a path ends without a slash."""
    rows = [(x, None) if isinstance(x, str) else (x["path"], x.get("index")) for x in given]
    return [(path.rstrip("/") or "/", index) for path, index in rows]
