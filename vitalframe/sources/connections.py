"""Named connections in YAML, with ${VAR} from the environment or a .env file,
and layered configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_VAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")

# Defaults.
DEFAULTS: dict[str, Any] = {
    "sample_size": 0, "max_depth": 10, "max_array_depth": 3, "max_array_items": 100, "sample_strategy": "reservoir", "sample_seed": 42,
    "low_cardinality_threshold": 50, "mask_pii": True, "history_protected_tags": ["baseline"],
}


def read_env(path: str | Path) -> dict[str, str]:
    p = Path(path)
    if not p.exists():
        return {}
    pairs = (line.split("=", 1) for line in p.read_text().splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def substitute(value: Any, env: Mapping[str, str]) -> Any:
    """Fill ``${VAR}`` and ``${VAR:-default}`` in all texts; unknown ones raise."""
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        if m[1] in os.environ:
            return os.environ[m[1]]
        if m[1] in env:
            return env[m[1]]
        if m[2] is not None:
            return m[2]
        raise KeyError(f"{m[1]} is not set")

    return _VAR.sub(fill, value)


def load_connection(folder: str | Path, name: str) -> dict[str, Any]:
    import yaml

    base = Path(folder)
    path = next((p for p in (base / f"{name}.yaml", base / f"{name}.yml") if p.exists()), None)
    if path is None:
        raise FileNotFoundError(f"no connection {name} in {folder}")
    data = yaml.safe_load(path.read_text()) or {}
    if "source_type" not in data:
        raise ValueError(f"{path}: source_type is missing")
    return substitute(data, read_env(base / ".env"))


def list_connections(folder: str | Path) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.y*ml"))


def layered(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """Later layers win, mapping by mapping."""
    out: dict[str, Any] = {}
    for layer in (DEFAULTS, *layers):
        for k, v in (layer or {}).items():
            out[k] = layered_dict(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def layered_dict(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    return {k: layered_dict(a[k], b[k]) if k in a and k in b and isinstance(a[k], Mapping) and isinstance(b[k], Mapping) else b.get(k, a.get(k)) for k in {**a, **b}}
