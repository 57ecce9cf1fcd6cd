"""Settings in layers, each value with where it came from: defaults, files, a profile, the environment, the command line."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {"paths.root": "~/.tidemark", "paths.data": "", "compute.workers": 0, "compute.master": "local[*]", "alerts.sink": "jsonl", "alerts.url": "", "alerts.patience": 3600}
SINKS = ("jsonl", "stdout", "webhook", "page")


@dataclass(frozen=True)
class Resolved:
    values: dict[str, Any]
    origin: dict[str, str]

    def __getitem__(self, key: str) -> Any:
        return self.values[key]


def flat(table: Mapping, at: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in table.items():
        out |= flat(v, f"{at}{k}.") if isinstance(v, Mapping) else {at + k: v}
    return out


def load(files: list[Path] = (), profile: str | None = None, environ: Mapping[str, str] = os.environ, overrides: Mapping[str, Any] | None = None) -> Resolved:
    """Later layers win. Unknown keys, and values of another type than the default's, are refused with their origin."""
    values, origin = dict(DEFAULTS), dict.fromkeys(DEFAULTS, "default")

    def merge(layer: Mapping[str, Any], where: str) -> None:
        for k, v in layer.items():
            if k not in DEFAULTS:
                raise ValueError(f"{where}: no such setting {k}")
            kind = type(DEFAULTS[k])
            if not isinstance(v, kind):
                try:
                    v = kind(v)
                except ValueError as e:
                    raise ValueError(f"{where}: {k} takes {kind.__name__}, not {v!r}") from e
            values[k], origin[k] = (os.path.expandvars(os.path.expanduser(v)) if k.startswith("paths.") else v), where

    for path in files:
        if path.exists():
            table = tomllib.loads(path.read_text())
            profiles = table.pop("profile", {})
            merge(flat(table), str(path))
            if profile in profiles:
                merge(flat(profiles[profile]), f"{path} [{profile}]")
    merge({k.removeprefix("TIDEMARK_").lower().replace("__", "."): v for k, v in environ.items() if k.startswith("TIDEMARK_")}, "environment")
    merge(overrides or {}, "command line")
    if values["alerts.sink"] not in SINKS:
        raise ValueError(f"{origin['alerts.sink']}: alerts.sink is one of {', '.join(SINKS)}")
    return Resolved(values, origin)


def starter() -> str:
    """A settings file with every default."""
    out, section = [], None
    for key, value in DEFAULTS.items():
        table, _, name = key.partition(".")
        if table != section:
            out += ([""] if out else []) + [f"[{table}]"]
            section = table
        out.append(f"{name} = " + (f'"{value}"' if isinstance(value, str) else str(value)))
    return "\n".join(out) + "\n"
