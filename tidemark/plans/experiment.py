"""Experiments in TOML: a study, its parameters, perhaps a sweep or a search; parameters are checked against the study."""

from __future__ import annotations

import datetime as dt
import inspect
import tomllib
import types
import typing
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .search import SearchSpace, sweep


@dataclass(frozen=True)
class Experiment:
    study: str
    params: dict[str, Any] = field(default_factory=dict)
    sweep: dict[str, list] = field(default_factory=dict)
    search: SearchSpace | None = None

    def cells(self) -> list[dict[str, Any]]:
        """The parameters of each run: one, the sweep's cells, or the search's candidates."""
        more = self.search.candidates() if self.search else sweep(self.sweep) if self.sweep else [{}]
        return [self.params | c for c in more]


def load(path: Path) -> Experiment:
    raw = tomllib.loads(path.read_text())
    if extra := set(raw) - {"study", "params", "sweep", "search"}:
        raise ValueError(f"{path}: unknown keys {sorted(extra)}")
    if "study" not in raw:
        raise ValueError(f"{path}: names no study")
    if "sweep" in raw and "search" in raw:
        raise ValueError(f"{path}: a sweep or a search, not both")
    return Experiment(raw["study"], raw.get("params", {}), raw.get("sweep", {}), SearchSpace.parse(raw["search"]) if "search" in raw else None)


def _fits(value: Any, kind: Any) -> bool:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any or kind is inspect.Parameter.empty:
        return True
    if origin in (typing.Union, types.UnionType):
        return any(_fits(value, a) for a in args)
    if origin is typing.Literal:
        return value in args
    if origin in (list, tuple):
        return isinstance(value, list | tuple) and all(_fits(v, args[0]) for v in value if args)
    if origin is dict:
        return isinstance(value, Mapping)
    if kind is float:
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return value is None if kind is type(None) else isinstance(value, kind)


def checked(factory: Callable, params: Mapping[str, Any], given: tuple[str, ...] = ("root", "spark")) -> dict[str, Any]:
    """params, with text made dates where dates are asked for; refuses unknown names, missing ones and other types."""
    known, hints, out = inspect.signature(factory).parameters, typing.get_type_hints(factory), {}
    if extra := set(params) - (set(known) - set(given)):
        raise ValueError(f"no such parameters: {sorted(extra)}")
    for name, p in known.items():
        if name in given:
            continue
        if name not in params:
            if p.default is p.empty:
                raise ValueError(f"parameter {name} is missing")
            continue
        value, kind = params[name], hints.get(name, p.empty)
        if kind is dt.date and isinstance(value, str):
            value = dt.date.fromisoformat(value)
        if not _fits(value, kind):
            raise TypeError(f"parameter {name} takes {kind}, not {value!r}")
        out[name] = float(value) if kind is float else value
    return out
