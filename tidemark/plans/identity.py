"""What makes two things the same: canonical JSON of declared values, reached code, and logical content of frames."""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import functools
import hashlib
import inspect
import json
import math
import platform
import subprocess
import types
from collections.abc import Mapping
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value: Any) -> Any:
    """A JSON value that is equal exactly for equal values; refuses what has no identity (frames, open objects)."""
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{value} has no place in a specification")
        return value
    if isinstance(value, enum.Enum):
        return {"enum": type(value).__name__, "name": value.name}
    if isinstance(value, dt.datetime | dt.date | dt.timedelta):
        return {type(value).__name__: str(value)}
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        # a field added later with a default leaves old identities alone while it has that default
        kept = {f.name: getattr(value, f.name) for f in dataclasses.fields(value) if not (f.metadata.get("added") and getattr(value, f.name) == f.default)}
        return {"spec": type(value).__name__, "version": getattr(value, "version", 1), "fields": {k: canonical(v) for k, v in sorted(kept.items())}}
    if isinstance(value, Mapping):
        return {"map": sorted(([canonical(k), canonical(v)] for k, v in value.items()), key=json.dumps)}
    if isinstance(value, set | frozenset):
        return {"set": sorted((canonical(v) for v in value), key=json.dumps)}
    if isinstance(value, list | tuple):
        return [canonical(v) for v in value]
    raise TypeError(f"a {type(value).__name__} has no identity")


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps([canonical(p) for p in parts], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _names(code: types.CodeType) -> set[str]:
    """The global names and attributes that a code object mentions, in its lambdas and inner functions too."""
    found = set(code.co_names)
    for const in code.co_consts:
        if isinstance(const, types.CodeType):
            found |= _names(const)
    return found


def code_digest(fn: Any, package: str | None = None) -> str:
    """Source of fn and of what it reaches in its package, with the values that it closes over.

    Reached are functions, classes and constants among its module's globals, and those of the package's modules that it
    mentions: an operator called as module.name belongs to the stage that calls it. Too much may be reached by a name that
    two modules share, which costs a rerun; too little would be a stale result.
    """
    found: dict[str, Any] = {}

    def mentioned(value: Any, at: str, root: str, names: set[str]) -> None:
        if isinstance(value, types.ModuleType):
            if value.__name__.split(".")[0] == root:
                for name in names & vars(value).keys():
                    mentioned(vars(value)[name], f"{value.__name__}.{name}", root, set())
        elif isinstance(value, types.FunctionType | type | functools.partial):
            if (getattr(value, "__module__", None) or root).split(".")[0] == root:
                reach(value, root)
        elif value is None or isinstance(value, bool | int | float | str | tuple | frozenset):
            try:
                found[at] = canonical(value)
            except (TypeError, ValueError):
                found[at] = repr(value)

    def reach(f: Any, root: str | None) -> None:
        if isinstance(f, functools.partial):
            found[f"partial:{len(found)}"] = canonical([list(f.args), f.keywords])
            f = f.func
        f = inspect.unwrap(f)
        if not isinstance(f, types.FunctionType | type):
            return
        name = f"{f.__module__}.{f.__qualname__}"
        if name in found:
            return
        try:
            found[name] = inspect.getsource(f)
        except (OSError, TypeError):
            found[name] = f.__code__.co_code.hex() if isinstance(f, types.FunctionType) else name
        root = root or package or f.__module__.split(".")[0]
        if isinstance(f, type):
            for member in vars(f).values():
                member = getattr(member, "__func__", getattr(member, "fget", member))
                if isinstance(member, types.FunctionType) and not member.__code__.co_filename.startswith("<"):  # written, not generated
                    follow(member, root)
            for base in f.__bases__:
                if base.__module__.split(".")[0] == root:
                    reach(base, root)
        else:
            follow(f, root)

    def follow(f: types.FunctionType, root: str) -> None:
        for cell in f.__closure__ or ():
            held = cell.cell_contents
            if isinstance(held, SparkSession):
                continue  # a way to compute, and no part of what is computed
            if isinstance(held, types.ModuleType):
                mentioned(held, held.__name__, root, _names(f.__code__))
                continue
            reach(held, root) if callable(held) else found.update({f"{f.__qualname__}:{len(found)}": canonical(held)})
        names = _names(f.__code__)
        for name in sorted(names & f.__globals__.keys()):
            mentioned(f.__globals__[name], f"{f.__module__}.{name}", root, names)

    reach(fn, package)
    return digest(found)


def content_hash(df: DataFrame) -> str:
    """Of a frame's columns, types and rows, whatever their order and files: count and two order-free sums of row hashes."""
    names = [f"`{c}`" for c in df.columns]
    doubles = [F.round(F.col(n), 12) + F.lit(0.0) if t in ("double", "float") else F.col(n) for n, (_, t) in zip(names, df.dtypes, strict=True)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *doubles).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    r = df.agg(F.count("*").alias("n"), *sums).first()
    return digest(df.schema.json(), r["n"], str(r["s1"]), str(r["s2"]))


#: Settings that change what a query gives.
CONFS = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.caseSensitive", "spark.sql.storeAssignmentPolicy", "spark.sql.decimalOperations.allowPrecisionLoss", "spark.sql.legacy.timeParserPolicy")


def environment(spark: Any = None) -> str:
    """Of the interpreter, the machine, the libraries that compute, this package's version and the session's settings."""
    versions = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    confs = {c: spark.conf.get(c, None) for c in CONFS} if spark is not None else {}
    return digest(platform.python_version(), platform.machine(), versions, _version(), confs)


def _version() -> str:
    import tidemark

    return tidemark.__version__


def code_identity(folder: str | Path) -> str:
    """version @ commit of the code in a folder, with (changed) if files differ from the commit: for records, not for keys."""
    run = lambda *a: subprocess.run(["git", "-C", str(folder), *a], capture_output=True, text=True, check=False)
    commit = run("rev-parse", "--short=12", "HEAD")
    if commit.returncode:
        return f"{_version()} @ no commit"
    return f"{_version()} @ {commit.stdout.strip()}" + (" (changed)" if run("status", "--porcelain").stdout.strip() else "")
