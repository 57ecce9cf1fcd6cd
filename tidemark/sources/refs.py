"""Named places of data and fingerprints of what lies there."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from ..plans.store import append, lines


def content_hash(path: Path, cache: StatCache | None = None) -> str:
    """Of a file's bytes, or of a folder's sorted (relative path, hash) pairs; names that begin with a dot are left out."""
    if path.is_dir():
        files = sorted(p for p in path.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(path).parts))
        tree = hashlib.blake2b(digest_size=32)
        for p in files:
            tree.update(json.dumps([p.relative_to(path).as_posix(), content_hash(p, cache)]).encode())
        return tree.hexdigest()
    if cache and (known := cache.get(path)):
        return known
    with path.open("rb") as f:
        found = hashlib.file_digest(f, lambda: hashlib.blake2b(digest_size=32)).hexdigest()
    if cache:
        cache.put(path, found)
    return found


class StatCache:
    """(path, size, modification time, inode) -> hash, in a file that is only added to."""

    def __init__(self, path: Path):
        self.path = path
        self.known = {tuple(r["stat"]): r["hash"] for r in lines(path)}

    def _stat(self, path: Path) -> tuple:
        s = os.stat(path)
        return str(path.resolve()), s.st_size, s.st_mtime_ns, s.st_ino

    def get(self, path: Path) -> str | None:
        return self.known.get(self._stat(path))

    def put(self, path: Path, found: str) -> None:
        self.known[self._stat(path)] = found
        append(self.path, {"stat": list(self._stat(path)), "hash": found})


@dataclass(frozen=True)
class DataRef:
    """A path below a root that each site names by itself."""

    alias: str
    relative: str = ""

    def path(self, roots: Mapping[str, str]) -> Path:
        if self.alias not in roots:
            raise KeyError(f"no data root is called {self.alias}; there are {sorted(roots)}")
        return Path(roots[self.alias]) / self.relative

    def fingerprint(self, roots: Mapping[str, str], cache: StatCache | None = None) -> str:
        p = self.path(roots)
        if not p.exists():
            raise FileNotFoundError(p)
        return content_hash(p, cache)


def fingerprint_of(refs: list[DataRef], roots: Mapping[str, str], cache: StatCache | None = None) -> str:
    each = sorted([r.alias, r.relative, r.fingerprint(roots, cache)] for r in refs)
    return hashlib.blake2b(json.dumps(each).encode(), digest_size=32).hexdigest()
