"""Artifacts by content, a manifest of what made them, and a ledger of trials: files that are only added to."""

from __future__ import annotations

import datetime as dt
import fcntl
import json
import math
import socket
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .identity import content_hash, digest


def append(path: Path, record: dict) -> None:
    """One line of JSON, under a lock, so that writers on one file system don't mix."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.write(json.dumps(record, ensure_ascii=False, sort_keys=True) + "\n")


def lines(path: Path) -> list[dict]:
    if not path.exists():
        return []
    return [json.loads(x) for x in path.read_text().split("\n")[:-1] if x]


def check_json(value: Any, at: str = "$") -> None:
    """Refuses what JSON can't hold exactly, naming its place."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{at}: {value} is not finite")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise TypeError(f"{at}: key {k!r} is not a string")
            check_json(v, f"{at}.{k}")
    elif isinstance(value, list | tuple):
        for i, v in enumerate(value):
            check_json(v, f"{at}[{i}]")
    elif not (value is None or isinstance(value, bool | int | float | str)):
        raise TypeError(f"{at}: a {type(value).__name__}")


class Store:
    """objects/<2 hex>/<hash>: a Parquet folder or a JSON file. Written beside and renamed, never overwritten.

    Objects lie wherever Spark can write: all file operations go through its Hadoop file systems. Manifest, ledger and
    events are the driver's own files.
    """

    def __init__(self, root: str | Path, spark: SparkSession):
        self.root, self.spark = str(root).rstrip("/"), spark
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._at(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, ref: str) -> str:
        kind, name = ref.split(":")
        return f"{self.root}/objects/{name[:2]}/{name}" + {"parquet": "", "json": ".json"}[kind]

    def has(self, ref: str) -> bool:
        p = self._path(ref)
        return self._files.exists(self._at(f"{p}/_SUCCESS" if ref.startswith("parquet:") else p))

    def put(self, value: Any) -> str:
        temporary = f"{self.root}/tmp/{uuid.uuid4().hex}"
        if isinstance(value, DataFrame):
            value.write.option("compression", "zstd").parquet(temporary)
            ref = "parquet:" + content_hash(self.spark.read.parquet(temporary))
        else:
            check_json(value)
            out = self._files.create(self._at(temporary))
            try:
                out.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
            finally:
                out.close()
            ref = "json:" + digest(value)
        place = self._at(self._path(ref))
        self._files.mkdirs(place.getParent())
        # whoever comes second finds the same content there already
        if self.has(ref) or not self._files.rename(self._at(temporary), place):
            self._files.delete(self._at(temporary), True)
        return ref

    def get(self, ref: str) -> Any:
        p = self._path(ref)
        if ref.startswith("parquet:"):
            return self.spark.read.parquet(p)
        stream = self._files.open(self._at(p))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


class Manifest:
    """key -> record; a file a host, all read; the newest record of a key counts. Only what was added since the last look
    is read again."""

    def __init__(self, root: str | Path):
        self.folder = Path(root) / "manifest"
        self._read: dict[Path, int] = {}
        self._newest: dict[str, dict] = {}

    def find(self, key: str) -> dict | None:
        for p in sorted(self.folder.glob("*.jsonl")):
            start = self._read.get(p, 0)
            if p.stat().st_size <= start:
                continue
            with p.open("rb") as f:
                f.seek(start)
                fresh = f.read()
            whole = fresh[: fresh.rfind(b"\n") + 1]  # a line still being written waits
            self._read[p] = start + len(whole)
            for r in map(json.loads, whole.splitlines()):
                if r["key"] not in self._newest or r["built_at"] >= self._newest[r["key"]]["built_at"]:
                    self._newest[r["key"]] = r
        return self._newest.get(key)

    def add(self, **record) -> None:
        append(self.folder / f"{socket.gethostname()}.jsonl", record | {"built_at": dt.datetime.now(dt.UTC).isoformat(), "host": socket.gethostname()})


class Ledger:
    """Trials and books, each charged once, and the one opening of the holdout."""

    def __init__(self, root: str | Path):
        self.path = Path(root) / "ledger.jsonl"

    def _all(self, kind: str) -> list[dict]:
        return [r for r in lines(self.path) if r["kind"] == kind]

    def charge(self, signature: str, headline: dict | None = None, kind: str = "trial") -> bool:
        """Whether it is new."""
        if any(r["signature"] == signature for r in self._all(kind)):
            return False
        append(self.path, {"kind": kind, "signature": signature, "headline": headline or {}, "at": dt.datetime.now(dt.UTC).isoformat()})
        return True

    def trials(self) -> list[dict]:
        return self._all("trial")

    def books(self) -> list[dict]:
        return self._all("book")

    def opened(self) -> dict | None:
        return next(iter(self._all("holdout")), None)

    def open_holdout(self, reason: str) -> dict:
        if self.opened():
            raise RuntimeError(f"the holdout was opened at {self.opened()['at']}: it opens once")
        append(self.path, {"kind": "holdout", "signature": "holdout", "reason": reason, "at": dt.datetime.now(dt.UTC).isoformat()})
        return self.opened()


def guard(frame: DataFrame, ledger: Ledger, start: dt.date, column: str = "t0", horizon: str | None = None, early_exit: bool = False) -> DataFrame:
    """frame without what is sealed, unless the ledger records the opening."""
    from ..operators.judge import holdout

    return holdout(frame, start, column, horizon, opened=ledger.opened() is not None, early_exit=early_exit)


def with_holdout(fingerprint, ledger: Ledger):
    """A source's fingerprint that changes when the holdout is opened."""

    def both() -> str:
        opened = ledger.opened()
        return f"{fingerprint()}|holdout={'open@' + opened['at'] if opened else 'sealed'}"

    return both


def dig(value: Any, path: str) -> Any:
    """The value at a dotted path of a JSON output."""
    for part in path.split("."):
        value = value[int(part)] if isinstance(value, list) else value[part]
    return value
