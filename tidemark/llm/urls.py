"""Allow and block lists of urls in a trie over reversed host labels, then path segments; the longest match decides.

The trie is built on the driver from the rules, whose number is checked against a documented bound, and broadcast.
Defined results: a null url, or one without "://", has an empty host and path, which no rule fits; repeated rows are
judged alike; a url that no rule fits gets the default verdict; rules of equal length are settled by block before allow.
Very long urls are matched whole, in time proportional to their length. An empty table gives an empty result. Other columns
stay as they are, whatever their names, but for host, path, rule and verdict, which the result's take the place of.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the url's path starts with `path`."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.translate(_LOWER), slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Trie:
    """A node is a dict: a label or segment -> node, and under None the rules that end there, longest first.

    A rule's whole segments are steps; what follows its last slash is compared as a prefix, so "/en" fits "/english"
    and "/en/" doesn't. Of the rules that fit, the longest text wins: more host, then more path; a block beats an
    allow of the same text.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: dict = {}
        for rule in rules:
            node = self.hosts
            for label in reversed(rule.host.split(".")) if rule.host else []:
                node = node.setdefault(label, {})
            node = node.setdefault("", {})  # from here on, the path: no host label is empty
            *steps, rest = rule.path.split("/")
            for step in steps:
                node = node.setdefault(step, {})
            node.setdefault(None, []).append((rest, rule))

    def find(self, host: str, path: str) -> Rule | None:
        found: list[Rule] = []
        node, labels = self.hosts, host.split(".") if host else []
        if "" in node:
            self._paths(node[""], path, found)
        for label in reversed(labels):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                self._paths(node[""], path, found)
        return max(found, key=lambda r: (len(r.text), r.verdict == BLOCK, r.text), default=None)

    def _paths(self, node: dict, path: str, found: list[Rule]) -> None:
        segments = path.split("/")
        for i, segment in enumerate(segments):
            rest = "/".join(segments[i:])
            found += [rule for prefix, rule in node.get(None, ()) if rest.startswith(prefix)]
            node = node.get(segment) if i < len(segments) - 1 else None
            if node is None:
                return


def split_url(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path, up to a query or fragment."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW, url: str = "url", most_rules: int = 2_000_000) -> DataFrame:
    """pages with host, path, rule and verdict: a map over the rows, no shuffle."""
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules: more than the {most_rules} that are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    names = ["host", "path", "rule", "verdict"]

    @F.arrow_udf(", ".join(f"{n} string" for n in names))
    def judged(urls: pa.Array) -> pa.Array:
        rows = []
        for u in urls.to_pylist():
            host, path = split_url(u)
            rule = trie.value.find(host, path)
            rows.append((host, path, rule.text if rule else None, rule.verdict if rule else default))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    bounded_batches(pages.sparkSession)
    kept = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return packed(pages, _judged=judged(F.col(url))).select(*kept, "_judged.*")


def rules_from(allow: Iterable[str] = (), block: Iterable[str] = ()) -> list[Rule]:
    return [*(Rule.parse(ALLOW, x) for x in allow), *(Rule.parse(BLOCK, x) for x in block)]
