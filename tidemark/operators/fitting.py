"""A whole walk-forward fit: selection, transforms and a model, all fitted inside each fold.

Folds whose selection is the same are fitted together in one pass; without selection that is all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, selection, transforms


@dataclass(frozen=True)
class Winsorize:
    q: float = 0.01

    def apply(self, rows: DataFrame, features: list[str], target: str, fill: float) -> tuple[DataFrame, list[str]]:
        return transforms.winsorize(rows, features, self.q, target), features


@dataclass(frozen=True)
class Interactions:
    top: int = 4

    def apply(self, rows: DataFrame, features: list[str], target: str, fill: float) -> tuple[DataFrame, list[str]]:
        out = transforms.interactions(rows, features, target, self.top)
        return out, features + [c for c in out.columns if c not in rows.columns]


@dataclass(frozen=True)
class Components:
    """Principal components; with keep_inputs the model sees the inputs too."""

    k: int = 5
    keep_inputs: bool = False

    def apply(self, rows: DataFrame, features: list[str], target: str, fill: float) -> tuple[DataFrame, list[str]]:
        out, _ = transforms.pca(rows, features, target, self.k, fill)
        made = [f"pc{c + 1}" for c in range(min(self.k, len(features)))]
        return out, (features if self.keep_inputs else []) + made


@dataclass(frozen=True)
class Clusters:
    """Selection inside the fold: one member a cluster of correlated features (operators.selection)."""

    cut: float = 0.6
    min_cluster: int = 3
    tie_tol: float = 0.1
    singleton_ir: float = 2.0
    singleton_cons: float = 0.75
    keep_previous: bool = False
    year: str = "y_year"


@dataclass(frozen=True)
class Fit:
    """kind: a name of ESTIMATORS, which takes the options."""

    kind: str = "ridge"
    target: str = "y_z"
    rank_target: str = "y_rank"
    options: Mapping[str, Any] = field(default_factory=dict)
    selection: Clusters | None = None
    transforms: tuple[Winsorize | Interactions | Components, ...] = ()
    cross_section: bool = True
    allow_constant: bool = False
    keep_train: bool = True
    fill: float = 0.5


def applied(rows: DataFrame, features: Sequence[str], chain: Sequence, target: str, fill: float = 0.5) -> tuple[DataFrame, list[str]]:
    """rows and features after a chain of transforms, each fitted on what the one before gives."""
    names = list(features)
    for step in chain:
        rows, names = step.apply(rows, names, target, fill)
    return rows, names


def _linear(fit: Callable) -> Callable:
    def fitted(rows: DataFrame, features: list[str], s: Fit) -> tuple[DataFrame, DataFrame]:
        model = fit(rows, features, s.target, fill=s.fill, **s.options)
        return model.predict(rows), model.table(rows.sparkSession).select("fold", "input", "weight")

    return fitted


def _rule(rows: DataFrame, features: list[str], s: Fit) -> tuple[DataFrame, DataFrame]:
    table = models.rule(rows, features, s.target, fill=s.fill, **s.options)
    names = F.array(*map(F.lit, features))
    picked = table.select("fold", F.when(F.col("input") >= 0, F.get(names, F.col("input"))).otherwise("always").alias("input"), F.lit(1.0).alias("weight"))
    return models.rule_predict(rows, table, features, s.options.get("position", -1.0), s.fill), picked


def _boosted(rows: DataFrame, features: list[str], s: Fit) -> tuple[DataFrame, DataFrame]:
    preds, gains = models.boosted(rows, features, s.target, fill=s.fill, **s.options)
    return preds, rows.sparkSession.createDataFrame([(f, n, g) for f, each in gains.items() for n, g in each.items()], "fold int, input string, weight double")


#: name -> (rows dealt to folds, features, Fit) -> predictions and what each fold's model holds (fold, input, weight).
ESTIMATORS: dict[str, Callable[[DataFrame, list[str], Fit], tuple[DataFrame, DataFrame]]] = {"ridge": _linear(models.ridge), "composite": _linear(models.composite), "rule": _rule, "boosted": _boosted}


def fit_walk_forward(rows: DataFrame, features: Sequence[str], s: Fit, keys: Sequence[str] = ("root", "t0"), date: str = "t0") -> tuple[DataFrame, DataFrame]:
    """keys, fold, is_train, pred of rows dealt to folds; and fold, input, weight of each fold's model.

    Refuses a prediction that is constant on a test date (over the test period, for a time series).
    """
    if s.kind not in ESTIMATORS:
        raise ValueError(f"no such model: {s.kind}; there are {', '.join(sorted(ESTIMATORS))}")
    parts = [(tuple(features), rows)]
    if s.selection:
        c = s.selection
        picked = selection.select_by_fold(rows.filter("is_train"), features, s.rank_target, date, c.year, c.cut, c.min_cluster, c.tie_tol, c.singleton_ir, c.singleton_cons, s.fill, c.keep_previous)
        by: dict[int, list[str]] = {}
        for r in picked.filter("chosen").orderBy("fold").collect():
            by.setdefault(r["fold"], []).append(r["feature"])
        if lost := {r[0] for r in rows.select("fold").distinct().collect()} - by.keys():
            raise ValueError(f"no feature is selected in folds {sorted(lost)}")
        alike: dict[tuple[str, ...], list[int]] = {}
        for fold, names in by.items():
            alike.setdefault(tuple(sorted(names, key=list(features).index)), []).append(fold)
        parts = [(names, rows.filter(F.col("fold").isin(own))) for names, own in alike.items()]
    preds = tables = None
    for names, part in parts:
        ready, inputs = applied(part, names, s.transforms, s.target, s.fill)
        p, table = ESTIMATORS[s.kind](ready, inputs, s)
        p = p.select(*keys, "fold", "is_train", "pred")
        preds, tables = (p, table) if preds is None else (preds.unionByName(p), tables.unionByName(table))
    models.check_predictions(preds, date, s.cross_section, s.allow_constant or s.kind == "rule")
    return preds if s.keep_train else preds.filter("not is_train"), tables
