"""Column builders along time, within `over` (an entity); rows are ordered by `order`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .cross_section import finite


def _window(order: str, over: Sequence[str] | str):
    return Window.partitionBy(*([over] if isinstance(over, str) else over)).orderBy(order)


def rolling_zscore(col: str, window: int, order: str, over: Sequence[str] | str = (), min_samples: int | None = None) -> Column:
    """(x - mean) / sd of the last `window` rows, this one included; null until min_samples of them are known."""
    w = _window(order, over).rowsBetween(1 - window, 0)
    least = window // 2 if min_samples is None else min_samples
    x = finite(col)
    return F.when(F.count(x).over(w) >= least, F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def rolling_mean(col: str, window: int, order: str, over: Sequence[str] | str = ()) -> Column:
    return F.avg(finite(col)).over(_window(order, over).rowsBetween(1 - window, 0))


def lag(col: str, n: int, order: str, over: Sequence[str] | str = ()) -> Column:
    return F.lag(col, n).over(_window(order, over))


def forward_return(price: str, h: int, order: str, over: Sequence[str] | str = ()) -> Column:
    """ln of the price h rows on over the price now: a target, never an input. Null for prices that aren't positive."""
    return F.ln(F.try_divide(F.lead(price, h).over(_window(order, over)), F.col(price)))


def momentum(close: str, lookback: int, skip: int, order: str, over: Sequence[str] | str = ()) -> Column:
    """The change from `lookback` rows ago to `skip` rows ago."""
    w = _window(order, over)
    return F.try_divide(F.lag(close, skip).over(w), F.lag(close, lookback).over(w)) - 1
