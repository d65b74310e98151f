"""Extension points: features, timed features, labels, strategies, models and executions by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec

from tickloom.functions.book import FEATURES, Feature


@runtime_checkable
class Strategy(Protocol):
    """Learns from history and gives sides for rows."""

    def fit(self, history: DataFrame) -> Strategy: ...

    def decide(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class Model(Protocol):
    """Learns from features and a label, gives class probabilities."""

    def fit(self, rows: DataFrame) -> Model: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


@runtime_checkable
class FeatureSet(Protocol):
    def build(self, book: DataFrame, trades: DataFrame | None) -> DataFrame: ...


@runtime_checkable
class Label(Protocol):
    def build(self, book: DataFrame) -> DataFrame: ...


@runtime_checkable
class Execution(Protocol):
    def run(self, decisions: DataFrame, book: DataFrame) -> DataFrame: ...


KINDS: dict[str, type] = {
    "strategy": Strategy,
    "model": Model,
    "features": FeatureSet,
    "label": Label,
    "execution": Execution,
}
_REGISTRY: dict[tuple[str, str], Callable[..., Any]] = {}
TIMED: dict[str, tuple[float, Callable[[DataFrame], DataFrame]]] = {}


def add(kind: str, name: str, factory: Callable[..., Any]) -> Callable[..., Any]:
    """Register a factory; a name may be taken once per kind."""
    if kind not in KINDS:
        raise KeyError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    if (kind, name) in _REGISTRY:
        raise ValueError(f"{kind} {name!r} is registered already")
    _REGISTRY[kind, name] = factory
    return factory


def get(kind: str, name: str, **options: Any) -> Any:
    """Build a registered plugin, looking through installed entry points when it is not known."""
    if (kind, name) not in _REGISTRY:
        for point in entry_points(group=f"tickloom.{kind}"):
            if point.name == name:
                _REGISTRY[kind, name] = point.load()
    if (kind, name) not in _REGISTRY:
        raise KeyError(f"no {kind} {name!r}; known: {names(kind)}")
    made = _REGISTRY[kind, name](**options)
    if not isinstance(made, KINDS[kind]):
        raise TypeError(f"{kind} {name!r} lacks the methods its protocol asks for")
    return made


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _REGISTRY if k == kind)


def feature(
    name: str, rows_back: int, plane: str = "book", description: str = ""
) -> Callable[[Callable[[WindowSpec], Column]], Callable[[WindowSpec], Column]]:
    """Register a feature: a Column builder over the ordered window and its declared look-back."""

    def register(build: Callable[[WindowSpec], Column]) -> Callable[[WindowSpec], Column]:
        if name in FEATURES:
            raise ValueError(f"feature {name!r} is registered already")
        FEATURES[name] = Feature(name, rows_back, build, plane, description)
        return build

    return register


def timed_feature(name: str, seconds: float) -> Callable:
    """Register a builder whose look-back is a span of time."""

    def register(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in TIMED:
            raise ValueError(f"timed feature {name!r} is registered already")
        TIMED[name] = (seconds, build)
        return build

    return register


def per_group(
    df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """A row-group function over groups whose size the caller has bounded (chunks, windows, days)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


class BookImbalance:
    """Go with the heavier queue once its imbalance is in the training top share."""

    def __init__(self, share: float = 0.05) -> None:
        if not 0 < share < 1:
            raise ValueError("share must be inside (0, 1)")
        self.share = share
        self.history: DataFrame | None = None

    def fit(self, history: DataFrame) -> BookImbalance:
        self.history = history
        return self

    def decide(self, rows: DataFrame) -> DataFrame:
        from tickloom.functions.tensor import imbalance_rule

        if self.history is None:
            raise RuntimeError("fit the strategy first")
        return imbalance_rule(self.history, rows, self.share)


add("strategy", "book_imbalance", BookImbalance)
