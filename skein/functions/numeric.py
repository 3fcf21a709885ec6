"""One way to write a formula for Spark columns and for numpy arrays: the functions of a namespace N."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Arrays:
    """numpy arrays and floats."""

    sqrt, sin, cos, tan, asin, acos, atan, atan2 = np.sqrt, np.sin, np.cos, np.tan, np.arcsin, np.arccos, np.arctan, np.arctan2
    floor, abs, exp, log = np.floor, np.abs, np.exp, np.log

    @staticmethod
    def where(test, a, b):
        return np.where(test, a, b)

    @staticmethod
    def clip(x, low, high):
        return np.clip(x, low, high)

    @staticmethod
    def let(value, name: str = ""):
        return value

    @staticmethod
    def first(n: int, value, test):
        """The first of value(0) .. value(n - 1) that passes test, NaN if none does."""
        out = float("nan")
        for k in range(n - 1, -1, -1):
            out = np.where(test(value(k)), value(k), out)
        return out

    @staticmethod
    def iterate(rounds: int, start: dict, step):
        """start after rounds of step(state) -> state; a state may hold `stop`, where it stays as it is."""
        state = {k: np.asarray(v, float) + np.zeros(np.broadcast_shapes(*[np.shape(x) for x in start.values()])) for k, v in start.items()}
        with np.errstate(all="ignore"):
            stop = np.zeros(np.shape(next(iter(state.values()))), bool)
            for _ in range(rounds):
                new = step(state)
                end = new.pop("stop", False)
                state = {k: np.where(stop, state[k], v) for k, v in new.items()}
                stop = stop | end
                if np.all(stop):
                    break
        return state | {"stop": stop}


def _lifted(f):
    """f for columns and plain numbers."""
    return staticmethod(lambda *a: f(*[x if isinstance(x, Column) else F.lit(float(x)) for x in a]))


class Columns:
    """Spark columns. let() puts a value that is used more than once into a column of its own; run() adds all of them to a table, stage by stage.

    For short formulas: a filter on a result of many stages is pushed through all of them by repeating their expressions, so long ones belong in
    a task over arrays (stereo.over_cameras).
    """

    _number = itertools.count()
    sqrt, sin, cos, tan, asin, acos, atan, atan2, floor, abs, exp, log = map(_lifted, (F.sqrt, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2, F.floor, F.abs, F.exp, F.log))

    def __init__(self):
        self.stages: list[tuple[str, Column]] = []

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def clip(x, low, high):
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    @staticmethod
    def first(n: int, value, test):
        found = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value), test), F.lit(0))
        return F.coalesce(found, F.lit(float("nan")))

    def let(self, value, name: str = ""):
        if not isinstance(value, Column):
            return value
        name = name or f"_n{next(self._number)}"
        self.stages.append((name, value))
        return F.col(name)

    def iterate(self, rounds: int, start: dict, step):
        def fold(at, _):
            state = {k: at[k] for k in start}
            new = step(state)
            end = new.pop("stop", F.lit(False))
            parts = [F.when(at["stop"], state[k]).otherwise(new[k]).alias(k) for k in start]
            return F.struct(*parts, (at["stop"] | end).alias("stop"))

        first = F.struct(*[(F.lit(v) if not isinstance(v, Column) else v).cast("double").alias(k) for k, v in start.items()], F.lit(False).alias("stop"))
        end = self.let(F.aggregate(F.array_repeat(F.lit(0), rounds), first, fold))
        return {k: end[k] for k in [*start, "stop"]}

    def run(self, df: DataFrame, **out: Column) -> DataFrame:
        """df with the named results; the columns between are dropped. Spark keeps a stage apart where its value is used more than once."""
        names = [c for c in df.columns if c not in out]
        for name, value in self.stages:
            df = df.withColumn(name, value)
        return df.select(*names, *[v.alias(k) for k, v in out.items()])
