"""Interfaces of models that score samples and of cleaning steps, with implementations that need no other process."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.functions.columns import scratch
from wayfare.functions.geo import norm3
from wayfare.operators import modes
from wayfare.settings import STUDY, Study


class Scorer(Protocol):
    def score(self, samples: DataFrame) -> DataFrame:
        """Samples (track, trip, id, t, x, y, z) with ``probs``, one probability per label of ``modes.LABELS``."""


class Cleaning(Protocol):
    def clean(self, predicted: DataFrame) -> DataFrame:
        """Predictions (track, id, t, mode, prob) with modes and probabilities replaced."""


class MajorityCleaning:
    """Repeated majority votes over ``n`` rows to either side."""

    def __init__(self, n: int = STUDY.clean_rows, rounds: int = STUDY.clean_rounds):
        self.n, self.rounds = n, rounds

    def clean(self, predicted: DataFrame) -> DataFrame:
        return modes.majority_vote(predicted, self.n, self.rounds)


class ByShake:
    """Probabilities from how far the acceleration's length is from gravity: a normal bell around each mode's usual
    distance, scaled to a sum of 1. All in built-in expressions; a stand-in for a trained model."""

    # The usual distances in m/s^2 by label.
    USUAL = {"walk": 2.5, "bike": 3.5, "car": 0.9, "bus": 1.4, "train": 0.5, "still": 0.1}

    def score(self, samples: DataFrame) -> DataFrame:
        beside = F.abs(norm3("x", "y", "z") - 9.81)
        bells = F.array(*[F.exp(-((beside - u) * (beside - u))) + 1e-9 for u in (self.USUAL[m] for m in modes.LABELS)])
        total = F.aggregate("bells", F.lit(0.0), lambda a, b: a + b)
        return samples.withColumn("bells", bells).withColumn("probs", F.transform("bells", lambda b: b / total)).drop("bells")


class ByFunction:
    """Scores each trip by a function of a pandas frame of its samples in order of time that returns one list of
    probabilities per row: what a model of another library, loaded once per worker, is plugged in by. One trip is held
    at a time. A result of another length is an error."""

    def __init__(self, function: Callable[[pd.DataFrame], list]):
        self.function = function

    def score(self, samples: DataFrame) -> DataFrame:
        function, columns = self.function, samples.columns

        def run(x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["t", "id"]).reset_index(drop=True)
            probs = list(function(x))
            if len(probs) != len(x):
                raise ValueError(f"{len(x)} samples but {len(probs)} predictions")
            return x.assign(probs=[[float(v) for v in p] for p in probs])[[*columns, "probs"]]

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", probs array<double>"
        return samples.groupBy("track", "trip").applyInPandas(run, schema)


class ByModel:
    """Scores by a Spark ML model, or the folder of one, whose ``probability`` is in the order of the labels; each
    sample's features are the transform of the ``width`` acceleration lengths from it on."""

    def __init__(self, model: object, width: int):
        self.model, self.width = model, width

    def score(self, samples: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        from wayfare.operators.features import haar
        from wayfare.operators.learning import load

        model = load(self.model) if isinstance(self.model, str) else self.model
        w = Window.partitionBy("track", "trip").orderBy("t", "id").rowsBetween(0, self.width - 1)
        x = samples.withColumn("norms", F.collect_list(norm3("x", "y", "z")).over(w)).where(F.size("norms") == self.width)
        x = model.transform(x.withColumn("features", array_to_vector(haar(F.col("norms"), self.width))))
        return x.withColumn("probs", vector_to_array("probability")).select(*samples.columns, "probs")


def predictions(scored: DataFrame) -> DataFrame:
    """(track, trip, id, t, mode, prob): the most probable mode of each scored sample."""
    best = modes.best_mode(F.col("probs"), list(modes.LABELS))
    return scored.select("track", "trip", "id", "t", best.alias("mode"), F.array_max("probs").alias("prob"))


def beside_by_position(samples: DataFrame, scores: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Samples, each with the row of ``scores`` of the same keys whose position ``at`` (from 0, in ``order``) is its own: for
    scores that come back without a time. A key with another number of scores than samples is an error when it is read."""
    x = samples.withColumn(at, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    one, two = scratch(samples, 2, also=tuple(scores.columns))
    both = x.withColumn(one, F.lit(True)).join(scores.withColumn(two, F.lit(True)), [*keys, at], "full")
    odd = F.when(F.col(one).isNull() | F.col(two).isNull(), F.raise_error(F.lit("samples and scores differ in number")).cast("boolean"))
    return both.where(F.coalesce(odd, F.lit(True))).drop(one, two)


def preview(df: DataFrame, n: int = 20) -> str:
    """The first ``n`` rows as text, and how many more there are."""
    rows, total = df.take(n), df.count()
    return "\n".join([*map(str, rows), *([f"... {total - n} more"] if total > n else [])])


def sum_vector(values: Column) -> Column:
    """An aggregate that collects doubles into a vector, nulls left out, in ascending order so that it does not depend on
    how partitions are merged."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.sort_array(F.collect_list(values.cast("double"))))


def guess(trips: DataFrame, study: Study = STUDY) -> DataFrame:
    """One stage over the whole trip, for trips without any prediction: (track, trip, mode, start_t, end_t, prob, model)."""
    return trips.select("track", "trip", F.lit(study.default_mode).alias("mode"), "start_t", "end_t", F.lit(0.1).alias("prob"), F.lit("guessed").alias("model"))
