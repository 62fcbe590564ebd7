"""Quantile sketches: rank errors, merging, groups without values."""

from __future__ import annotations

import numpy as np
import pytest

from siltstone.operators import observe


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(3, 1, 60_000), np.full(20_000, 42.0)])  # one value is a quarter of all
    rows = [(int(i % 48), "a" if i % 5 else "b", float(v)) for i, v in enumerate(rng.permutation(x))]
    return spark.createDataFrame([*rows, (0, "none", None), (1, "none", None)], "hour int, mode string, value double").repartition(6).cache()


def rank_error(x: np.ndarray, at: float, q: float) -> float:
    """How far the wanted rank is from the ranks that a value has."""
    return max(0.0, (x < at).mean() - q, q - (x <= at).mean())


@pytest.mark.parametrize("by", [["mode"], []])
def test_merged_windows_keep_the_rank_error(values, by):
    hourly = observe.sketches(values, "value", ["mode", "hour"])
    found = observe.quantiles(observe.merged(hourly, by), [0.01, 0.5, 0.95, 0.999]).collect()
    assert len(found) == (8 if by else 4)
    every = values.where("value is not null").toPandas()
    for r in found:
        x = every[every["mode"] == r["mode"]].value.to_numpy() if by else every.value.to_numpy()
        assert r.n == len(x) and rank_error(x, r.value, r.q) <= observe.RANK_ERROR


def test_merging_twice_is_merging_once(values):
    hourly = observe.sketches(values, "value", ["mode", "hour"])
    twice = observe.merged(observe.merged(hourly, ["mode"]), [])
    x = values.where("value is not null").toPandas().value.to_numpy()
    r = observe.quantiles(twice, [0.95]).first()
    assert r.n == len(x) and rank_error(x, r.value, 0.95) <= observe.RANK_ERROR


def test_stored_sketches(spark, values, tmp_path):
    observe.sketches(values, "value", ["mode", "hour"]).write.parquet(str(tmp_path / "s"))
    again = observe.merged(spark.read.parquet(str(tmp_path / "s")), ["mode"])
    assert {r["mode"] for r in again.collect()} == {"a", "b"}


def test_groups_without_values(values):
    found = observe.quantiles(observe.sketches(values, "value", ["mode"]), [0.5]).where("mode = 'none'").first()
    assert found.n == 0 and found.value is None


def test_sketches_stay_small(values):
    from pyspark.sql import functions as F

    assert observe.sketches(values, "value", []).select(F.length("sketch")).first()[0] < 32 * observe.SKETCH
