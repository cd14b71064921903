"""Tuning with a deadline."""

import time

import pytest
from pyspark.sql import functions as F

from qforge.operators.gbt import fit as FIT


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id") % 20
    return spark.range(600).select("id", x.cast("double").alias("x"), (x * 3.0 + F.col("id") % 7).alias("y")).cache()


def _tune(rows, **how):
    return FIT.tune(rows, "y", ["x"], [0.5], n_trials=2, nfold=2, num_boost_round=2, early_stopping_rounds=2,
                    key_cols=["id"], trials_per_group=1, **how)


def test_groups_are_all_grown_when_there_is_time(rows):
    best, table, res = _tune(rows, timeout=600.0)
    found = {r.trial: r.score for r in table.collect()}
    assert sorted(found) == [0, 1]
    assert best == FIT.sample_params(2)[min(found, key=found.get)]
    assert min(b[5] for b in res.best) == min(found.values())


def test_finished_trials_decide_at_the_deadline(rows, monkeypatch):
    grow, calls = FIT.fit_models, []

    def slow_after_the_first(df, *args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            return grow(df, *args, **kwargs)
        # a job that would take minutes
        wait = F.pandas_udf(lambda s: (time.sleep(300), s)[1], "long")
        df.select(wait("id")).write.format("noop").mode("overwrite").save()

    monkeypatch.setattr(FIT, "fit_models", slow_after_the_first)
    start = time.monotonic()
    best, table, _ = _tune(rows, timeout=40.0)
    assert time.monotonic() - start < 120
    assert [r.trial for r in table.collect()] == [0] and best == FIT.sample_params(2)[0]
    assert rows.count() == 600  # later jobs of the session are not cancelled


def test_no_finished_trial_and_other_errors(rows, monkeypatch):
    with pytest.raises(TimeoutError):
        _tune(rows, timeout=0.01)

    def wrong(*args, **kwargs):
        raise ZeroDivisionError("own fault")

    monkeypatch.setattr(FIT, "fit_models", wrong)
    with pytest.raises(ZeroDivisionError):
        _tune(rows, timeout=600.0)
