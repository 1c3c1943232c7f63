"""Models are loaded where they were saved for the same facts, and fitted anew otherwise."""

import shutil

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from siltstone.operators.learning import design, positive
from siltstone.sources.models import fitted, load_model, save_model


def rows(spark):
    return spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"), (F.col("id") % 7 + F.col("id") % 3 > 4).cast("double").alias("label"))


def test_a_saved_model_predicts_the_same(spark, tmp_path):
    df, path, fits = rows(spark), f"file://{tmp_path}/m", []

    def fit():
        fits.append(1)
        return Pipeline(stages=[*design(["x"], ["c"]), LogisticRegression(regParam=0.1)]).fit(df)

    facts = {"features": ["x", "c"], "cut": 0.75}
    assert load_model(spark, path) is None
    first = fitted(spark, path, fit, facts)
    again = fitted(spark, path, fit, facts)
    assert len(fits) == 1
    # a level that the fit has not seen is scored as well
    new = df.union(spark.createDataFrame([(999, 1.0, "unseen", 0.0)], df.schema))
    score = lambda m: {r["id"]: r["p"] for r in m.transform(new).select("id", positive().alias("p")).collect()}
    assert score(first) == pytest.approx(score(again)) and len(score(again)) == 201
    fitted(spark, path, fit, {**facts, "cut": 0.5})
    assert len(fits) == 2 and load_model(spark, path)[1]["cut"] == 0.5


def test_a_model_that_was_not_written_to_its_end_is_fitted_anew(spark, tmp_path):
    df, path = rows(spark), f"file://{tmp_path}/m"
    model = Pipeline(stages=[*design(["x"]), LogisticRegression(regParam=0.1)]).fit(df)

    class Broken:
        def write(self):
            raise OSError("disk")

    save_model(spark, path, model, {"a": 1})
    with pytest.raises(OSError):
        save_model(spark, path, Broken(), {"a": 2})
    assert load_model(spark, path) is None
    assert fitted(spark, path, lambda: model, {"a": 2}) is model and load_model(spark, path)[1] == {"a": 2}
    shutil.rmtree(tmp_path / "m")
    assert load_model(spark, path) is None
    with pytest.raises(ValueError):
        fitted(spark, path, lambda: model, {})
