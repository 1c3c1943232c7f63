"""Fitted pipelines on storage that all machines share: saved with what they were fitted for, loaded where that still holds."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from siltstone.sources.tables import read_parameters, write_parameters


def save_model(spark: SparkSession, path: str, model: PipelineModel, facts: Mapping[str, object]) -> None:
    """The model under path/model, then its facts (features, cuts, thresholds; JSON values) under path/facts. The facts are
    taken away first and come last, so that a model that was not written to its end has none."""
    write_parameters(spark, f"{path}/facts", {})
    model.write().overwrite().save(f"{path}/model")
    write_parameters(spark, f"{path}/facts", facts)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, object]] | None:
    """The model and its facts; None where there is none, or none that was written to its end."""
    try:
        facts = read_parameters(spark, f"{path}/facts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (PipelineModel.load(f"{path}/model"), facts) if facts else None


def fitted(spark: SparkSession, path: str, fit: Callable[[], PipelineModel], facts: Mapping[str, object]) -> PipelineModel:
    """The saved model if it was saved with these facts, else a new fit, which is saved. Facts must name something."""
    if not facts:
        raise ValueError("a model without facts cannot be told from another")
    held = load_model(spark, path)
    if held is not None and held[1] == dict(facts):
        return held[0]
    model = fit()
    save_model(spark, path, model, facts)
    return model
