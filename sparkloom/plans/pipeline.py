"""The whole run: sources to the labelled dataset, failures and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from sparkloom.operators.classify import classify
from sparkloom.operators.dataset import deduplicate, with_ids
from sparkloom.operators.extract import failures, functions, parse
from sparkloom.operators.metrics import measure
from sparkloom.plans.schema import Thresholds


@dataclass
class Result:
    """``metrics`` has ids but no labels, so that other thresholds are a projection of it."""

    parsed: DataFrame
    metrics: DataFrame
    thresholds: Thresholds

    @property
    def methods(self) -> DataFrame:
        return classify(self.metrics, self.thresholds)

    @property
    def failures(self) -> DataFrame:
        return failures(self.parsed)

    def reclassified(self, thresholds: Thresholds) -> Result:
        return Result(self.parsed, self.metrics, thresholds)


def metrics_of(parsed: DataFrame) -> DataFrame:
    return with_ids(deduplicate(measure(functions(parsed))))


def analyze(sources: DataFrame, thresholds: Thresholds | None = None, partitions: int | None = None, persist: bool = True) -> Result:
    """Parses once; persisted frames spill to disk. Without sources the result is empty."""
    parsed = parse(sources, partitions)
    if persist:
        parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    metrics = metrics_of(parsed)
    return Result(parsed, metrics.persist(StorageLevel.MEMORY_AND_DISK) if persist else metrics, thresholds or Thresholds())
