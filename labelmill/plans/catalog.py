"""Named datasets, mappers and metric suites: lazy functions of a session, by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics


@dataclass
class Catalog:
    """Datasets by name; nothing is read before the DataFrame is used."""

    loaders: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    metadata: dict[str, dict[str, Any]] = field(default_factory=dict)
    mappers: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame], **meta: Any) -> None:
        if name in self.loaders:
            raise ValueError(f"{name} is registered already")
        self.loaders[name], self.metadata[name] = loader, dict(meta)

    def load(self, spark: SparkSession, name: str, view: bool = False) -> DataFrame:
        df = self.loaders[name](spark)
        if view:
            df.createOrReplaceTempView(name)
        return df

    def mapper(self, name: str, fn: Callable[..., DataFrame]) -> None:
        self.mappers[name] = fn

    def mapped(self, df: DataFrame, name: str, **cfg: Any) -> DataFrame:
        return df.transform(lambda d: self.mappers[name](d, **cfg))

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(n, k, str(v)) for n, meta in sorted(self.metadata.items()) for k, v in sorted(meta.items())]
        return spark.createDataFrame(rows, "dataset string, key string, value string")


#: Metric suites by evaluator type: functions of the inputs a caller gives.
SUITES: dict[str, tuple[str, ...]] = {"sem_seg": ("semantic",), "coco": ("average_precision",), "coco_panoptic_seg": ("panoptic", "semantic"), "ade20k_panoptic_seg": ("panoptic", "semantic")}


def evaluate(kind: str, inputs: Mapping[str, Any]) -> DataFrame:
    """(task, metric, value) of all metrics of an evaluator type.

    inputs: semantic = (confusion, void_index); panoptic = (stats, categories); average_precision = rows with ap, ar."""
    out = None
    for task in sorted(SUITES[kind]):
        if task == "semantic":
            row = metrics.semantic_suite(*inputs[task])
        elif task == "panoptic":
            row = metrics.pq_summary(*inputs[task]).filter("scope = 'All'").select("pq", "sq", "rq")
        else:
            row = inputs[task].selectExpr("avg(ap) as ap", "avg(ar) as ar")
        rows = metrics.long_metrics(row, task)
        out = rows if out is None else out.unionByName(rows)
    return out
