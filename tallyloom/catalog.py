"""Registries of datasets and benchmarks, and both as DataFrames."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Registry(dict):
    """Names to objects; a name is registered once, and an unknown one is told with the nearest."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind, self.weak, self.by_default = kind, set(), False

    @contextmanager
    def defaults(self):
        """What is registered meanwhile gives way to what is registered later under its name, and to what is there."""
        self.by_default = True
        try:
            yield self
        finally:
            self.by_default = False

    def register(self, name: str, value=None):
        def put(x):
            if self.by_default:
                if name not in self:
                    self.weak.add(name)
                    self[name] = x
                return x
            if name in self and name not in self.weak:
                raise KeyError(f"{self.kind} {name!r} is registered already")
            self.weak.discard(name)
            self[name] = x
            return x

        return put if value is None else put(value)

    def find(self, name: str):
        if name in self:
            return self[name]
        near = difflib.get_close_matches(name, self, 3)
        raise KeyError(f"unknown {self.kind} {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


@dataclass(frozen=True)
class Dataset:
    """A dataset: `build(spark, split, cap)` gives records."""

    name: str
    build: Callable = field(repr=False)
    splits: tuple[str, ...] = ("train",)
    area: str = ""
    license: str = ""
    eval_only: bool = False
    multimodal: bool = False
    version: int = 1
    description: str = ""


@dataclass(frozen=True)
class Benchmark:
    """A split of a dataset with a metric; suites name several."""

    name: str
    dataset: str
    split: str = "test"
    metric: str = "accuracy"
    area: str = ""
    suite: str = ""
    max_samples: int | None = None


DATASETS = Registry("dataset")
BENCHMARKS = Registry("benchmark")


def expanded(names: list[str]) -> list[Benchmark]:
    """Benchmarks by name or suite, in order, each once."""
    out: dict[str, Benchmark] = {}
    for name in names:
        suite = [b for b in BENCHMARKS.values() if b.suite == name]
        for b in suite or [BENCHMARKS.find(name)]:
            out.setdefault(b.name, b)
    return list(out.values())


def check_trainable(names: list[str]) -> None:
    """Datasets that are for evaluation only are an error."""
    for name in names:
        if not name.endswith(".jsonl") and DATASETS.find(name).eval_only:
            raise ValueError(f"dataset {name!r} is for evaluation only")


def catalog(spark: SparkSession, what: Registry) -> DataFrame:
    rows = [{k: v if isinstance(v, str | int | bool | None) else ",".join(v) for k, v in asdict(x).items() if k != "build"} for x in what.values()]
    kinds = {"eval_only": "boolean", "multimodal": "boolean", "version": "int", "max_samples": "int"}
    names = [f for f in (Dataset if what is DATASETS else Benchmark).__dataclass_fields__ if f != "build"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
