"""Name -> query registry: every query stands beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Registered queries and their oracle statements; a name may be registered once."""

    fns: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def deco(fn: QueryFn) -> QueryFn:
            if name in self.fns:
                raise ValueError(f"query {name!r} is registered twice")
            self.fns[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return deco

    def names(self) -> list[str]:
        return sorted(self.fns)

    def build(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        if name not in self.fns:
            raise KeyError(f"unknown query {name!r}; known: {', '.join(self.names())}")
        return self.fns[name](spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
