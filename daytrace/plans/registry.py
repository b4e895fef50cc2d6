"""Registry of queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace.plans import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Context:
    """What a query works on: the session, the table folder, and the sample day plan."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        from daytrace.sources import telemetry as tm
        from daytrace.sources.session import tune
        from daytrace.sources.tables import read

        self.spark, self.sf_dir = tune(spark), sf_dir
        self.table = lambda name: read(spark, sf_dir, name)
        self.plan = tm.sample_plan(spark, sf_dir)

    @property
    def events(self) -> DataFrame:
        return self.plan.events


def flat(df: DataFrame) -> DataFrame:
    """Dates as text and arrays as comma-joined text, so that results compare across engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(",", c.cast("array<string>"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``build(context)`` under ``name``; ``sql`` is its equivalent, if SQL can say it."""

    def add(build: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: flat(build(Context(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle.compose(sql)
        return build

    return add
