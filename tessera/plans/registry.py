"""Collecting queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings roots files search_docs symbols chunks snapshot_manifests audit_records container_specs".split()
)


class Tables:
    """The given tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the given tables that the text names (as words after FROM or JOIN, or with a comma)."""
        used = {t: getattr(self, t) for t in TABLES if re.search(rf"\{{{t}\}}", text)}
        return self.spark.sql(text, **used)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of :class:`Tables` under a name, with its twin for DuckDB if SQL can express it."""

        def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return make

        return add

    def text(self, name: str, spark_sql: str, sql: str | None = None) -> None:
        """Register Spark SQL over ``{table}`` names; without ``sql`` the same text is the twin."""
        self.queries[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(spark_sql)
        self.sql[name] = re.sub(r"\{(\w+)\}", r"\1", spark_sql if sql is None else sql)
