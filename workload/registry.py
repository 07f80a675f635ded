"""Query registry: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.lines import mate_lines, vcf_lines
from workload.views import VIEWS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SQL_VIEWS = {**VIEWS, "vcf": vcf_lines(), "mates": mate_lines()}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Driver tables and the shared views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = SQL_VIEWS[name]
        for t in TABLES:
            if f"from {t}" in sql:
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(sql)

    def spread(self, name: str) -> DataFrame:
        """A view whose rows feed heavy per-row work: a table of fewer splits than cores is dealt out before it is derived."""
        sql, cores = SQL_VIEWS[name], self.spark.sparkContext.defaultParallelism
        for t in TABLES:
            if f"from {t}" in sql:
                rows = self.table(t)
                if rows.rdd.getNumPartitions() < cores:
                    rows = rows.repartition(cores)
                rows.createOrReplaceTempView(t)
        return self.spark.sql(sql)

    def sql(self, text: str, *views: str) -> DataFrame:
        for v in views:
            self.view(v).createOrReplaceTempView(v)
        return self.spark.sql(text)


def with_views(body: str, *views: str) -> str:
    """Oracle SQL: the shared views as common table expressions in front of ``body``."""
    ctes = ", ".join(f"{v} as ({SQL_VIEWS[v]})" for v in views)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):]}" if ctes else body
    if body.lower().startswith("with"):
        return f"with {ctes}, {body[len('with'):]}" if ctes else body
    return f"with {ctes} {body}" if ctes else body


def query(name: str, oracle: str | None = None):
    """Register a query written over ``Source``."""

    def wrap(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
