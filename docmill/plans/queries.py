"""The registered queries and their oracle SQL, by the numbers of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Source:
    """Tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    def dealt(self, name: str) -> DataFrame:
        """A table of few row groups dealt to many tasks by its key, for steps that take long for each row."""
        return self.t(name).repartition(views.tasks_of(self.spark, self.sf_dir, name), views.SPREAD[name])

    def v(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a :class:`Source` under a name, with its oracle if SQL can say it."""

    def register(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = partial(_run, f)
        if sql:
            ORACLE[name] = views.oracle(sql)
        return f

    return register


def _run(f: Callable[[Source], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return f(Source(spark, sf_dir))


from . import queries_checks, queries_matching, queries_sources, queries_stats, queries_stored, queries_text  # noqa: E402, F401
