"""Registry of the queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans.sql_views import with_views
from colloquy.sources.corpus import Corpus, corpus


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Corpus], DataFrame]
    check: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(corpus(spark, sf_dir))

    @property
    def sql(self) -> str | None:
        """The check with all the views it uses in front."""
        return with_views(self.check) if self.check else None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the decorated function(corpus) under its own name.

    `covers` lists the inventory entries it implements; `sql` may use the views of sql_views.
    """

    def register(build):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), build, sql)
        return build

    return register
