"""How a query and its DuckDB text are put on record together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segue.sources.fixtures import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Records the function under its own name; it gets the views."""

        def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql is not None:
                self.oracle[f.__name__] = with_views(sql)
            return f

        return put
