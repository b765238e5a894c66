"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import branch_queries, catalog_queries, change_queries, changeset_queries, curation_queries, merge_queries, record_queries, report_queries, source_queries, stream_queries, tree_queries
from .fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _bound(build: Callable[[Fixtures], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Fixtures(spark, sf_dir))

    run.__doc__ = build.__doc__
    return run


for _module in (report_queries, catalog_queries, tree_queries, source_queries, curation_queries, branch_queries, change_queries, stream_queries, record_queries, changeset_queries, merge_queries):
    for _name, (_build, _sql) in _module.REGISTERED.items():
        QUERIES[_name] = _bound(_build)
        if _sql:
            ORACLE_SQL[_name] = oracle(_sql)
