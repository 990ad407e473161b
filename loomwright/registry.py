"""Every query by its name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.sources.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def statement(name: str, sql: str) -> None:
    """A query that is one SQL statement, in the common dialect of sources.tables."""
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(sql)
    ORACLES[name] = oracle(sql)


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables, with the statement it must agree with, if SQL has one."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


from loomwright.plans import code, graph, memory, more, relational, retrieval, streams, texts  # noqa: E402, F401  they register themselves
