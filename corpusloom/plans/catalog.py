"""All registered queries: name, Spark callable, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under a name, with the SQL that gives the same rows where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def _load() -> None:
    from corpusloom.plans import q_candidates, q_classify, q_corpus, q_dedup, q_distributions, q_evaluators, q_features, q_lexer, q_relational, q_text, q_tokens  # noqa: F401
    from corpusloom.streaming import buffered, streams  # noqa: F401


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: N802
    return queries()["growing_k_average_score"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
