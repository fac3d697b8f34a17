"""Named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cohort import Cohort

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(cohort) -> DataFrame`` under an inventory name."""

    def wrap(fn: Callable[[Cohort], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Cohort(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def rnd(c: str | Column, digits: int, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    # Adding 0.0 turns a negative zero into a plain zero.
    out = F.round(col, digits) + F.lit(0.0)
    return out.alias(name or c) if name or isinstance(c, str) else out


def load_all() -> None:
    from . import queries_table  # noqa: F401  (defines shared CTEs, so it comes first)
    from . import queries_score  # noqa: F401
    from . import queries_more  # noqa: F401
    from . import queries_relate  # noqa: F401
    from . import queries_mixed  # noqa: F401
    from . import queries_meta  # noqa: F401
