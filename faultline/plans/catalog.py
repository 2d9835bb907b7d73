"""Registry of named queries: a Spark plan and, where one exists, its SQL oracle.

Query names follow the operator IDs of the blueprint (``x5_line_classify``,
``w6_repeat_buckets``...). Every query reads the driver tables (or adapters
derived from them) and runs over the whole input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _utc(fn: QueryFn) -> QueryFn:
    """Timestamps in the driver tables are zone-less: pin the session zone to UTC.
    Shuffled data is read by about four tasks a core: as many tasks as cores leave one over, for which all others wait.
    Intermediates persisted by the previous query are released first."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import ship_package
        from .filter import release
        release()  # caches of the previous query
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(4 * spark.sparkContext.defaultParallelism))
        return fn(spark, sf_dir)
    return run


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = _utc(fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their registrations run."""
    from . import q_lines, q_sessions  # noqa: F401
    for mod in ("q_structural", "q_render", "q_ingest", "q_graph", "q_stream", "q_prompts"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if mod not in str(exc):
                raise
