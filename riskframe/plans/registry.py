"""Query registry: each registered query is (spark, sf_dir) -> DataFrame plus its SQL oracle.

Doubles in every registered result are rounded half-even to 6 dp, and the
oracle wrapper applies DuckDB's ``round_even`` to the same columns, so the two
engines are compared on identical decimal values.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

FLOAT_DP = 6


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    floats: tuple = ()
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, floats=()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, tuple(floats), (fn.__doc__ or "").strip())
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round every double column to FLOAT_DP (half-even) for cross-engine comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.bround(F.col(f"`{f.name}`").cast("double"), FLOAT_DP).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish(REGISTRY[name].fn(spark, sf_dir))


def _round_sql(c: str) -> str:
    """DuckDB twin of ``bround(x, 6)``: half-even on the double's shortest decimal text
    (DuckDB's ``round_even`` on DOUBLE scales first and can create or break ties)."""
    x = f'CAST("{c}" AS DOUBLE)'
    exact = f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {FLOAT_DP}) AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN isfinite({x}) AND abs({x}) < 1e15 AND abs({x}) >= 1e-4 "
            f"THEN {exact} ELSE round_even({x}, {FLOAT_DP}) END")


def oracle_text(q: Query) -> str | None:
    if q.oracle is None:
        return None
    if not q.floats:
        return q.oracle
    rep = ", ".join(f'{_round_sql(c)} AS "{c}"' for c in q.floats)
    return f"SELECT * REPLACE ({rep}) FROM (\n{q.oracle}\n) AS _q"


def load_all() -> dict[str, Query]:
    # importing the catalogue modules fills REGISTRY
    from . import catalog_core, catalog_pricing, catalog_quality, catalog_ingest, catalog_harmonize, catalog_mappers, catalog_rollup, catalog_model, catalog_io  # noqa: F401
    return REGISTRY
