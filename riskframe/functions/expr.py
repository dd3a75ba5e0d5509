"""Column-expression helpers shared by all operators (JVM-side, codegen-friendly)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c, lo=None, hi=None) -> Column:
    """Null-preserving clamp (ING2).  ``greatest``/``least`` skip nulls, so guard them."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def round_even(c, d: int = 0) -> Column:
    """Half-even rounding, matching NumPy/pandas ``round``."""
    return F.bround(col(c), d)


def to_double(c) -> Column:
    """String/number -> double, unparseable -> null (never raises under ANSI mode)."""
    return F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double")


def safe_div(a, b) -> Column:
    """a / b with a zero or null divisor giving null."""
    b = col(b)
    return F.when(b.isNull() | (b == 0), F.lit(None)).otherwise(col(a) / b)


# The literal spellings accepted as booleans by the upload paths.
BOOL_LITERALS = {
    "true": 1, "false": 0, "yes": 1, "no": 0, "y": 1, "n": 0,
    "1": 1, "0": 0, "1.0": 1, "0.0": 0, "t": 1, "f": 0,
}


def _bool_literal(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    trues = [k for k, v in BOOL_LITERALS.items() if v == 1]
    falses = [k for k, v in BOOL_LITERALS.items() if v == 0]
    return (F.when(s.isin(trues), F.lit(1))
             .when(s.isin(falses), F.lit(0)))


def coerce_boolean(c) -> Column:
    """HRM3: literal -> 0/1, else numeric > 0, else 0."""
    c = col(c)
    num = c.cast("string").try_cast("double")
    return F.coalesce(_bool_literal(c), F.when(num.isNotNull(), (num > 0).cast("int")), F.lit(0))


def coerce_flag(c, fallback) -> Column:
    """HRM19: null -> fallback; literal -> 0/1; numeric > 0; unparseable -> fallback."""
    c = col(c)
    fb = F.coalesce(col(fallback) if not isinstance(fallback, (int, float)) else F.lit(fallback), F.lit(0)).cast("int")
    num = c.cast("string").try_cast("double")
    return (F.when(c.isNull(), fb)
             .otherwise(F.coalesce(_bool_literal(c),
                                   F.when(num.isNotNull(), (num > 0).cast("int")),
                                   fb)))


def flag_was_defaulted(c) -> Column:
    """True where :func:`coerce_flag` fell back (null or unparseable)."""
    c = col(c)
    num = c.cast("string").try_cast("double")
    return c.isNull() | (_bool_literal(c).isNull() & num.isNull())


def pseudonymize(c, salt: str) -> Column:
    """ING1: first 16 hex chars of SHA-256(salt || id)."""
    return F.substring(F.sha2(F.concat(F.lit(salt), col(c).cast("string")), 256), 1, 16)


# --- keyed jitter (JIT1) -----------------------------------------------------
# A uniform draw in [0, 1) from md5(seed|name|copy|key): the first 8 hex digits
# as an unsigned 32-bit integer / 2^32.  Depends only on the row key, never on
# partitioning or row order, so every result is reproducible on any cluster.

def keyed_uniform(key, name: str, seed: int = 42, copy=None) -> Column:
    parts = [F.lit(str(seed)), F.lit(name), (col(copy).cast("string") if copy is not None else F.lit("0")),
             col(key).cast("string")]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_normal(key, name: str, mean: float = 0.0, sd: float = 1.0, seed: int = 42, copy=None) -> Column:
    """Box-Muller from two keyed uniforms."""
    return box_muller(keyed_uniform(key, name + "#u1", seed, copy), keyed_uniform(key, name + "#u2", seed, copy), mean, sd)


def box_muller(u1: Column, u2: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """A normal draw from two uniform ones in [0, 1)."""
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)  # 1 - u1 in (0, 1]
    return F.lit(mean) + F.lit(sd) * z


def keyed_lognormal(key, name: str, sigma: float, seed: int = 42, copy=None) -> Column:
    return F.exp(keyed_normal(key, name, 0.0, sigma, seed, copy))


def keyed_uniforms(key, names, seed: int = 42, copy=None) -> Column:
    """Many :func:`keyed_uniform` draws of a row as one array, in the order of ``names``.

    For rows with dozens of draws: as column expressions these outgrow what the JVM compiles, so they
    are hashed batch-wise in Python.
    """
    from pyspark.sql.functions import pandas_udf

    heads = [f"{seed}|{n}|".encode() for n in names]

    def draws(rows):
        import hashlib

        import numpy as np
        import pandas as pd
        starts, out = [hashlib.md5(h) for h in heads], bytearray()
        for row in rows:
            tail = row.encode()
            for start in starts:
                h = start.copy()
                h.update(tail)
                out += h.digest()[:4]
        return pd.Series(list(np.frombuffer(bytes(out), ">u4").reshape(-1, len(heads)) / 4294967296.0))

    tail = F.concat_ws("|", col(copy).cast("string") if copy is not None else F.lit("0"), col(key).cast("string"))
    return pandas_udf(draws, "array<double>")(tail)


def sql_keyed_uniform(key_sql: str, name: str, seed: int = 42, copy_sql: str = "'0'") -> str:
    """DuckDB twin of :func:`keyed_uniform` (for oracles)."""
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{name}', cast({copy_sql} AS varchar), "
            f"cast({key_sql} AS varchar))), 1, 8))::BIGINT / 4294967296e0)")
