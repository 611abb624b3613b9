"""Counter-based random numbers: a hash of a seed and key columns, the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct values of `bits`.
SPAN = 1 << 52


def bits(seed: int | Column, *keys) -> Column:
    """A 52-bit draw as a long. A column of seeds gives the draws that each seed alone gives."""
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *keys) -> Column:
    """A double in [0, 1)."""
    return bits(seed, *keys) / F.lit(float(SPAN))


def integer(n, seed: int, *keys) -> Column:
    """A long in [0, n)."""
    return F.pmod(bits(seed, *keys), n if isinstance(n, Column) else F.lit(n))


def bits_sql(seed: int, *keys: str) -> str:
    """The same draw as DuckDB SQL."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 13))::BIGINT"
