"""Portable, layout-independent order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(id_col: str | Column, seed: int | str = 42) -> Column:
    """md5 of ``id:seed`` — the same 32 hex digits in every engine, so every draw can be checked."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def hash_int(text: Column, digits: int = 8) -> Column:
    """The first hex digits of md5 as a BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def unit_float(text: Column) -> Column:
    """A value in (0, 1) from md5: (h + 0.5) / 16^8."""
    return (hash_int(text, 8) + F.lit(0.5)) / F.lit(float(16**8))
