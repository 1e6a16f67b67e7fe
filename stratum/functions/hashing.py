"""BLAKE2b-256 and unsigned 256-bit arithmetic as Arrow functions: Spark has neither."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

WORD = 1 << 256


@pandas_udf(StringType())
def blake2b(text: pd.Series) -> pd.Series:
    """Hexadecimal BLAKE2b of 32 bytes of a string in UTF-8, or of binary; null stays null."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode() if isinstance(t, str) else bytes(t), digest_size=32).hexdigest())


def _number(x: bytes | None) -> int:
    return int.from_bytes(x, "big") if x is not None else 0


def _word(x: int) -> bytes:
    return (x % WORD).to_bytes(32, "big")


@pandas_udf(BinaryType())
def uint256_add(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of big-endian 256-bit numbers; it wraps. Null counts as zero."""
    return pd.Series([_word(_number(x) + _number(y)) for x, y in zip(a, b, strict=True)])


@pandas_udf(BinaryType())
def uint256_sub(a: pd.Series, b: pd.Series) -> pd.Series:
    """Difference of big-endian 256-bit numbers; it wraps below zero."""
    return pd.Series([_word(_number(x) - _number(y)) for x, y in zip(a, b, strict=True)])


def uint256(value: Column) -> Column:
    """A non-negative long as a 256-bit number."""
    from pyspark.sql import functions as F

    return F.unhex(F.lpad(F.hex(value), 64, "0"))
