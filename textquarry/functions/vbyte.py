"""Variable-byte code: seven bits a byte, the high bit on the last one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def encode(numbers) -> bytes:
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("only numbers from zero")
        low = [(n & 127) | 128]
        n >>= 7
        while n:
            low.append(n & 127)
            n >>= 7
        out += bytes(reversed(low))
    return bytes(out)


def decode(data: bytes) -> list[int]:
    out, n = [], 0
    for byte in data:
        n = (n << 7) | (byte & 127)
        if byte & 128:
            out.append(n)
            n = 0
    return out


def vbyte_encode(numbers: Column) -> Column:
    
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode(int(v) for v in x) for x in s], dtype=object)

    return F.pandas_udf(run, "binary")(numbers)


def vbyte_decode(data: Column) -> Column:
    
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(bytes(x)) for x in s], dtype=object)

    return F.pandas_udf(run, "array<long>")(data)
