"""64-bit mixing and word hashes for Arrow tasks, and document keys for plans."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = (np.uint64(n) for n in (30, 27, 31, 11))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.copy()
    x ^= x >> _S30
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from 64-bit hashes."""
    return ((x >> _S11).astype(np.float64) + 1.0) * 2.0**-53


# A random number for each byte at each of the first places of a word, which are a power of two.
_PLACES = 64
_BYTE_AT = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * GOLDEN)
# Words hashed together, which bounds the memory that a long text takes.
_HASHED = 1 << 15


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, none of them empty: the mixed sum of their bytes' numbers."""
    if len(words) > _HASHED:
        return np.concatenate([word_hashes(words[i : i + _HASHED]) for i in range(0, len(words), _HASHED)])
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    sizes = np.diff(np.append(starts, len(data) + 1))
    place = np.arange(len(data)) - np.repeat(starts, sizes)[: len(data)]
    numbers = _BYTE_AT.take((place & _PLACES - 1) << 8 | data)
    if sizes.max() > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        numbers[far] = mix(numbers[far] + (place[far] // _PLACES).astype(np.uint64) * GOLDEN)
    numbers[gaps] = 0
    return mix(np.add.reduceat(numbers, starts) ^ sizes.astype(np.uint64))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; fewer than k words make one shorter run."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64) * GOLDEN
    for i in range(k):
        out = (out ^ h[i : i + n]) * _M1 + (out >> _S31)
    return mix(out)


def let_go() -> None:
    """Give memory that a task does not need any more back to the system: workers live on and are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(text_or_empty(column)))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
