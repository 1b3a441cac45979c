"""What the operators of this subpackage share: scratch tables, batches and numpy text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch

#: White space that parts words: space and the controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# --- tables -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a
    lost executor costs no more than the reading of a file."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the taken is, upper or lower case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body(x): a lambda variable isn't computed again
    for each use, as a shared subexpression inside of lambdas would be."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives no words. A split at one character is much quicker
    than one at a pattern."""
    for other in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def word_count(text: Column) -> Column:
    """Number of words as bigint; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


# --- batches ----------------------------------------------------------------


def text_parts(column: pa.Array, most: int):
    """Cut a string array into runs of rows of about `most` bytes of text, at least one row each.
    Yields (first row, rows, bytes as uint8, offsets from 0). Null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to - at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


# --- hashing ----------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _progression(base: np.uint64, n: int, name: str) -> np.ndarray:
    held = _powers.get(name)
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    np.cumprod(out, out=out)
    if n <= _BLOCK + 1:
        _powers[name] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over 64 bits (xor-shift and multiply); x is changed."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_table(fold_case: bool) -> np.ndarray:
    """A random 64-bit number for each byte; with fold_case A-Z have those of a-z."""
    t = np.random.default_rng(20240611).integers(0, 1 << 64, 256, np.uint64)
    if fold_case:
        t[65:91] = t[97:123]
    return t


RAW, FOLDED = byte_table(False), byte_table(True)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, tab: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end] for spans in order that don't overlap: differences of one
    running polynomial, block by block, so memory doesn't follow the length of the text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        n = int(ends[j - 1]) - lo
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(tab[raw[lo : lo + n]] * _progression(_P, _BLOCK if n <= _BLOCK else n, "p")[:n], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (run[e] - run[s]) * _progression(_P_INV, _BLOCK if n <= _BLOCK else n, "q")[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its first word (one
    more entry at the end). Words don't cross rows."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = _IS_SPACE[raw]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, space[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i+1]); empty rows give 0."""
    run = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]
