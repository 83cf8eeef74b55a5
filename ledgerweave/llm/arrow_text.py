"""Arrow batches as flat byte buffers: the vectorised view that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the alphanumeric contract: digits, a-z after lower-casing, and every byte of a non-ASCII character.
ALNUM = np.ones(256, bool)
ALNUM[:0x80] = False
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column (compared as Spark does, without case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets (one more than rows); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row runs of about ``limit`` text bytes; a longer document makes a run of its own, whole."""
    data, offsets = buffers(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def annotate(docs: DataFrame, text: str, into: str, kind: T.StructType, fn: Callable, keep: list[str] | None = None) -> DataFrame:
    """Append a struct column ``into`` that ``fn(bytes, offsets) -> list of arrays`` makes, slice by slice.

    A narrow map without a shuffle. Only ``keep`` (all columns by default) and the text go to Python; the text comes
    back only if it is kept. An input column named ``into`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != into]
    own = fresh(docs.columns, "annotated_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(own))
    schema = T.StructType([*source.select(*[f"`{c}`" for c in names]).schema.fields, T.StructField(into, kind)])
    types = [_arrow_type(f.dataType) for f in kind.fields]
    labels = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, own):
                made = [pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(fn(data, offsets), types, strict=True)]
                struct = pa.StructArray.from_arrays(made, labels)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], struct], [*names, into])

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``member`` bytes; rows never share a run."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = member[data]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begins[both] = True
    finishes[both - 1] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words' bytes, mixed; the same word has the same hash everywhere."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = BYTE_KEYS[data[place + np.repeat(starts, lengths)]] * powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive values, by doubling; shorter input gives none."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, power, out, span, width = 0, BASE, None, values, 1
    while True:
        if size & width:
            out = span[: len(values)] if out is None else out[:n_of(len(values), done, width)] * power + span[done : done + n_of(len(values), done, width)]
            done += width
        if done == size:
            return out[:n]
        span = span[:-width] * power + span[width:]
        power = squared(power)
        width *= 2


def n_of(length: int, done: int, width: int) -> int:
    return length - done - width + 1


def range_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets; empty ranges give zero."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def squared(power: np.uint64) -> np.uint64:
    return np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
