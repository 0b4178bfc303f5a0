"""Rows of numbers packed in binary: many numbers travel as one row, and numpy works on them where they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A packed row: where it goes, what it is, and its numbers.
PACKED = "block int, kind int, data binary"
#: Numbers gathered before they are dealt out, and bytes in a packed row, at most.
GATHERED, ROW_BYTES = 1 << 21, 1 << 20


def packed(block: int, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One packed row; the arrays follow one another, after their lengths in bytes."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    data = b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], names=["block", "kind", "data"])


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<i8", 1 + len(types))[1:]
    starts = 8 * (1 + len(types)) + np.cumsum(sizes) - sizes
    return [np.frombuffer(data, t, int(n) // np.dtype(t).itemsize, int(at)) for t, n, at in zip(types, sizes, starts, strict=True)]


def columns(batches: Iterator[pa.RecordBatch], at_least: int = GATHERED) -> Iterator[list[np.ndarray]]:
    """Columns of numbers in larger pieces than they come."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_least:
            yield _joined(held)
            held, rows = [], 0
    if rows:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [table.column(i).to_numpy() for i in range(table.num_columns)]


def pieces(of: np.ndarray, *arrays: np.ndarray, width: int = 16) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(value, rows of that value) in ascending order of `of`, in pieces that fit a packed row of `width` bytes a number."""
    order = np.argsort(of, kind="stable")
    of, arrays = of[order], [a[order] for a in arrays]
    ends = [*np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else []
    start, most = 0, ROW_BYTES // width
    for end in ends:
        for a in range(start, end, most):
            yield int(of[start]), [x[a : min(end, a + most)] for x in arrays]
        start = end


def by_block(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(block, its rows (kind, data)) of packed rows that are sorted by block; each block's rows must be used up before the next."""
    flat = ((b, k, d) for batch in rows for b, k, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
    row = next(flat, None)
    while row is not None:
        block = row[0]

        def mine() -> Iterator[tuple[int, bytes]]:
            nonlocal row
            while row is not None and row[0] == block:  # noqa: B023
                yield row[1], row[2]
                row = next(flat, None)

        yield block, mine()


def dealt(rows: DataFrame, blocks: int, work: Callable, schema: str = PACKED) -> DataFrame:
    """`work` on packed rows once they are in their block's partition, sorted by block and kind."""
    return rows.repartitionById(max(1, blocks), "block").sortWithinPartitions("block", "kind").mapInArrow(work, schema)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits, each to its own."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
