"""Pairs of items that share a group, each pair once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.functions.packed import PACKED, by_block, columns, dealt, mixed, packed, pieces, unpacked

#: Lines in a partition, about. Partitions grow in number with the table, not in size.
PARTITION_LINES = 1 << 20


def _distinct(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each once."""
    if not len(src):
        return src, dst
    low, span = int(dst.min()), int(dst.max()) - int(dst.min()) + 1
    first, reach = int(src.min()), int(src.max()) - int(src.min()) + 1
    if span * reach < 1 << 62:
        keys = np.sort((src - first) * span + (dst - low))
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
        return keys // span + first, keys % span + low
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))
    return src[new], dst[new]


def _pairs(blocks: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, item in columns(batches, 1 << 62):  # a group is whole in its partition
            group, item = _distinct(group, item)
            at, step = np.arange(len(group)), 0
            while len(at):
                step += 1
                at = at[at + step < len(group)]
                at = at[group[at] == group[at + step]]
                for k in range(0, len(at), 1 << 20):
                    src, dst = item[at[k : k + (1 << 20)]], item[at[k : k + (1 << 20)] + step]
                    for block, found in pieces((mixed(src) % np.uint64(blocks)).astype(np.int32), src, dst):
                        yield packed(block, 0, *(x.astype("<i8") for x in found))

    return work


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in by_block(batches):
        held, size, limit = [], 0, 1 << 22
        for _, data in rows:
            held.append(unpacked(data, "<i8", "<i8"))
            size += len(held[-1][0])
            if size > limit:  # copies go before they fill the memory
                held = [_distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                limit = max(limit, 2 * size)
        src, dst = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for k in range(0, len(src), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(src[k : k + (1 << 16)], pa.int64()), pa.array(dst[k : k + (1 << 16)], pa.int64())], names=["src", "dst"])


def pairs(lines: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of the items that share a group, from lines (group, item) without nulls."""
    rows = lines.count()
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_LINES))
    group, item = lines.columns
    return dealt(lines.repartition(parts, group).mapInArrow(_pairs(parts), PACKED), parts, _gathered, "src long, dst long").select("src", "dst")
