"""Documents packed in chunks, and the search for content that occurs twice, for the operators on repeats.

A chunk is one row: a few megabytes of whole documents as one compressed blob. Chunks are written once
to the shared folder, so their numbers stay fixed whatever is recomputed later, and numpy works on a whole
chunk at a time. A chunk answers for itself first (equal hashes, equal strings), so a very common
line, word or passage reaches its bucket once per chunk, not once per occurrence.

Hashes go to buckets by their leading bits, about one bucket to a shuffle partition, so a chunk sends as many
rows however large the table is. It sends a bucket the sorted next 40 bits of its distinct hashes, and the bucket
returns a bit or more for each, in the same order. Minimisers are scrambled before they are dealt: being the
smallest of many hashes, they would crowd into the first buckets. A bucket is worked on in slices, so
that the memory beside what arrived does not grow with it.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import stored

CHUNK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: Hashes that a bucket counts together.
SLICE_HASHES = 1 << 19
#: A minimiser with a count above this (a chunk counts two if it has it twice) is hot: its windows are followed one by one.
HOT_COUNT = 1024
SPREAD = np.uint64(0xA0761D6478BD642F)
_LIBC: list = []
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def release() -> None:
    """Give memory that is free back to the system: workers live on, and keep it otherwise."""
    if not _LIBC:
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):
            _LIBC.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _LIBC[0](0)


def tidy(function: Callable) -> Callable:
    """A function of a group, or of a key and two groups, that leaves no free memory behind."""

    def of_group(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            release()

    def of_pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(key, left, right)
        finally:
            release()

    return of_group if function.__code__.co_argcount == 1 else of_pair


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; `expand` gives them back."""
    head = [np.array([len(arrays)], "<i4").tobytes()]
    for a in arrays:
        head.append(f"{a.dtype.str:<4}".encode() + np.array([a.nbytes], "<i8").tobytes())
    return _PACK.compress(b"".join(head + [np.ascontiguousarray(a).data for a in arrays if a.nbytes]))


def expand(blob: bytes) -> list[np.ndarray]:
    raw = _UNPACK.decompress(blob)
    n, out = int(np.frombuffer(raw, "<i4", 1)[0]), []
    at = 4 + 12 * n
    for k in range(n):
        kind, size = raw[4 + 12 * k : 8 + 12 * k].decode().strip(), int(np.frombuffer(raw, "<i8", 1, 8 + 12 * k)[0])
        out.append(np.frombuffer(raw, np.dtype(kind), size // np.dtype(kind).itemsize, at))
        at += size
    return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = "i8" if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else "i4"
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return offs - offs[0], body


def binary_array(lens: np.ndarray, data: np.ndarray) -> pa.Array:
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _packer(chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, number = [], 0, TaskContext.get().partitionId() << 40

    def flush() -> pa.RecordBatch:
        ids, known, weights, lens, body = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "size": pa.array([len(body)], pa.int64()), "blob": pa.array([squeeze(ids, known, weights, lens, body)], pa.binary())})

    for batch in batches:
        ids = batch.column(0)
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        weights = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        offs, body = bytes_of(batch.column(1))
        at = 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + chunk_bytes - size, "right")) - 1)
            held.append((ids[at:end], known[at:end], weights[at:end], np.diff(offs[at : end + 1]), body[offs[at] : offs[end]]))
            size += int(offs[end] - offs[at])
            at = end
            if size >= chunk_bytes or at < len(ids):
                yield flush()
                held, size, number = [], 0, number + sum(len(x[0]) for x in held)
    if held:
        yield flush()


def pack(docs: DataFrame, id_col: str, text_col: str, weight_col: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks (chunk, size, blob) of the documents, stored.

    A chunk's number is that of its first row, so number + place numbers all rows.
    """
    weight = F.col(weight_col) if weight_col else F.lit(1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), weight.cast("long").alias("weight"))
    return stored(rows.mapInArrow(partial(_packer, chunk_bytes), "chunk long, size long, blob binary"), "chunks")


class Chunk:
    """Ids (LAST for a null one), whether each is known, weights, byte offsets and bytes."""

    def __init__(self, blob: bytes):
        ids, known, self.weights, lens, self.data = expand(blob)
        self.known = known.astype(bool)
        self.ids = np.where(self.known, ids, LAST)
        self.offs = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=self.offs[1:])


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection); works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive units (uint64 values), by doubling."""
    base, parts, power, length = 0x9E3779B97F4A7C15, units, 0x9E3779B97F4A7C15, 1
    out, done, scale = None, 0, 1
    while True:
        if k & length:
            n = len(units) - done - length + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = parts[:n].copy() if out is None else out[:n] * np.uint64(power) + parts[done : done + n]
            done += length
        if done == k:
            return mixed(out)
        if len(parts) <= length:
            return np.zeros(0, np.uint64)
        parts = parts[:-length] * np.uint64(power) + parts[length:]
        length *= 2
        power = power * power & (2**64 - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def runs(hashes: np.ndarray, offs: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: start, number of windows and minimiser of each run of windows that share a minimiser.

    `hashes` are those of the k-grams of all units laid end to end; documents are cut at `offs`, and
    windows never cross a cut.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = int(offs[-1]) - window + 1
    if total <= 0:
        return none
    least = sliding_min(hashes, window - k + 1)
    fits = np.diff(offs) >= window
    if not fits.any():
        return none
    first, last = offs[:-1][fits], offs[1:][fits] - window + 1
    step = np.zeros(total + 1, np.int8)
    step[first] += 1
    step[last] -= 1
    change = np.ones(total, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[first] = True
    change &= np.cumsum(step[:-1], dtype=np.int8).view(bool)
    start = np.flatnonzero(change)
    limit = last[np.searchsorted(first, start, "right") - 1]
    end = np.minimum(np.append(start[1:], total), limit)
    return start, end - start, mixed(least[start])


def minimiser_places(hashes: np.ndarray, offs: np.ndarray, window: int, k: int) -> np.ndarray:
    """Places of k-grams that are the minimiser of a window (a run may hold several places with equal hashes)."""
    total, width = int(offs[-1]) - window + 1, window - k + 1
    if total <= 0:
        return np.zeros(0, np.int64)
    step = np.zeros(total + 1, np.int8)
    fits = np.diff(offs) >= window
    step[offs[:-1][fits]] += 1
    step[offs[1:][fits] - window + 1] -= 1
    pad = np.full(width - 1, ~np.uint64(0))
    least = np.where(np.cumsum(step[:-1], dtype=np.int8).view(bool), ~sliding_min(hashes, width), ~np.uint64(0))
    # Inverted, so that the smallest inverse is the largest minimum among the windows around a place.
    return np.flatnonzero(~sliding_min(np.concatenate([pad, least, pad]), width) == hashes)


def bucket_bits(chunks: DataFrame) -> int:
    """log2 of the number of buckets: about one to a shuffle partition, at any size of the table."""
    return min(24, math.ceil(math.log2(max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))


def cut(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted hashes, and the bounds of their slices."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[at], np.append(at, len(values))


def hash_rows(chunk: int, values: np.ndarray, twice: np.ndarray, bits: int) -> pa.RecordBatch:
    """What a chunk sends of its sorted distinct hashes: 40 bits each, and a bit for those it has twice itself."""
    buckets, at = cut(values, bits)
    low = (values >> np.uint64(24 - bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    blobs = [np.packbits(twice[a:b]).tobytes() + low[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int64()), "chunk": pa.array(np.full(len(buckets), chunk), pa.int64()), "n": pa.array(np.diff(at), pa.int64()), "data": pa.array(blobs, pa.binary())})


HASH_ROWS = "bucket long, chunk long, n long, data binary"
HASH_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
BIT_ROWS = "chunk long, bucket long, n long, data binary"
COUNT_ROWS = BIT_ROWS + ", entries long, lists double, most long"


def _counts(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the rows, and for each hash in them how many chunks have it (two for a chunk that has it twice; 65535 stands for more)."""
    sizes = group.column("n").to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    values, own = np.zeros(ends[-1], np.uint64), np.empty(ends[-1], np.uint8)
    wide = values.view(np.uint8).reshape(-1, 8)
    for n, end, data in zip(sizes.tolist(), ends.tolist(), group.column("data"), strict=True):
        raw, flags = data.as_buffer(), (n + 7) // 8
        own[end - n : end] = np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=n)
        wide[end - n : end, :5] = np.frombuffer(raw, np.uint8, offset=flags).reshape(n, 5)
    counts = np.empty(len(values), np.uint16)
    bits = max(0, math.ceil(math.log2(max(1, len(values) / SLICE_HASHES))))
    slices = (values >> np.uint64(40 - bits)).astype(np.uint16) if bits else None
    for k in range(1 << bits):
        where = np.flatnonzero(slices == k) if bits else np.arange(len(values))
        if len(where):
            mine = values[where]
            order = np.argsort(mine)
            ranked = mine[order]
            at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            total = np.minimum(np.add.reduceat(1 + own[where][order].astype(np.int64), at), 65535).astype(np.uint16)
            counts[where[order]] = np.repeat(total, np.diff(np.append(at, len(mine))))
    return sizes, counts


def answer_rows(classes: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    """For each hash of a bucket, bit by bit, whether its count exceeds each of `classes`; and with the first row, how many
    entries those above the first class have in the bucket, how many distinct ones there are, about, and the largest count."""

    @tidy
    def answer(group: pa.Table) -> pa.Table:
        sizes, counts = _counts(group)
        out, at = [], 0
        for n in sizes.tolist():
            mine = counts[at : at + n]
            out.append(b"".join(np.packbits(mine > c).tobytes() for c in classes))
            at += n
        shared = counts[counts > classes[0]]
        entries, lists, most = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.float64), np.zeros(len(sizes), np.int64)
        entries[0], lists[0], most[0] = len(shared), (1.0 / np.maximum(shared, 1)).sum(), counts.max(initial=0)
        return pa.table({"chunk": group.column("chunk").cast(pa.int64()), "bucket": group.column("bucket").cast(pa.int64()), "n": pa.array(sizes), "data": pa.array(out, pa.binary()), "entries": entries, "lists": lists, "most": most})

    return answer


def answer(hashes: DataFrame, classes: tuple[int, ...] = (1,)) -> DataFrame:
    """Answers (chunk, bucket, n, data, entries, lists, most) to rows of `hash_rows`, stored."""
    return stored(hashes.groupBy("bucket").applyInArrow(answer_rows(classes), COUNT_ROWS), "bits")


def known_repeats(chunks: DataFrame, hashes: Callable, hot_hashes: Callable, hot_count: int) -> DataFrame:
    """What chunks get to know (chunk, bucket, n, data, kind): of kind 0, which of their minimisers are repeated or hot; and,
    if any is hot, of kind 2, which windows of hot minimisers are repeated, by hashes of the whole windows."""
    answers = answer(chunks.mapInArrow(hashes, HASH_ROWS), (1, hot_count))
    known = answers.select("chunk", "bucket", "n", "data", F.lit(0).alias("kind"))
    if (answers.agg(F.max("most")).first()[0] or 0) <= hot_count:
        return known
    windows = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(hot_hashes, HASH_ROWS)
    return known.unionAll(answer(windows).select("chunk", "bucket", "n", "data", F.lit(2).alias("kind")))


def bit_rows(info: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    """The rows (bucket, n, data) of one kind, by bucket."""
    mine = info.filter(pc.equal(info.column("kind"), kind))
    return sorted(zip(mine.column("bucket").to_pylist(), mine.column("n").to_pylist(), mine.column("data").to_pylist(), strict=True))


def opened(start: np.ndarray, n: np.ndarray, least: np.ndarray, info: pa.Table, window_hashes: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (start, windows, minimiser), those that may repeat: whole ones, and of hot ones each window that does, under its own hash; by hash."""
    values, where = np.unique(least, return_inverse=True)
    kind = read_bits(bit_rows(info, 0), 2)[where] if len(values) else np.zeros(0, np.uint8)
    one, places = kind == 1, ragged(start[kind > 1], n[kind > 1])
    alone = np.zeros(0, np.uint64)
    if len(places):
        places = np.sort(places)
        alone = window_hashes(places)
        values, where = np.unique(alone, return_inverse=True)
        again = read_bits(bit_rows(info, 2))[where] > 0
        places, alone = places[again], alone[again]
    start, n, least = np.concatenate([start[one], places]), np.concatenate([n[one], np.ones(len(places), np.int64)]), np.concatenate([least[one], alone])
    order = np.argsort(least, kind="stable")
    return start[order], n[order], least[order]


def hot_places(start: np.ndarray, n: np.ndarray, least: np.ndarray, info: pa.Table) -> np.ndarray:
    """Starts of the windows of hot runs, ascending."""
    values, where = np.unique(least, return_inverse=True)
    hot = read_bits(bit_rows(info, 0), 2)[where] > 1 if len(values) else np.zeros(0, bool)
    return np.sort(ragged(start[hot], n[hot]))


def read_bits(rows: list[tuple[int, int, bytes]], classes: int = 1) -> np.ndarray:
    """The class (0 .. classes) of each of a chunk's sorted hashes, from (bucket, n, data) rows."""
    out = [np.zeros(0, np.uint8)]
    for _, n, data in sorted(rows):
        width = (n + 7) // 8
        out.append(sum(np.unpackbits(np.frombuffer(data, np.uint8, width, k * width), count=n) for k in range(classes)))
    return np.concatenate(out)


def refine(pointers: np.ndarray, shift: int) -> None:
    """Bucket-pointer refinement, in place: split each bucket by the bucket of the suffix `shift` later.

    pointers[i] is where the bucket of suffix i starts in sorted order. Only suffixes in buckets of two
    or more are sorted; a smaller bucket takes its place inside the one that it is split from, so pointers that
    are already refined serve the next, deeper comparison. The last `shift` suffixes stay as they are.
    """
    n = len(pointers)
    sizes = np.bincount(pointers, minlength=n)
    open_ = np.flatnonzero(sizes[pointers[: n - shift]] > 1) if n > shift else np.zeros(0, np.int64)
    if not len(open_):
        return
    key = pointers[open_] * n + pointers[open_ + shift]
    order = np.argsort(key)
    key = key[order]
    old = key // n
    place = np.arange(len(key))
    fresh = np.append(True, key[1:] != key[:-1])
    begun = np.append(True, old[1:] != old[:-1])
    inside = place - np.maximum.accumulate(np.where(begun, place, 0))
    inside = np.maximum.accumulate(np.where(fresh, place, 0)) - (place - inside)
    pointers[open_[order]] = old + inside


def first_pointers(values: np.ndarray) -> np.ndarray:
    """Bucket pointers of single values."""
    order = np.argsort(values)
    ranked = values[order]
    place = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), place, 0))
    return out


def slice_keys(values: np.ndarray, bits: int) -> np.ndarray:
    """The next 16 bits of sorted hashes after those of their bucket; equal hashes have equal keys."""
    return ((values >> np.uint64(48 - bits)) & np.uint64(0xFFFF)).astype(np.uint16)


def slices_of(keys: list[np.ndarray], loads: list[np.ndarray], limit: int) -> Iterator[list[tuple[int, int]]]:
    """Cut a bucket's rows, each sorted by key, at the same keys: slices of about `limit` load, or one key; a range of each row."""
    total = np.zeros(1 << 16, np.int64)
    for key, load in zip(keys, loads, strict=True):
        np.add.at(total, key, load)
    ends = np.cumsum(total)
    a = 0
    while a < len(total) and (done := int(ends[a - 1]) if a else 0) < ends[-1]:
        b = max(a + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield [(int(np.searchsorted(key, a)), int(np.searchsorted(key, b - 1, "right"))) for key in keys]
        a = b


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + lens[i] - 1 for all i, end to end."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """data[starts[i] : starts[i] + lens[i]] for all i, end to end; places are worked out for about `block` units at a time."""
    ends = np.cumsum(lens)
    out, a = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype), 0
    while a < len(lens):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + block, "right")))
        out[done : int(ends[b - 1])] = data[ragged(starts[a:b], lens[a:b])]
        a = b
    return out
