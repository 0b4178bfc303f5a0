"""Suffix-array deduplication of bytes by bucket-pointer refinement.

A byte goes if it is covered by a `window`-byte string that also starts in a document with a smaller
id; strings are judged on the input. Windows are compared exactly, in these steps:

1. Exact copies of a text are decided by the copy with the smallest id; only that one goes on.
2. Documents are packed in chunks; each window has a minimiser among its k-gram hashes, and a run of
   windows with one minimiser is one string. Minimisers that occur once anywhere cannot have a repeat.
3. The remaining strings travel, once per chunk, to the bucket of their minimiser. There the distinct strings
   that share a minimiser are sorted together: their suffixes are put in 8-gram buckets, which are refined by the
   buckets of later offsets (8, 16, then 18) to depth 50. Windows in one bucket are equal, and its smallest
   id is its owner.
4. Chunks get back owners that are smaller than their own and cut the covered bytes.

A string that many chunks have meets its bucket once per chunk. A minimiser with a count above `hot_count` is not
followed, as its bucket would get all surroundings of a common passage: hashes of its runs' whole windows are
counted in the same way, and windows that do repeat travel alone, each to the bucket of its hash. Buckets are worked on
in slices of minimisers, long texts in slices of windows.

Defined cases. Null text counts as empty: no bytes, no spans, the digest of nothing. Texts shorter than the
window stay whole. A null id comes after all others, and rows with equal ids never take bytes from one
another. Repeated rows give their rows again. Only the id and text columns are read.
Ids are whole numbers; ids of another type that do not read as such are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import chunks as C
from weft.llm.exact_dedup import split_copies

WINDOW, GRAM, Q = 50, 24, 8
#: Bytes whose suffixes are sorted together, and windows of a chunk that are hashed together.
SLICE_BYTES, SLICE_STARTS = 1 << 19, 1 << 20
ROWS = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _slices(chunk: C.Chunk) -> Iterator[tuple[int, int]]:
    """Ranges of window starts, SLICE_STARTS in each."""
    total = len(chunk.data) - WINDOW + 1
    yield from ((a, min(a + SLICE_STARTS, total)) for a in range(0, total, SLICE_STARTS))


def chunk_runs(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a chunk; a run ends where a slice does."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in _slices(chunk):
        data = chunk.data[a : b + WINDOW - 1]
        first, last = int(np.searchsorted(chunk.offs, a, "right")) - 1, int(np.searchsorted(chunk.offs, b + WINDOW - 1))
        offs = np.clip(chunk.offs[first : last + 1] - a, 0, len(data))
        start, n, least = C.runs(C.grams(data.astype(np.uint64), GRAM), offs, WINDOW, GRAM)
        out.append((start + a, n, least))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(chunk: C.Chunk, places: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at the (ascending) places."""
    out = [np.zeros(0, np.uint64)]
    for a, b in _slices(chunk):
        mine = places[np.searchsorted(places, a) : np.searchsorted(places, b)]
        if len(mine):
            out.append(C.grams(chunk.data[a : b + WINDOW - 1].astype(np.uint64), WINDOW)[mine - a])
    return C.mixed(np.concatenate(out) ^ C.SPREAD)


def _hashes(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, counts = np.unique(chunk_runs(C.Chunk(blob.as_py()))[2], return_counts=True)
                yield C.hash_rows(number, values, counts > 1, bits)
                C.release()

    return send


def _hot_hashes(bits: int):
    @C.tidy
    def send(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
        if not chunk.num_rows or not info.num_rows:
            return C.HASH_ARROW.empty_table()
        c = C.Chunk(chunk.column("blob")[0].as_py())
        values, counts = np.unique(window_hashes(c, C.hot_places(*chunk_runs(c), info)), return_counts=True)
        return pa.Table.from_batches([C.hash_rows(key[0].as_py(), values, counts > 1, bits)])

    return send


class Strings:
    """The distinct strings of a chunk whose minimisers occur twice, in order of minimiser (of window hash, if it is hot)."""

    def __init__(self, blob: bytes, info: pa.Table):
        self.chunk = chunk = C.Chunk(blob)
        self.start, self.n, least = C.opened(*chunk_runs(chunk), info, lambda places: window_hashes(chunk, places))
        self.doc = np.searchsorted(chunk.offs, self.start, "right") - 1
        lens = self.n + WINDOW - 1
        coded = C.binary_array(lens, C.gather(chunk.data, self.start, lens)).dictionary_encode()
        self.string = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        seen = np.unique(self.string, return_index=True)[1]
        self.least, self.windows = least[seen], self.n[seen]
        self.owner = np.full(len(seen), C.LAST)
        np.minimum.at(self.owner, self.string, chunk.ids[self.doc])


def _send_strings(bits: int):
    @C.tidy
    def send(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "data": []}
        if chunk.num_rows and info.num_rows:
            s = Strings(chunk.column("blob")[0].as_py(), info)
            buckets, at = C.cut(s.least, bits)
            keys = C.slice_keys(s.least, bits)
            offs, body = C.bytes_of(s.distinct)
            for bucket, a, b in zip(buckets.tolist(), at[:-1], at[1:], strict=True):
                rows["bucket"].append(bucket)
                rows["chunk"].append(key[0].as_py())
                rows["data"].append(C.squeeze(s.owner[a:b], np.diff(offs[a : b + 1]).astype(np.int32), np.diff(keys[a:b], prepend=np.uint16(0)), body[offs[a] : offs[b]]))
        return pa.table(rows, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())]))

    return send


def window_buckets(data: np.ndarray) -> np.ndarray:
    """Pointers of the suffixes of `data` by their first WINDOW bytes (those that have as many)."""
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    eight = padded.astype(np.uint64)
    for width in (1, 2, 4):
        eight = (eight[:-width] << np.uint64(8 * width)) | eight[width:]
    pointers = C.first_pointers(eight)
    for shift in (Q, 2 * Q, WINDOW - 4 * Q):
        C.refine(pointers, shift)
    return pointers


def owners(lens: np.ndarray, data: np.ndarray, owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of each window of distinct strings: (windows per string, owner of each window, end to end).

    Strings of different keys have no window in common.
    """
    windows = lens - (WINDOW - 1)
    best = np.repeat(owner, windows)
    mine = np.flatnonzero(np.bincount(key)[key] > 1)  # a string alone with its key equals no other
    if len(mine):
        starts, place = np.cumsum(lens) - lens, np.cumsum(windows) - windows
        pointers = window_buckets(data[C.ragged(starts[mine], lens[mine])])
        pointers = pointers[C.ragged(np.cumsum(lens[mine]) - lens[mine], windows[mine])]
        where = C.ragged(place[mine], windows[mine])
        order = np.argsort(pointers)
        ranked = pointers[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        low = np.minimum.reduceat(best[where][order], at)
        best[where[order]] = np.repeat(low, np.diff(np.append(at, len(ranked))))
    return windows, best


def _told(own: np.ndarray, lens: np.ndarray, key: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings end to end: those with a window whose owner is before their own, and the owners of their windows as runs.

    Returns places of the strings, the number of runs of each, and all runs' lengths and owners.
    """
    coded = C.binary_array(lens, data).dictionary_encode()
    string = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offs, data = C.bytes_of(coded.dictionary)
    owner, keys = np.full(len(coded.dictionary), C.LAST), np.zeros(len(coded.dictionary), np.int64)
    np.minimum.at(owner, string, own)
    keys[string] = key
    windows, best = owners(np.diff(offs), data, owner, keys)
    begin = np.cumsum(windows) - windows
    told = np.flatnonzero(np.minimum.reduceat(best, begin)[string] < own)
    n = windows[string[told]]
    values = best[C.ragged(begin[string[told]], n)]
    edge = np.append(True, values[1:] != values[:-1])[: len(values)]
    edge[np.cumsum(n) - n] = True
    place = np.flatnonzero(edge)
    count = np.add.reduceat(edge, np.cumsum(n) - n, dtype=np.int64) if len(n) else np.zeros(0, np.int64)
    return told, count, np.diff(np.append(place, len(values))), values[place]


@C.tidy
def _answer(group: pa.Table) -> pa.Table:
    """Per chunk that has any: its strings with windows owned before its own, and those owners as runs."""
    own, lens, keys, body = (list(x) for x in zip(*(C.expand(x) for x in group.column("data").to_pylist()), strict=True))
    keys = [np.cumsum(k, dtype=np.uint16) for k in keys]
    offs = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in lens]
    out: list[list] = [[] for _ in own]
    for ranges in C.slices_of(keys, lens, SLICE_BYTES):
        mine = [(r, a, b) for r, (a, b) in enumerate(ranges) if b > a]
        pick = lambda x, mine=mine: np.concatenate([x[r][a:b] for r, a, b in mine])
        data = np.concatenate([body[r][offs[r][a] : offs[r][b]] for r, a, b in mine])
        told, count, length, value = _told(pick(own), pick(lens).astype(np.int64), pick(keys), data)
        ends = np.cumsum([b - a for _, a, b in mine])
        cuts = np.searchsorted(told, ends)
        runs = np.append(0, np.cumsum(count))[np.append(0, cuts)]
        for k, (r, a, b) in enumerate(mine):
            x, y = (int(cuts[k - 1]) if k else 0), int(cuts[k])
            if y > x:
                out[r].append((told[x:y] - (ends[k] - (b - a)) + a, count[x:y], length[runs[k] : runs[k + 1]], value[runs[k] : runs[k + 1]]))
    some = [r for r, parts in enumerate(out) if parts]
    blobs = [C.squeeze(*(np.concatenate(x).astype(kind) for x, kind in zip(zip(*out[r], strict=True), ("<i4", "<i4", "<i4", "<i8"), strict=True))) for r in some]
    pick = pa.array(some, pa.int64())
    return pa.table({"chunk": group.column("chunk").take(pick).cast(pa.int64()), "bucket": group.column("bucket").take(pick).cast(pa.int64()), "n": pa.array([len(own[r]) for r in some], pa.int64()), "data": pa.array(blobs, pa.binary())})


def spans_of(covered: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal covered runs inside documents, and each run's document."""
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(covered))]
    inner = np.unique(inner[covered[inner - 1] & covered[inner]]) if len(inner) else inner
    start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return start, end, np.searchsorted(offs, start, "right") - 1


@C.tidy
def _cut(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
    """A chunk's documents with the covered bytes cut."""
    blank = pa.table({n: [] for n in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}, schema=pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary())]))
    if not chunk.num_rows:
        return blank
    blob = chunk.column("blob")[0].as_py()
    if info.num_rows:
        s = Strings(blob, info)
        c, mark = s.chunk, np.zeros(len(s.chunk.data) + 1, np.int32)

        def cover(start: np.ndarray, n: np.ndarray) -> None:
            np.add.at(mark, start, 1)
            np.add.at(mark, start + n + WINDOW - 1, -1)

        split, bits = np.zeros(len(s.distinct), bool), chunk.column("bits")[0].as_py()
        begin = dict(zip(*(x.tolist() for x in C.cut(s.least, bits)), strict=False))
        n_runs, first_run = np.zeros(len(split), np.int64), np.zeros(len(split), np.int64)
        lens, values, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for bucket, _, data in C.bit_rows(info, 1):
            which, count, length, value = C.expand(data)
            which = which + begin[bucket]
            split[which], n_runs[which], first_run[which] = True, count, runs + np.cumsum(count) - count
            lens.append(length.astype(np.int64))
            values.append(value)
            runs += len(length)
        lens, values = np.concatenate(lens), np.concatenate(values)
        ids = c.ids[s.doc]
        plain = ~split[s.string]
        gone = plain & (s.owner[s.string] < ids)
        cover(s.start[gone], s.n[gone])
        own = np.flatnonzero(~plain)
        count = n_runs[s.string[own]]
        which = C.ragged(first_run[s.string[own]], count)
        length = lens[which]
        ends = np.cumsum(length)
        base = np.cumsum(count) - count
        offset = ends - length - np.repeat((ends - length)[base] if len(base) else ends, count)
        gone = values[which] < np.repeat(ids[own], count)
        cover((np.repeat(s.start[own], count) + offset)[gone], length[gone])
        covered = np.cumsum(mark[:-1]) > 0
    else:
        c = C.Chunk(blob)
        covered = np.zeros(len(c.data), bool)
    start, end, doc = spans_of(covered, c.offs)
    removed = np.bincount(doc, end - start, len(c.ids)).astype(np.int64)
    n_spans = np.bincount(doc, minlength=len(c.ids))
    keep = c.data[~covered].tobytes()
    kept_offs = c.offs - np.concatenate([[0], np.cumsum(removed)])
    first = np.concatenate([[0], np.cumsum(n_spans)])
    body = np.stack([start, end], 1) - c.offs[doc][:, None] if len(doc) else np.zeros((0, 2), np.int64)
    out = {
        "id": pa.array(c.ids, pa.int64(), mask=~c.known),
        "n_bytes": pa.array(np.diff(c.offs), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(keep[a:b]).hexdigest() for a, b in zip(kept_offs[:-1], kept_offs[1:], strict=True)], pa.string()),
        "spans": pa.array([body[a:b].astype("<i8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
    }
    return pa.table(out, schema=blank.schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES, hot_count: int = C.HOT_COUNT) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and spans (binary: little-endian int64 start, end pairs)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    firsts, copies = split_copies(rows, "id", "text", keep="min")
    chunks = C.pack(firsts, "id", "text", chunk_bytes=chunk_bytes)
    bits = C.bucket_bits(chunks)
    chunks = chunks.select("chunk", "blob", F.lit(bits).alias("bits"))
    known = C.known_repeats(chunks, _hashes(bits), _hot_hashes(bits), hot_count)
    grouped = chunks.groupBy("chunk")
    strings = grouped.cogroup(known.groupBy("chunk")).applyInArrow(_send_strings(bits), "bucket long, chunk long, data binary")
    told = strings.groupBy("bucket").applyInArrow(_answer, C.BIT_ROWS).withColumn("kind", F.lit(1))
    cut = grouped.cogroup(known.unionAll(told).groupBy("chunk")).applyInArrow(_cut, ROWS)
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    gone = F.col("n_bytes") >= WINDOW
    ends = F.when(gone, F.concat(_le64(F.lit(0)), _le64(F.col("n_bytes")))).otherwise(F.lit("").cast("binary"))
    left = F.when(gone, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    whole = copies.select("id", "text", n.alias("n_bytes")).select("id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.sha2(left.cast("binary"), 256).alias("kept_sha256"), ends.alias("spans"))
    return cut.unionAll(whole).withColumnRenamed("id", id_col)


def _le64(value: Column) -> Column:
    """A number as 8 bytes, little-endian."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda k: F.substring(F.lpad(F.hex(value), 16, "0"), k * 2 - 1, F.lit(2))), ""))
