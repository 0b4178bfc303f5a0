"""Substring deduplication by super-k-mer partitioning of words.

A word goes if it is covered by a window of `WINDOW` words whose word sequence also starts anywhere else, in
the same document or another; windows are judged on the input. Consecutive windows that share a minimiser (the
smallest hash of their word k-grams) travel as one packed string to the minimiser's bucket, where the windows
of all strings are sorted and counted exactly, word by word:

1. Of exact copies one text goes on, carrying the number of its copies; the others are decided by their length.
2. Documents are packed in chunks and words are joined by single spaces. Minimisers that occur once
   anywhere cannot have a repeat, so their strings stay at home.
3. The remaining strings travel once per chunk with the number of times that the chunk has them. The bucket
   numbers distinct words, sorts windows by doubling (1, 2, 4, 8, 16, then 3 words on) and adds up equal ones.
4. Chunks get back, for each string, which of its windows occur twice or more.

A minimiser with a count above `hot_count` is not followed, as its bucket would get all surroundings of a common
passage: hashes of its runs' whole windows are counted in the same way, and windows that do repeat travel
alone, each to the bucket of its hash. Buckets are worked on in slices of minimisers.

Defined cases. Null text has no words: nothing removed, the digest of nothing. Fewer words than a window: nothing
removed. Repeated rows are repeats of one another whatever their ids; null ids are ids like any other. Only
the id and text columns are read.
Ids are whole numbers; ids of another type that do not read as such are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import chunks as C
from weft.llm.common import words
from weft.llm.exact_dedup import split_copies

WINDOW, GRAM = 35, 12
#: Words whose windows are sorted together.
SLICE_WORDS = 1 << 18
ROWS = "id long, n_words long, n_removed long, kept_sha256 string"
ARROW_ROWS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
#: Space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words:
    """A chunk's words: where they start and end, the documents' bounds among them, and a code for each."""

    def __init__(self, chunk: C.Chunk, lower: bool = False):
        data = chunk.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        gap = GAPS[data]
        begins, ends = ~gap, ~gap
        begins[1:] &= gap[:-1]
        ends[:-1] &= gap[1:]
        cuts = chunk.offs[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = ~gap[cuts]
        ends[cuts[cuts > 0] - 1] = ~gap[cuts[cuts > 0] - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.offs = np.searchsorted(self.start, chunk.offs)
        self.data = data
        bounds = np.empty(2 * len(self.start) + 1, np.int64)
        bounds[:-1:2], bounds[1::2], bounds[-1] = self.start, self.end, len(data)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.take(pa.array(np.arange(0, 2 * len(self.start), 2))).dictionary_encode() if len(self.start) else pa.array([], pa.large_binary()).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in coded.dictionary), np.uint64, len(coded.dictionary))
        self.hashes = self.hash[self.code] if len(self.code) else np.zeros(0, np.uint64)


def chunk_runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return C.runs(C.grams(w.hashes, GRAM), w.offs, WINDOW, GRAM)


def window_hashes(w: Words, places: np.ndarray) -> np.ndarray:
    return C.mixed(C.grams(w.hashes, WINDOW)[places] ^ C.SPREAD)


def _hashes(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk = C.Chunk(blob.as_py())
                w = Words(chunk)
                hashes = C.grams(w.hashes, GRAM)
                places = C.minimiser_places(hashes, w.offs, WINDOW, GRAM)
                values, where, counts = np.unique(C.mixed(hashes[places]), return_inverse=True, return_counts=True)
                twice = counts > 1
                twice[where[chunk.weights[np.searchsorted(w.offs, places, "right") - 1] > 1]] = True
                yield C.hash_rows(number, values, twice, bits)
                C.release()

    return send


def _hot_hashes(bits: int):
    @C.tidy
    def send(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
        if not chunk.num_rows or not info.num_rows:
            return C.HASH_ARROW.empty_table()
        c = C.Chunk(chunk.column("blob")[0].as_py())
        w = Words(c)
        places = C.hot_places(*chunk_runs(w), info)
        values, where, counts = np.unique(window_hashes(w, places), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[where[c.weights[np.searchsorted(w.offs, places, "right") - 1] > 1]] = True
        return pa.Table.from_batches([C.hash_rows(key[0].as_py(), values, twice, bits)])

    return send


class Strings:
    """A chunk's distinct super-k-mers whose minimisers occur twice, in order of minimiser (of window hash, if it is hot), with their numbers."""

    def __init__(self, blob: bytes, info: pa.Table):
        self.chunk = chunk = C.Chunk(blob)
        self.words = w = Words(chunk)
        self.start, self.n, least = C.opened(*chunk_runs(w), info, lambda places: window_hashes(w, places))
        # A string is known by its words' codes in this chunk; the words themselves are packed when it is sent.
        lens = self.n + WINDOW - 1
        coded = C.binary_array(4 * lens, C.gather(w.code.astype("<i4"), self.start, lens).view(np.uint8)).dictionary_encode()
        self.string = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seen = np.unique(self.string, return_index=True)[1]
        self.first, self.least, self.windows = self.start[seen], least[seen], self.n[seen]
        weight = chunk.weights[np.searchsorted(w.offs, self.start, "right") - 1]
        self.count = np.bincount(self.string, weight, len(seen)).astype(np.int64)

    def packed(self, a: int, b: int) -> list[np.ndarray]:
        """Strings a .. b - 1: counts, words per string, word lengths, and the bytes of the words."""
        w = self.words
        which = C.ragged(self.first[a:b], self.windows[a:b] + WINDOW - 1)
        lens = w.end[which] - w.start[which]
        return [self.count[a:b], (self.windows[a:b] + WINDOW - 1).astype(np.int32), lens.astype(np.int32), C.gather(w.data, w.start[which], lens)]


def _send_strings(bits: int):
    @C.tidy
    def send(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
        rows = {"bucket": [], "chunk": [], "data": []}
        if chunk.num_rows and info.num_rows:
            s = Strings(chunk.column("blob")[0].as_py(), info)
            buckets, at = C.cut(s.least, bits)
            keys = C.slice_keys(s.least, bits)
            for bucket, a, b in zip(buckets.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                rows["bucket"].append(bucket)
                rows["chunk"].append(key[0].as_py())
                rows["data"].append(C.squeeze(np.diff(keys[a:b], prepend=np.uint16(0)), *s.packed(a, b)))
        return pa.table(rows, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())]))

    return send


def repeated_windows(lens: np.ndarray, codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each window of the strings (words `codes`, end to end) occurs twice or more, strings counting `count` times."""
    windows = lens - (WINDOW - 1)
    pointers = C.first_pointers(np.concatenate([codes, np.full(WINDOW, -1)]))
    for shift in (1, 2, 4, 8, 16, 3):
        C.refine(pointers, shift)
    pointers = pointers[C.ragged(np.cumsum(lens) - lens, windows)]
    return np.bincount(pointers, np.repeat(count, windows))[pointers] > 1


def _twice(count: np.ndarray, lens: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of words (sizes, data), end to end: their windows' numbers, and whether each window occurs twice or more."""
    coded = C.binary_array(sizes, data).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
    starts = np.cumsum(lens) - lens
    strings = C.binary_array(4 * lens, codes.view(np.uint8)).dictionary_encode()
    string = strings.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.unique(string, return_index=True)[1]
    twice = repeated_windows(lens[seen], C.gather(codes, starts[seen], lens[seen]).astype(np.int64), np.bincount(string, count, len(seen)))
    windows = lens[seen] - (WINDOW - 1)
    begin = np.cumsum(windows) - windows
    return windows[string], twice[C.ragged(begin[string], windows[string])]


@C.tidy
def _answer(group: pa.Table) -> pa.Table:
    """Per chunk that has any repeated window: a bit for each window of its strings, in order."""
    keys, count, lens, sizes, body = (list(x) for x in zip(*(C.expand(x) for x in group.column("data").to_pylist()), strict=True))
    keys = [np.cumsum(k, dtype=np.uint16) for k in keys]
    offs = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in lens]  # words before each string
    at = [np.append(0, np.cumsum(x, dtype=np.int64)) for x in sizes]  # bytes before each word
    found: list[list] = [[] for _ in keys]
    for ranges in C.slices_of(keys, lens, SLICE_WORDS):
        mine = [(r, a, b, offs[r][a], offs[r][b]) for r, (a, b) in enumerate(ranges) if b > a]
        word = lambda x, mine=mine: np.concatenate([x[r][c:d] for r, _, _, c, d in mine])
        string = lambda x, mine=mine: np.concatenate([x[r][a:b] for r, a, b, _, _ in mine])
        data = np.concatenate([body[r][at[r][c] : at[r][d]] for r, _, _, c, d in mine])
        windows, twice = _twice(string(count), string(lens).astype(np.int64), word(sizes).astype(np.int64), data)
        ends, place = np.append(0, np.cumsum(windows)), 0
        for r, a, b, _, _ in mine:
            found[r].append(twice[ends[place] : ends[place + b - a]])
            place += b - a
    bits = [np.concatenate(x) for x in found]
    some = [r for r, x in enumerate(bits) if x.any()]
    pick = pa.array(some, pa.int64())
    return pa.table({"chunk": group.column("chunk").take(pick).cast(pa.int64()), "bucket": group.column("bucket").take(pick).cast(pa.int64()), "n": pa.array([len(keys[r]) for r in some], pa.int64()), "data": pa.array([C.squeeze(np.packbits(bits[r])) for r in some], pa.binary())})


@C.tidy
def _cut(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
    """A chunk's documents without their repeated words."""
    if not chunk.num_rows:
        return ARROW_ROWS.empty_table()
    blob = chunk.column("blob")[0].as_py()
    if info.num_rows:
        s = Strings(blob, info)
        c, w = s.chunk, s.words
        at = np.cumsum(s.windows) - s.windows
        twice, bits = np.zeros(int(s.windows.sum()), bool), chunk.column("bits")[0].as_py()
        first = dict(zip(*(x.tolist() for x in C.cut(s.least, bits)), strict=False))
        for bucket, n, data in C.bit_rows(info, 1):
            a, size = first[bucket], int(s.windows[first[bucket] : first[bucket] + n].sum())
            twice[at[a] : at[a] + size] = np.unpackbits(C.expand(data)[0], count=size).view(bool)
        start = C.ragged(s.start, s.n)[twice[C.ragged(at[s.string], s.n)]]
        mark = np.zeros(len(w.start) + WINDOW, np.int32)
        mark[start] += 1
        mark[start + WINDOW] -= 1
        gone = np.cumsum(mark[: len(w.start)]) > 0
    else:
        c = C.Chunk(blob)
        w = Words(c)
        gone = np.zeros(len(w.start), bool)
    doc = np.searchsorted(w.offs, np.arange(len(gone)), "right") - 1
    removed = np.bincount(doc, gone, len(c.ids)).astype(np.int64)
    kept = np.flatnonzero(~gone)
    lens = w.end[kept] - w.start[kept] + 1
    data = np.append(w.data, np.uint8(32))
    joined = C.gather(data, w.start[kept], lens)
    joined[np.cumsum(lens) - 1] = 32
    joined = joined.tobytes()
    size = np.bincount(doc[kept], lens, len(c.ids)).astype(np.int64)
    ends = np.cumsum(size)
    sha = [hashlib.sha256(joined[a : b - 1] if b > a else b"").hexdigest() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
    return pa.table({"id": pa.array(c.ids, pa.int64(), mask=~c.known), "n_words": np.diff(w.offs), "n_removed": removed, "kept_sha256": sha}, schema=ARROW_ROWS)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES, hot_count: int = C.HOT_COUNT) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    firsts, copies = split_copies(rows, "id", "text", keep="min")
    chunks = C.pack(firsts, "id", "text", "__weft_size", chunk_bytes=chunk_bytes)
    bits = C.bucket_bits(chunks)
    chunks = chunks.select("chunk", "blob", F.lit(bits).alias("bits"))
    known = C.known_repeats(chunks, _hashes(bits), _hot_hashes(bits), hot_count)
    grouped = chunks.groupBy("chunk")
    strings = grouped.cogroup(known.groupBy("chunk")).applyInArrow(_send_strings(bits), "bucket long, chunk long, data binary")
    told = strings.groupBy("bucket").applyInArrow(_answer, C.BIT_ROWS).withColumn("kind", F.lit(1))
    cut = grouped.cogroup(known.unionAll(told).groupBy("chunk")).applyInArrow(_cut, ROWS)
    w = words(F.col("text"))
    n = F.size(w).cast("long")
    gone = n >= WINDOW
    whole = copies.select("id", n.alias("n_words"), F.when(gone, n).otherwise(0).alias("n_removed"), F.sha2(F.when(gone, F.lit("")).otherwise(F.array_join(w, " ")).cast("binary"), 256).alias("kept_sha256"))
    return cut.unionAll(whole).withColumnRenamed("id", id_col)
