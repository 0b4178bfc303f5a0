"""Similarity join of documents on word shingles: size-aware, heavy and light, exact.

Two sets link when 100 * |A & B| >= threshold * |A | B|. Sets up to a boundary are light, others heavy:

* Light: for each pair of sizes (n, m) that can link, a set of size n lists its subsets of the overlap
  that the pair needs. Two light sets link exactly if they list the same subset for the same pair of
  sizes, so a shared subset is a link and nothing is verified. The boundary is the largest size at which
  listing subsets costs no more than sending the set and scanning its lists, at the mean length of this table's own lists.
* Heavy: tokens are ordered by how many chunks of documents have them (in classes, rarest first), then by hash. Sets that
  link share a token among their first n - ceil(t * n) + 1, so only those enter inverted lists, and of them only
  tokens that some other document has. A list is cut where sizes differ too much to link; the sets
  of a piece are candidates. Candidates are gathered by component of the candidate graph, each set once, and
  joined exactly there over local inverted lists. Common tokens are bits there, counted by machine words. Sets of one
  component need no comparing, and of the sets of the largest one none has to look for partners at all.

A component with more tokens than a task should hold is cut in blocks, and blocks are joined inside. What is then in one
component with its largest part is done; each remaining set meets the blocks once, gathered in blocks of their
own. Exact copies of a text go in once.

Defined cases. Null text and texts without words have no shingles and link with nothing, not even each other.
Texts with fewer words than a shingle have one, the whole sequence. Rows that repeat link with themselves like other
rows. Ids may repeat: rows are told apart by place, copies by their text's SHA-256. A null id is a row of its own; a
component without a known id has null. Shingles are compared by 64-bit hash. Only the id and text columns are read.
Ids are whole numbers; ids of another type that do not read as such are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.storage import stored
from weft.llm import chunks as C
from weft.llm.exact_dedup import BROADCAST_BYTES, join_groups, one_of_each, split_by, split_copies
from weft.llm.substring_dedup import Words
from weft.operators.components import components_of_edges

SHINGLE = 5
#: Bounds of the classes of tokens, in chunks that have them.
CLASSES = (1, 4, 16, 64, 256, 1024, 4096)
#: Tokens of one local join, at most (about 60 bytes each while they are joined).
BLOCK_TOKENS = 1_000_000
#: Postings that a bucket sorts together.
SLICE_POSTS = 1 << 18
#: In a local join, tokens of more sets than this are bits, of at most so many bytes in all.
COMMON, BIT_BYTES = 32, 16 << 20
DOC, POST, LINK, SET = range(4)
OUT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("data", pa.binary())])
OUT_DDL = "kind int, key long, node long, n long, id long, data binary"
LINK_DDL = "src long, dst long"


def needed(n: int, m: int, percent: int) -> int:
    """The overlap that sets of n and m tokens need: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def light_cost(n: int, percent: int) -> int:
    return sum(math.comb(n, needed(n, m, percent)) for m in partners(n, percent) if needed(n, m, percent) <= n)


def light_boundary(percent: int, list_length: float) -> int:
    """The largest size up to which listing subsets costs no more than sending the set and scanning its lists."""
    n = 0
    while light_cost(n + 1, percent) <= (n + 1) + prefix_length(n + 1, percent) * list_length:
        n += 1
    return n


def sets_of(chunk: C.Chunk, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    w = Words(chunk, lower=True)
    hashes, out = C.grams(w.hashes, k), []
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            out.append(C.grams(w.hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _hashes(bits: int, k: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sets = sets_of(C.Chunk(blob.as_py()), k)
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield C.hash_rows(number, values, counts > 1, bits)
                C.release()

    return send


def _index(bits: int, k: int, percent: int, light: int):
    """Documents (with the number of rows and the digest of their text), postings, light links and sets of a chunk."""

    @C.tidy
    def index(key, chunk: pa.Table, info: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return OUT.empty_table()
        number = key[0].as_py()
        c = C.Chunk(chunk.column("blob")[0].as_py())
        sets = sets_of(c, k)
        classes = C.read_bits(C.bit_rows(info, 0), len(CLASSES)) if info.num_rows else np.zeros(0, np.uint8)
        values = np.unique(np.concatenate(sets))
        docs: list[tuple] = []
        links: list[tuple] = []
        whole: list[tuple] = []
        posts: list[np.ndarray] = []
        first: dict[bytes, int] = {}
        for i, tokens in enumerate(sets):
            node, n = number + i, len(tokens)
            sha = hashlib.sha256(c.data[c.offs[i] : c.offs[i + 1]]).digest()
            docs.append((DOC, int(c.weights[i]), node, n, int(c.ids[i]) if c.known[i] else None, sha))
            if not n:
                continue
            body = tokens.tobytes()
            same = first.setdefault(body, node)
            if same != node:  # an equal set of this chunk stands for it
                links.append((LINK, None, node, None, same, None))
                continue
            kind = classes[np.searchsorted(values, tokens)]
            if n <= light:
                posts += [np.array([[h, node, -1]], np.int64) for h in _subsets(tokens, percent, light)]
            if n > light or 100 * n >= percent * (light + 1):
                prefix = np.lexsort((tokens, kind))[: prefix_length(n, percent)]
                prefix = prefix[kind[prefix] > 0]
                if len(prefix):
                    posts.append(np.stack([tokens[prefix].view(np.int64), np.full(len(prefix), node), np.full(len(prefix), n)], 1))
                    shared = tokens[kind > 0]
                    whole.append((SET, None, node, n, None, shared.tobytes()))
        rows = docs + links + whole
        if posts:
            table = np.concatenate(posts)
            token = table[:, 0].view(np.uint64)
            table = table[np.argsort(token)]
            token = np.ascontiguousarray(table[:, 0]).view(np.uint64)
            buckets, at = C.cut(token, bits)
            for b, lo, hi in zip(buckets.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                rows.append((POST, b, number, None, None, C.squeeze(token[lo:hi], (table[lo:hi, 1] - number).astype(np.int32), table[lo:hi, 2].astype(np.int32))))
        return pa.table(dict(zip(OUT.names, map(list, zip(*rows, strict=True)), strict=True)), schema=OUT)

    return index


def _subsets(tokens: np.ndarray, percent: int, light: int) -> Iterator[int]:
    """Hashes of the subsets that a light set lists, tagged with the pair of sizes."""
    n, values = len(tokens), tokens.tolist()
    for m in partners(n, percent):
        size = needed(n, m, percent)
        if m <= light and size <= n:
            tag = np.uint64(min(n, m) * 1_000_003 + max(n, m))
            for subset in combinations(values, size):
                yield int((C.grams(np.array([tag, *subset], np.uint64), size + 1)).view(np.int64)[0])


def _lists(percent: int, bits: int):
    """Links (kind 0) and candidate edges (kind 1) of a bucket's lists: each set with the first of its piece."""

    def edges(token: np.ndarray, node: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        begin = np.append(True, (token[1:] != token[:-1]) | ((n[:-1] < 0) != (n[1:] < 0)) | (n[:-1] >= 0) & (100 * n[:-1] < percent * n[1:]))
        head = np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))
        mine = np.flatnonzero(node[head] != node)
        a, b, candidate = node[head[mine]], node[mine], n[mine] >= 0
        order = np.lexsort((candidate, b, a))
        a, b, candidate = a[order], b[order], candidate[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (candidate[1:] != candidate[:-1]))[: len(a)]
        return np.stack([a[fresh], b[fresh], candidate[fresh]], 1)

    @C.tidy
    def scan(group: pa.Table) -> pa.Table:
        token, place, n = (list(x) for x in zip(*(C.expand(x) for x in group.column("data").to_pylist()), strict=True))
        first = group.column("node").to_pylist()
        keys, out = [C.slice_keys(t, bits) for t in token], [np.zeros((0, 3), np.int64)]
        for ranges in C.slices_of(keys, [np.ones(len(k), np.int64) for k in keys], SLICE_POSTS):
            mine = [(r, a, b) for r, (a, b) in enumerate(ranges) if b > a]
            node = np.concatenate([place[r][a:b] + np.int64(first[r]) for r, a, b in mine])
            out.append(edges(np.concatenate([token[r][a:b] for r, a, b in mine]), node, np.concatenate([n[r][a:b] for r, a, b in mine]).astype(np.int64)))
        edge = np.concatenate(out)
        return pa.table({"src": edge[:, 0], "dst": edge[:, 1], "candidate": edge[:, 2].astype(bool)})

    return scan


class Parts:
    """Components of sets while they are joined; the members of the smaller of two move."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)
        order = np.argsort(self.of, kind="stable")
        self.members = {k: x for k, x in enumerate(np.split(order, np.flatnonzero(np.diff(self.of[order])) + 1))}
        self.main = max(self.members, key=lambda k: len(self.members[k]))

    def join(self, a: int, b: int) -> None:
        small, large = sorted((a, b), key=lambda k: len(self.members[k]))
        moved = self.members.pop(small)
        self.of[moved] = large
        self.members[large] = np.concatenate([self.members[large], moved])
        if small == self.main or len(self.members[large]) > len(self.members[self.main]):
            self.main = large


class LocalIndex:
    """Inverted lists over sets in order of size: tokens numbered rarest first, those that only one set has left out."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], percent: int):
        self.sizes, k = sizes, len(sets)
        lens = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens)
        ranked = tokens[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
        counts = np.diff(np.append(at, len(ranked)))
        del tokens, ranked
        number = np.empty(len(at), np.int32)
        by_count = np.argsort(counts, kind="stable")
        alone = int((counts == 1).sum())
        number[by_count] = np.arange(len(at)) - alone
        counts = counts[by_count[alone:]]
        code = np.empty(len(order), np.int32)
        code[order] = np.repeat(number, np.diff(np.append(at, len(order))))
        del order
        own = np.repeat(np.arange(k, dtype=np.int32), lens)
        own, code = own[code >= 0], code[code >= 0]
        order = np.lexsort((code, own))
        self.code = code[order]
        self.own = own
        shared = np.bincount(own, minlength=k)
        self.start = np.append(0, np.cumsum(shared))
        # Tokens that only one set has come first in the order, so they use up part of its prefix.
        prefix = sizes - -(-percent * sizes // 100) + 1 - (sizes - shared)
        self.prefix = np.clip(prefix, 0, shared)
        inside = np.arange(len(own)) - self.start[own] < self.prefix[own]
        self.heads, self.head_start = self._lists(np.flatnonzero(inside), len(counts))
        # The most common tokens, as many as the bytes allow, become bits.
        room = max(64, 8 * BIT_BYTES // max(1, k))
        self.common = max(len(counts) - room, int(np.searchsorted(counts, COMMON, "right")))
        self.rare, self.rare_start = self._lists(np.flatnonzero(self.code < self.common), len(counts))
        words = -(-(len(counts) - self.common) // 64)
        self.bits = np.zeros((k, words), np.uint64)
        for a in range(0, k, 256):
            b = min(k, a + 256)
            plain = np.zeros((b - a, 64 * words), bool)
            x = slice(self.start[a], self.start[b])
            some = self.code[x] >= self.common
            plain[self.own[x][some] - a, self.code[x][some] - self.common] = True
            self.bits[a:b] = np.packbits(plain, axis=1).view(np.uint64).reshape(b - a, words)

    def _lists(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets of each token among the entries, in order of size."""
        which = which[np.argsort(self.code[which], kind="stable")]
        return self.own[which], np.append(0, np.cumsum(np.bincount(self.code[which], minlength=n)))

    def tokens(self, i: int) -> np.ndarray:
        return self.code[self.start[i] : self.start[i + 1]]

    def candidates(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Sets lo .. hi - 1 that share a token of both prefixes with set i."""
        mine = self.tokens(i)[: self.prefix[i]]
        found = self.heads[C.ragged(self.head_start[mine], self.head_start[mine + 1] - self.head_start[mine])]
        seen = np.zeros(len(self.sizes), bool)
        seen[found] = True
        seen[:lo] = seen[hi:] = False
        return np.flatnonzero(seen)

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = self.tokens(i)
        mine = mine[: np.searchsorted(mine, self.common)]
        found = self.rare[C.ragged(self.rare_start[mine], self.rare_start[mine + 1] - self.rare_start[mine])]
        out = np.bincount(found, minlength=len(self.sizes))[others]
        return out + np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64) if self.bits.shape[1] else out


def local_links(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets that link, directly or through others; sets of one label count as joined.

    With `sides`, only sets of different sides are compared. A set is compared with all that it could link to and that are in
    other components. Two sets end in different components only if one is outside the largest, so those inside it
    need not be compared from their end.
    """
    order = np.lexsort((nodes, sizes))
    nodes, sizes, sets, parts, out = nodes[order], sizes[order], [sets[i] for i in order], Parts(labels[order]), []
    sides = None if sides is None else sides[order]
    index = LocalIndex(sizes, sets, percent) if len(sets) > 4 else None
    done = np.zeros(len(sets), bool)
    while True:
        open_ = np.flatnonzero(~done & (parts.of != parts.main))
        if not len(open_):
            return out
        for i in open_.tolist():
            if parts.of[i] == parts.main:
                continue
            done[i] = True
            n = int(sizes[i])
            lo, hi = int(np.searchsorted(sizes, -(-percent * n // 100))), int(np.searchsorted(sizes, 100 * n // percent, "right"))
            others = index.candidates(i, lo, hi) if index else np.arange(lo, hi)
            others = others[(parts.of[others] != parts.of[i]) if sides is None else (parts.of[others] != parts.of[i]) & (sides[others] != sides[i])]
            if not len(others):
                continue
            both = index.overlaps(i, others) if index else np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others.tolist()])
            for j in others[100 * both >= percent * (n + sizes[others] - both)].tolist():
                if parts.of[i] != parts.of[j]:
                    out.append((int(nodes[i]), int(nodes[j])))
                    parts.join(int(parts.of[i]), int(parts.of[j]))


def _join_groups(percent: int, paired: bool):
    @C.tidy
    def join(group: pa.Table) -> pa.Table:
        label, node, n, now, side = (group.column(x).to_numpy().astype(np.int64) for x in ("label", "node", "n", "now", "side"))
        data, order, links = group.column("data"), np.argsort(label, kind="stable"), []
        for mine in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(mine) > 1:
                sets = [np.frombuffer(data[i].as_buffer(), np.uint64) for i in mine.tolist()]
                links += local_links(node[mine], n[mine], sets, now[mine], percent, side[mine] if paired else None)
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    return join


def _verified(sets: DataFrame, candidates: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Links (src, dst) among candidates, enough of them to connect all sets that link."""
    labels = stored(components_of_edges(candidates), "labels")
    loads = sets.select("node", "n").join(labels, F.col("node") == F.col("id")).groupBy("component").agg(F.sum("n").alias("load"))
    total = loads.agg(F.sum("load")).first()[0] or 0
    groups = max(1, -(-4 * total // block_tokens))
    loads = loads.withColumn("blocks", F.ceil(F.col("load") / block_tokens).cast("long"))
    placed = labels.join(loads.drop("load"), "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    rows = sets.select("node", "n", "data").join(placed, F.col("node") == F.col("id")).drop("id")
    shared = F.struct(F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(groups))).alias("a"), F.col("block").alias("b"), (F.col("blocks") > 1).alias("c"))
    inside = rows.withColumn("at", shared).select("at", F.col("component").alias("label"), "node", "n", "data", F.col("node").alias("now"), F.lit(0).alias("side"))
    links = stored(inside.groupBy("at").applyInArrow(_join_groups(percent, False), LINK_DDL), "links")
    large = placed.filter("blocks > 1")
    if not large.limit(1).count():
        return links
    # Blocks of one large component; sets already connected inside their block carry one label.
    now = components_of_edges(links).select("id", F.col("component").alias("found"))
    state = large.join(now, "id", "left").select("id", "component", "blocks", "block", F.coalesce("found", "id").alias("now"))
    state = stored(_joined_leaders(sets, state, percent), "state")
    parts = state.groupBy("component", "now").count()
    biggest = parts.groupBy("component").agg(F.max_by("now", F.struct("count", "now")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    rest = state.join(biggest, "component").withColumn("odd", F.col("now") != F.col("most"))
    # The sets outside a component's largest part, in blocks of their own, meet every other block of the component once.
    odd = rest.filter("odd").join(sets.select("node", "n"), F.col("id") == F.col("node")).select("id", "component", "blocks", "block", "now", "n")
    many = odd.groupBy("component").agg(F.ceil(F.sum("n") / block_tokens).cast("long").alias("odd_blocks"))
    odd = odd.join(many, "component").withColumn("odd_block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("odd_blocks")))
    at = lambda a, b: F.struct(F.col("component").alias("a"), F.col(a).alias("b"), F.col(b).alias("c")).alias("at")
    first = rest.join(many, "component").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("odd_blocks") - 1))).select("id", "component", "now", at("block", "o"), F.lit(0).alias("side"))
    second = odd.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("b != block").select("id", "component", "now", at("b", "odd_block"), F.lit(1).alias("side"))
    cross = first.unionAll(second).join(sets.select("node", "n", "data"), F.col("id") == F.col("node")).select("at", F.col("component").alias("label"), "node", "n", "data", "now", "side")
    more = cross.groupBy("at").applyInArrow(_join_groups(percent, True), LINK_DDL)
    same = state.filter(F.col("id") != F.col("now")).select(F.col("id").alias("src"), F.col("now").alias("dst"))
    return links.unionAll(same).unionAll(more)


def _joined_leaders(sets: DataFrame, state: DataFrame, percent: int) -> DataFrame:
    """Join the blocks' components through one set of each: most parts of a large group meet here."""
    leaders = state.groupBy("component", "now").agg(F.min("id").alias("id"))
    rows = leaders.join(sets.select("node", "n"), F.col("id") == F.col("node"))
    ring = W.partitionBy("component").orderBy("n", "node")
    near = rows.select("component", "now", "node", "n", F.lead("node").over(ring).alias("to"), F.lead("now").over(ring).alias("to_now")).filter("to is not null")
    side = near.select(F.struct("node", "to").alias("at"), F.col("component").alias("label"), F.explode(F.array(F.struct(F.col("node").alias("x"), F.col("now").alias("now")), F.struct(F.col("to").alias("x"), F.col("to_now").alias("now")))).alias("e"))
    side = side.select("at", "label", F.col("e.x").alias("x"), F.col("e.now").alias("now"), F.lit(0).alias("side")).join(sets.select("node", "n", "data"), F.col("x") == F.col("node"))
    found = side.select("at", "label", "node", "n", "data", "now", "side").groupBy("at").applyInArrow(_join_groups(percent, False), LINK_DDL)
    of = leaders.select(F.col("id").alias("leader"), "now")
    joined = found.join(of.select(F.col("leader").alias("src"), F.col("now").alias("a")), "src").join(of.select(F.col("leader").alias("dst"), F.col("now").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    merged = components_of_edges(joined).select(F.col("id").alias("was"), F.col("component").alias("to_now"))
    return state.join(merged, F.col("now") == F.col("was"), "left").select("id", "component", "blocks", "block", F.coalesce("to_now", "now").alias("now"))


def _placed(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, chunk_bytes: int, block_tokens: int) -> DataFrame:
    """One row per document: id, sha (binary digest of the text), n_shingles, and label, the same for rows of one component; null without shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    firsts, copies = split_copies(rows, "id", "text", keep="min")
    chunks = C.pack(firsts, "id", "text", "__weft_size", chunk_bytes=chunk_bytes)
    bits = C.bucket_bits(chunks)
    chunks = chunks.select("chunk", "blob")
    answers = C.answer(chunks.mapInArrow(_hashes(bits, shingle), C.HASH_ROWS), CLASSES)
    known = answers.select("chunk", "bucket", "n", "data", F.lit(0).alias("kind"))
    entries, lists = answers.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("lists"), F.lit(0.0))).first()
    light = light_boundary(percent, entries / max(lists, 1.0))
    parts = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_index(bits, shingle, percent, light), OUT_DDL)
    parts = stored(parts, "parts", "kind")
    edges = stored(parts.filter(F.col("kind") == POST).select("key", "node", "data").groupBy("key").applyInArrow(_lists(percent, bits), "src long, dst long, candidate boolean"), "edges")
    links = _verified(parts.filter(F.col("kind") == SET), edges.filter("candidate").select("src", "dst"), percent, block_tokens)
    links = links.unionAll(edges.filter("not candidate").select("src", "dst")).unionAll(parts.filter(F.col("kind") == LINK).select(F.col("id").alias("src"), F.col("node").alias("dst")))
    labels = components_of_edges(links).withColumnRenamed("id", "of")
    nodes = parts.filter(F.col("kind") == DOC).select("node", F.col("n").alias("n_shingles"), "id", F.col("data").alias("sha"), F.col("key").alias("rows"))
    nodes = nodes.join(labels, F.col("node") == F.col("of"), "left").withColumn("label", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    nodes = stored(nodes.select("id", "sha", "n_shingles", "label", "rows"), "nodes")
    # Copies take their text's row.
    texts = nodes.filter("rows > 1").dropDuplicates(["sha"]).drop("id", "rows")
    lost = join_groups(stored(copies.select("id", F.col("__weft_sha").alias("sha")), "copies"), texts, "sha")
    return stored(nodes.drop("rows").unionByName(lost), "placed")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE, chunk_bytes: int = C.CHUNK_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable by links."""
    placed = _placed(docs, id_col, text_col, percent, shingle, chunk_bytes, block_tokens)
    some = placed.filter("label is not null")
    found = join_groups(some.drop("sha"), some.groupBy("label").agg(F.min("id").alias("component_id")), "label")
    out = found.select("id", "n_shingles", "component_id").unionAll(placed.filter("label is null").select("id", "n_shingles", "id"))
    return out.withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE, chunk_bytes: int = C.CHUNK_BYTES, block_tokens: int = BLOCK_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with their columns, of each component the one with the smallest id (null ids last; then by digest of the text).

    Texts of documents without a near copy are not shuffled again.
    """
    placed = _placed(docs, id_col, text_col, percent, shingle, chunk_bytes, block_tokens).filter("label is not null")
    top = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "sha"))
    groups = stored(placed.groupBy("label").agg(top.alias("top"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "components")
    members = join_groups(placed, groups, "label")
    stays = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("sha") == F.col("top.sha"))
    decided = members.select(F.col("sha").alias("__weft_sha"), "id", F.when(stays, F.col("members")).otherwise(0).alias("__weft_size")).distinct()
    return one_of_each(split_by(docs, id_col, text_col, stored(decided, "decided"), broadcast_bytes)[0], id_col)
