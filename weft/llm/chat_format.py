"""Chat formatting by quotation linking.

A line that starts with one or more `>` (spaces and tabs may stand between) is quoted, at a level that is the number
of signs; neighbouring lines of one level are a passage. Passages and their lines are normalised (lower case, white space
collapsed) and hashed, as are each message's own text, paragraphs and lines. A passage is linked to the latest
earlier message of its conversation that has it as own text, paragraph or line; if none has it whole, its
paragraphs (between blank quoted lines) are linked one by one, and the lines of a paragraph that none has. A
message replies to the message that most lines of its first-level passages are linked to, the latest one if several have as
many. A message without such a link starts a thread.

Conversations come out in reply order: threads by the turn that starts them, then messages by turn; a reply's turn is
later than that of what it answers, so it always follows it. The text comes without quotes.

Only hashes that some message quotes are joined. Equal hashes of one conversation are matched in one sorted pass
over turns, cut in blocks of turns, so neither a common line nor a huge conversation makes pairs or one large task.
Threads are found by pointer doubling: one small join per doubling of the longest reply chain.

Defined cases. Null text is empty. Messages with a null turn link with nothing and start no thread (thread null); a null
conversation is a conversation. Rows that share conversation and turn may be quoted alike; each has its own link, and replies
to their turn follow the smallest thread. Passages without a letter or digit are not linked. Conversations and turns
are whole numbers; a value of another type that does not read as one is an error. Columns of other names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.storage import stored

QUOTED = re.compile(r"[ \t]*((?:>[ \t]*)+)(.*)", re.S)
#: Turns of one block of a conversation.
BLOCK_TURNS = 1024
PARSED = "conv long, turn long, role string, row long, own string, units array<long>, quotes array<struct<level:int,whole:long,parts:array<struct<whole:long,lines:array<long>>>>>"
ARROW = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("row", pa.int64()), ("own", pa.string()), ("units", pa.list_(pa.int64())), ("quotes", pa.list_(pa.struct([("level", pa.int32()), ("whole", pa.int64()), ("parts", pa.list_(pa.struct([("whole", pa.int64()), ("lines", pa.list_(pa.int64()))])))])))])


def digest(text: str) -> int | None:
    """64-bit hash of a normalised passage, None if it has no letter or digit."""
    plain = " ".join(text.lower().split())
    if not any(c.isalnum() for c in plain):
        return None
    h = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def parse(text: str | None) -> tuple[str, list[int], list[dict]]:
    """Own text, hashes that the message can be found by, and its quoted passages."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        found = QUOTED.fullmatch(line)
        level = found[1].count(">") if found else 0
        if not level:
            own.append(line)
        elif level == before:
            passages[-1][1].append(found[2])
        else:
            passages.append((level, [found[2]]))
        before = level
    mine = "\n".join(own).strip("\n")
    units = {digest(mine), *map(digest, own), *map(digest, re.split(r"\n[ \t]*\n", mine))} - {None}
    quotes = [{"level": level, "whole": digest("\n".join(lines)), "parts": _paragraphs(lines)} for level, lines in passages]
    return mine, sorted(units), [q for q in quotes if q["whole"] is not None]


def _paragraphs(lines: list[str]) -> list[dict]:
    """Hashes of the paragraphs of a passage and of their lines; those without a letter or digit are left out."""
    parts: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            parts[-1].append(line)
        elif parts[-1]:
            parts.append([])
    out = [{"whole": digest("\n".join(p)), "lines": [h for h in map(digest, p) if h is not None]} for p in parts]
    return [p for p in out if p["whole"] is not None]


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [parse(t) for t in batch.column(4).to_pylist()]
        own, units, quotes = (list(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, ARROW.field("own").type), pa.array(units, ARROW.field("units").type), pa.array(quotes, ARROW.field("quotes").type)], schema=ARROW)


def _latest_before(asked: DataFrame, had: DataFrame) -> DataFrame:
    """`asked` (conv, h, turn, ...) with `found`: the latest turn below its own among `had` (conv, h, turn)."""
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    had = had.select("conv", "h", "turn").distinct().withColumn("block", block)
    asked = asked.withColumn("block", block)
    last = had.groupBy("conv", "h", "block").agg(F.max("turn").alias("last"))
    spots = last.unionByName(asked.select("conv", "h", "block").distinct().withColumn("last", F.lit(None).cast("long")))
    carried = spots.groupBy("conv", "h", "block").agg(F.max("last").alias("last")).withColumn("carried", F.max("last").over(W.partitionBy("conv", "h").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    both = asked.withColumn("own", F.lit(None).cast("long")).unionByName(had.withColumn("own", F.col("turn")), allowMissingColumns=True)
    inside = W.partitionBy("conv", "h", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("own").over(inside)).filter("own is null")
    c = carried.select(F.col("conv").alias("c"), F.col("h").alias("h2"), F.col("block").alias("b2"), "carried")
    return both.join(c, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h2")) & (F.col("block") == F.col("b2")), "left").withColumn("found", F.coalesce("near", "carried")).drop("c", "h2", "b2", "carried", "near", "own", "block")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of messages (conv, turn, reply_to) that reply, by pointer doubling."""
    state = stored(replies.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = state.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = state.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("thread") == F.col("t")), "left")
        step = stored(step.select("conv", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if not step.filter("moved").limit(1).count():
            return step.drop("moved")
        state = step.drop("moved")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, reply_to, thread, depth, n_quotes, n_linked, own_text.

    In reply order a conversation's messages sort by (thread, turn).
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).cast("string").alias("text"))
    parsed = stored(rows.mapInArrow(_parser, PARSED), "messages")
    quoting = parsed.filter((F.size("quotes") > 0) & F.col("turn").isNotNull()).select("conv", "turn", "row", F.posexplode("quotes").alias("nth", "q")).distinct()
    # Ways to be found, from the best: the passage (way 0), one of its paragraphs (1), a line of that paragraph (2).
    def way(kind: int, h: Column, weight: Column, part: Column, line: Column) -> Column:
        return F.struct(F.lit(kind).alias("way"), h.alias("h"), weight.cast("int").alias("weight"), part.cast("int").alias("part"), line.cast("int").alias("line"))

    none, sizes = F.lit(-1), F.aggregate("q.parts", F.lit(0), lambda n, p: n + F.size(p["lines"]))
    ways = F.array(way(0, F.col("q.whole"), F.greatest(F.lit(1), sizes), none, none))
    parts = F.transform("q.parts", lambda p, i: F.concat(F.array(way(1, p["whole"], F.greatest(F.lit(1), F.size(p["lines"])), i, none)), F.transform(p["lines"], lambda h, k: way(2, h, F.lit(1), i, k))))
    asked = quoting.select("conv", "turn", "row", "nth", F.col("q.level").alias("level"), F.inline(F.concat(ways, F.flatten(parts))))
    had = parsed.filter("turn is not null").select("conv", "turn", F.explode("units").alias("h"))
    wanted = asked.select(F.col("conv").alias("c"), F.col("h").alias("h2")).distinct()
    had = had.join(wanted, _same("conv", "c") & (F.col("h") == F.col("h2")), "left_semi")
    found = _latest_before(asked, had).filter("found is not null")
    passage = W.partitionBy("conv", "turn", "row", "nth")
    found = found.withColumn("best", F.min("way").over(passage)).filter("way = 0 or best > 0")
    paragraph = W.partitionBy("conv", "turn", "row", "nth", "part")
    found = found.withColumn("best", F.min("way").over(paragraph)).filter("way < 2 or best = 2")
    votes = found.groupBy("conv", "turn", "row", "found").agg(F.sum(F.when(F.col("level") == 1, F.col("weight")).otherwise(0)).alias("votes"), F.collect_set("nth").alias("passages"))
    # A message's votes are at most as many as its passages' lines, so these groups are as small as messages.
    links = votes.groupBy("conv", "turn", "row").agg(F.max_by("found", F.struct("votes", "found")).alias("reply_to"), F.max("votes").alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("passages")))).cast("long").alias("n_linked"))
    links = stored(links.withColumn("reply_to", F.when(F.col("votes") > 0, F.col("reply_to"))).drop("votes"), "links")
    replies = links.filter("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("reply_to"))
    threads = _threads(replies).select(F.col("conv").alias("c2"), F.col("turn").alias("t2"), F.col("thread").alias("upper"), F.col("depth").alias("upper_depth"))
    links = links.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("row").alias("r"), "reply_to", "n_linked")
    out = parsed.join(links, _same("conv", "c") & (F.col("turn") == F.col("t")) & (F.col("row") == F.col("r")), "left").drop("c", "t", "r")
    out = out.join(threads, _same("conv", "c2") & (F.col("reply_to") == F.col("t2")), "left")
    thread = F.coalesce("upper", "reply_to", "turn")
    depth = F.when(F.col("reply_to").isNull(), 0).otherwise(1 + F.coalesce("upper_depth", F.lit(0))).cast("long")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "reply_to", thread.alias("thread"), depth.alias("depth"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("own_text"))


def _ahead(rows: DataFrame, within: list[str], by: str) -> DataFrame:
    """`rows` (..., n) summed by `within` and `by`, with the sum of n of the smaller `by` as `ahead`; null is last."""
    sums = rows.groupBy(*within, by).agg(F.sum("n").alias("n"))
    before = W.partitionBy(*within).orderBy(F.col(by).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def placed(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """`link_quotes` rows with `place`: the message's number in its conversation's reply order, from 0.

    Messages sort by (thread, turn), those of a null turn last; equal turns by role and text. Messages are counted by blocks of
    threads, threads, and blocks of turns, so only messages of one block are numbered together.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK_TURNS)
    # As a struct the key equals itself with nulls in it, so numbering and join share one exchange of the texts.
    key = F.struct(F.col(conv_col).alias("conv"), F.col("thread").alias("thread"), block(turn_col).alias("turns"))
    rows = stored(linked.withColumn("__key", key), "linked")
    counts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).select("__key", "__key.*", "n").withColumn("threads", block("thread"))
    starts = counts.withColumn("start", F.lit(0).cast("long"))
    for keys in (["conv", "threads"], ["conv", "threads", "thread"], ["conv", "thread", "turns"]):
        more = _ahead(counts, keys[:-1], keys[-1]).select(*[F.col(k).alias(f"{k}2") for k in keys], "ahead")
        on = _same(keys[0], f"{keys[0]}2")
        for k in keys[1:]:
            on = on & _same(k, f"{k}2")
        starts = starts.join(more, on, "left").withColumn("start", F.col("start") + F.col("ahead")).drop("ahead", *[f"{k}2" for k in keys])
    inside = W.partitionBy("__key").orderBy(turn_col, role_col, F.xxhash64("own_text"), "own_text")
    out = rows.withColumn("place", F.row_number().over(inside) - 1).join(starts.select(F.col("__key").alias("__key2"), "start"), F.col("__key") == F.col("__key2"))
    return out.withColumn("place", F.col("place") + F.col("start")).drop("__key", "__key2", "start")


def formatted(linked: DataFrame, role_col: str = "role", start: str = "<|{}|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """`link_quotes` rows with a `turn_text` of role mark, text and end mark; a null role is written `unknown`."""
    head, tail = start.split("{}")
    return linked.withColumn("turn_text", F.concat(F.lit(head), F.coalesce(F.col(role_col), F.lit("unknown")), F.lit(tail), F.col("own_text"), F.lit(end)))
