"""Exact deduplication by two-pass Bloom filtering, DataFrame functions only.

Texts are read once, into a stored table of ids and SHA-256 digests; all that follows works on its 40 bytes a row.
Pass 1 sends two Bloom slots of each digest (a few bytes a document, combined before the
shuffle) to slot counters; slots hit at least twice become a bitmap, cut into 4 KB blocks. Pass 2
tests each row against the bitmap: a text whose slots are not all marked occurs once and passes
straight through; only the others are grouped by digest.

The bitmap is broadcast only while its size, known before it is built, is within `broadcast_bytes`; beyond that rows
of digest and id are joined to its blocks, and keep one bit of each. To give back the texts that stay, digests
that really repeat make a second bitmap. Rows that it marks are joined to their groups with their texts, the
others pass; if that one is too large as well, all rows take part in this one join.

Defined cases. Null texts count as empty texts. Of equal texts the row with the largest id stays
(null ids lose to all others). Rows that repeat both text and winning id are all marked kept in
`exact_duplicates`; `drop_exact_duplicates` returns one of them. Other columns come back
untouched; helper columns carry the prefix `__weft_`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import stored

#: Bits of a block made by bitmap_construct_agg.
BLOCK_BITS = 32768
SLOTS_PER_ROW = 16
#: Rows of a group from which it may be broadcast.
LARGE = 1000
BROADCAST_BYTES = 64 << 20


def _filter_slots(rows: int) -> int:
    return max(BLOCK_BITS, -(-rows * SLOTS_PER_ROW // BLOCK_BITS) * BLOCK_BITS)


def _slot(sha: Column, turn: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(turn)), F.lit(slots)) + 1


def _is_set(bits: Column, position: Column) -> Column:
    """Whether the bit at a position of a block is set; a missing block has none."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _bitmap(rows: DataFrame, slots: int, least: int) -> DataFrame:
    """Blocks (block, bits) of the slots that rows (__weft_sha) hit at least `least` times."""
    hits = rows.select(F.explode(F.array(_slot(F.col("__weft_sha"), 1, slots), _slot(F.col("__weft_sha"), 2, slots))).alias("slot"))
    hits = hits.groupBy("slot").count().filter(F.col("count") >= least) if least > 1 else hits
    return hits.groupBy(F.expr("bitmap_bucket_number(slot)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))


def _marked(rows: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    """Rows with __weft_maybe: whether both slots of __weft_sha are set. Each join leaves one bit of the block that it brings."""
    for turn in (1, 2):
        named = blocks.select(F.col("block").alias("__weft_block"), F.col("bits").alias("__weft_bits"))
        slotted = rows.withColumn("__weft_slot", _slot(F.col("__weft_sha"), turn, slots))
        joined = slotted.join(named, F.expr("bitmap_bucket_number(__weft_slot) = __weft_block"), "left")
        rows = joined.select(*[F.col(f"`{c}`") for c in rows.columns], _is_set(F.col("__weft_bits"), F.expr("bitmap_bit_position(__weft_slot)")).alias(f"__weft_m{turn}"))
    return rows.withColumn("__weft_maybe", F.col("__weft_m1") & F.col("__weft_m2")).drop("__weft_m1", "__weft_m2")


def with_repeat_hint(digests: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of `digests` (id, __weft_sha) with __weft_maybe, false for digests that occur once for sure."""
    slots = _filter_slots(digests.count())
    blocks = _bitmap(digests, slots, 2)
    return _marked(digests, F.broadcast(blocks) if slots // 8 <= broadcast_bytes else blocks, slots)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return stored(docs.select(F.col(id_col).alias("id"), _sha(text_col).alias("__weft_sha")), "digests")


def _groups(maybe: DataFrame, keep: str) -> DataFrame:
    return maybe.groupBy("__weft_sha").agg((F.max if keep == "max" else F.min)("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def join_groups(rows: DataFrame, groups: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """Rows joined (inner or left) to the one row of `groups` with their key.

    Keys of more than `LARGE` rows, or a thousandth of all rows if that is more, number a thousand at most; their groups are
    broadcast, so that no task gets all rows of one key.
    """
    on = list(key)
    large = F.broadcast(rows.groupBy(*on).count().filter(F.col("count") > max(LARGE, rows.count() // 1000)).select(*on))
    hot = rows.join(large, on, "left_semi").join(F.broadcast(groups.join(large, on, "left_semi")), on, how)
    return hot.unionByName(rows.join(large, on, "left_anti").join(groups, on, how))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    hinted = with_repeat_hint(_digests(docs, id_col, text_col), broadcast_bytes)
    maybe = stored(hinted.filter("__weft_maybe").drop("__weft_maybe"), "maybe")
    found = join_groups(maybe, _groups(maybe, keep), "__weft_sha")
    alone = hinted.filter(~F.col("__weft_maybe")).select("id", "__weft_sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return found.select(*alone.columns).unionAll(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__weft_sha")).alias("text_sha256"))


def split_by(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go) by a stored table `decided` (__weft_sha, id, __weft_size) of digests and ids.

    Rows go if their size is 0; those not in the table stay, with size 1. Both gain __weft_sha, those that stay __weft_size. Only
    rows that a bitmap of the table's digests marks are joined, if it can be broadcast; on digest and id, so that the rows
    of one text are spread over tasks.
    """
    rows, slots, once = docs.withColumn("__weft_sha", _sha(text_col)), _filter_slots(decided.count()), None
    if slots // 8 <= broadcast_bytes:
        rows = _marked(rows, F.broadcast(_bitmap(decided, slots, 1)), slots)
        once = rows.filter(~F.col("__weft_maybe")).drop("__weft_maybe").withColumn("__weft_size", F.lit(1).cast("long"))
        rows = rows.filter("__weft_maybe").drop("__weft_maybe")
    named = decided.select(F.col("__weft_sha").alias("__weft_of"), F.col("id").alias("__weft_id"), "__weft_size")
    same = (F.col("__weft_sha") == F.col("__weft_of")) & F.col(id_col).eqNullSafe(F.col("__weft_id"))
    flagged = rows.join(named, same, "left").drop("__weft_of", "__weft_id").withColumn("__weft_size", F.coalesce("__weft_size", F.lit(1).cast("long")))
    stay = flagged.filter("__weft_size > 0")
    return (stay if once is None else stay.unionByName(once)), flagged.filter("__weft_size = 0").drop("__weft_size")


def split_copies(docs: DataFrame, id_col: str, text_col: str, keep: str = "max", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, copies that do not), each with the columns of `docs` and __weft_sha.

    Rows that stay gain __weft_size, the number of rows with their text; copies are the others.
    """
    hinted = with_repeat_hint(_digests(docs, id_col, text_col), broadcast_bytes)
    repeated = stored(hinted.filter("__weft_maybe").drop("__weft_maybe"), "maybe")
    groups = stored(_groups(repeated, keep).filter("group_size > 1"), "groups")
    lost = join_groups(repeated, groups, "__weft_sha").filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("__weft_sha", "id").distinct()
    decided = groups.select("__weft_sha", F.col("keep_id").alias("id"), F.col("group_size").alias("__weft_size"))
    return split_by(docs, id_col, text_col, stored(decided.unionAll(lost.withColumn("n", F.lit(0).cast("long"))), "decided"), broadcast_bytes)


def one_of_each(stay: DataFrame, id_col: str) -> DataFrame:
    """Rows that stay without helper columns; of rows that repeat digest and id one is left."""
    again = F.col("__weft_size") > 1
    return stay.filter(again).dropDuplicates([id_col, "__weft_sha"]).unionAll(stay.filter(~again)).drop("__weft_sha", "__weft_size")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that stay, with their columns; rows whose text occurs once are never shuffled."""
    return one_of_each(split_copies(docs, id_col, text_col, keep, broadcast_bytes)[0], id_col)
