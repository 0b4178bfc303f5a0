"""Mixing sources to target token counts by Efraimidis-Spirakis sampling, DataFrame functions only.

A source's target is its share, by weight, of all words, stopped at `max_epochs` times the source's
words; what the stopped sources leave is shared by the others, by weight, until none is above. Complete
epochs take every document; the rest of the target is filled from documents sorted by an exponential key
divided by the document's quality weight, so better documents come first more often, up to the budget. The
key is drawn from a hash of seed, id and text, never from a row's place, so reruns agree.

A source may hold a third of all rows: its documents are cut into ranges of the key's logarithm, in steps that no more
than about `RANGE_ROWS` documents fall into. The ranges are prefix-summed as (source, range, words) rows, and only
documents inside one range are sorted together. `take_mix` needs only where each source's sample ends, so it
joins documents with one row a source and shuffles no text.

Defined cases. A null text has no words; null is a source of its own, last in order. The last document of
the fraction is taken whole when that ends nearer the target, so a source misses its target by at most
half a document. Rows are drawn one by one, also if ids repeat or are null; rows that repeat id and text have one key
and are interchangeable. Ties of key are settled by id and then by hash of the text. Quality weights
that are null, not positive or not a number count as the smallest, 0.01. Ids and sources are compared as they are,
so ids may be of any type; helper columns carry the prefix `__weft_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import WORD_GAP, stored

LEAST_QUALITY = 0.01
SYMBOLS = "#*$%&|<>"
#: Documents in one range of keys, at most about.
RANGE_ROWS = 4096
#: Sources whose ends may be broadcast, about 100 bytes each.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    gone = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.size(F.array_remove(gone, "")).cast("long")


def plain_quality(text: Column) -> Column:
    """Share of characters that are not symbols, times the share of lines that do not repeat an earlier one; a null or empty text has 1."""
    n, lines = F.char_length(text), F.split(text, "\n")
    plain = F.char_length(F.translate(text, SYMBOLS, "")) / n
    return F.when(n > 0, F.greatest(plain * (F.size(F.array_distinct(lines)) / F.size(lines)), F.lit(LEAST_QUALITY))).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size); weights repeat in order of code points, null last.

    Water-filling: with sources in ascending order of cap / weight, the level is set after the first k are
    stopped, where (total - caps of the k) / (weight of the others) is first within the next ratio.
    """
    total = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    budget = F.sum(F.col("source_size").cast("double")).over(total) * share
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level"))))
    rows = rows.withColumn("set", F.coalesce(open_level.over(total)["level"], F.lit(float("inf"))))
    return rows.select("source", "source_size", F.least("cap", F.col("set") * F.col("weight")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5, the same in any engine and on any rerun."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality, seed: int) -> DataFrame:
    """The documents with __weft_source and __weft_draw (key, id, tie): ascending draws are the sample's order."""
    text = F.col(text_col)
    weight = F.greatest(F.coalesce(F.nanvl(quality(text), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY)), F.lit(LEAST_QUALITY))
    key = -F.log(uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(text, F.lit("")).cast("binary")))) / weight
    draw = F.struct(key.alias("key"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"))
    return docs.withColumn("__weft_source", F.col(source_col).cast("string")).withColumn("__weft_draw", draw)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality, weights: tuple[float, ...], share: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per document: source, draw, size, source_size, target, epochs, and whether the fraction takes it too (more); stored."""
    keyed = _keys(docs, id_col, text_col, source_col, quality, seed)
    rows = stored(keyed.select(F.col("__weft_source").alias("source"), F.col("__weft_draw").alias("draw"), n_words(F.col(text_col)).alias("size")), "mix")
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(counts.select("source", "source_size"), weights, share, max_epochs)
    sized = targets.join(counts.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumnRenamed("source", "of")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sized = sized.withColumn("epochs", F.least(full, F.lit(max_epochs).cast("long"))).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    # Of an exponential key at most a fourth of the documents lie within one doubling, whatever their weights.
    sized = sized.withColumn("steps", F.ceil(F.col("n") / (4 * RANGE_ROWS)).cast("double"))
    rows = rows.join(sized, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.withColumn("range", F.floor(F.log2(F.greatest("draw.key", F.lit(1e-300))) * F.col("steps")))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s3"), F.col("range").alias("r3"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s3")) & (F.col("range") == F.col("r3")), "left")
    inside = W.partitionBy("source", "range").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
    # whole documents only: in while the sum with the document ends no further above the budget than below it
    more = (F.col("budget") > 0) & (F.col("upto") - F.col("size") / 2.0 <= F.col("budget")) & (F.col("epochs") < max_epochs)
    return rows.select("source", "draw", "size", "source_size", "target", "epochs", more.alias("more"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=plain_quality, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: id, size, source_size, target, taken; and copies, how often the mix takes it."""
    rows = _drawn(docs, id_col, text_col, source_col, quality, weights, share, max_epochs, seed)
    copies = F.col("epochs") + F.col("more").cast("long")
    return rows.select(F.col("draw.id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality=plain_quality, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with its columns.

    A source's fraction is all rows up to its last draw; of rows that equal the last one, as many as the mix took.
    """
    rows = stored(_drawn(docs, id_col, text_col, source_col, quality, weights, share, max_epochs, seed), "drawn")
    ends = rows.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("more"), F.col("draw"))).alias("last"))
    named = ends.select(F.col("source").alias("s2"), "last")
    at_end = rows.join(named, F.col("source").eqNullSafe(F.col("s2")) & (F.col("draw") == F.col("last"))).groupBy(F.col("source").alias("s3")).agg(F.count_if("more").alias("taken"), F.count_if(~F.col("more")).alias("left"))
    ends = ends.join(at_end, F.col("source").eqNullSafe(F.col("s3")), "left")
    ends = stored(ends.select(F.col("source").alias("__weft_of"), F.col("epochs").alias("__weft_epochs"), F.col("last").alias("__weft_last"), F.col("taken").alias("__weft_taken"), F.coalesce("left", F.lit(0)).alias("__weft_left")), "ends")
    size = ends.agg(F.count(F.lit(1)), F.max("__weft_left")).first()
    keyed = _keys(docs, id_col, text_col, source_col, quality, seed)
    found = keyed.join(F.broadcast(ends) if size[0] <= BROADCAST_SOURCES else ends, F.col("__weft_source").eqNullSafe(F.col("__weft_of")))
    more = F.coalesce(F.col("__weft_draw") <= F.col("__weft_last"), F.lit(False))
    if size[1]:  # some source ends between equal rows: only those are numbered
        edge = F.coalesce((F.col("__weft_draw") == F.col("__weft_last")) & (F.col("__weft_left") > 0), F.lit(False))
        nth = F.row_number().over(W.partitionBy("__weft_of").orderBy("__weft_draw"))
        found = found.filter(~edge).withColumn("__weft_more", more).unionAll(found.filter(edge).withColumn("__weft_more", nth <= F.col("__weft_taken")))
    else:
        found = found.withColumn("__weft_more", more)
    copies = F.col("__weft_epochs") + F.col("__weft_more").cast("long")
    found = found.withColumn("__weft_copies", copies).filter("__weft_copies > 0")
    return found.withColumn("__weft_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__weft_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
