"""A corpus pipeline over `documents`: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs; the last one adds the
ids. Each is judged on its own input: all statistics are those of the documents that are left.

Defined cases, for every stage. Decisions are taken row by row: ids may be null or repeat, and rows that share an id
are told apart by their texts. Null, empty and very short texts fail the quality rules and go there. Columns of other
names pass through, whatever they are called, but for the prefix `__weft_` of helper columns; a column named `ids`
stays, and the token ids then come as `ids_1` (`ids_2`, and so on). Of rows that repeat id and text one is left after exact
dedup. An empty table gives an empty result with all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.functions.storage import stored
from weft.llm import exact_dedup, jaccard_join, mixing, quality_rules, sentencepiece_codec
from weft.llm.common import table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    taken = {c.lower() for c in docs.columns}
    free = next(name for k in range(len(taken) + 1) if (name := f"ids_{k}" if k else "ids") not in taken)
    return sentencepiece_codec.add_ids(docs, SENTENCEPIECE_MODEL, ids_col=free)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("mix sources", mix), ("encode", encode)]
#: SQL can express neither the rules' estimation, nor the similarity join at size, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
