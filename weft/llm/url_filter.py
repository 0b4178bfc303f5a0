"""URL rules by a sort-merge range join, DataFrame functions only.

A rule is a host and a path prefix. Its canonical key is the host with labels reversed, then the
path, so that all URLs it fits lie in one interval of keys that starts at the rule's key. A URL has one
key for its host and one for each parent domain that some rule names. URL keys and rule keys of one
reversed host are sorted together; each rule carries its stack, that is itself and the rules whose
intervals enclose it. The last rule at or before a URL key has the stack to look at, and popping the
intervals that have ended leaves the innermost rule that fits. The longest such rule over the URL's domains wins.

Keys are grouped by reversed host. A host with more keys than its share is cut into salted parts
that each get a copy of that host's rules, so no task holds a hot domain.

Defined cases. A null URL, or one without `://`, has empty host and path and no rule: allowed. Rules with a
null host, path or verdict are ignored; of rules that repeat host and path the one whose verdict sorts first
("allow") holds. Rules of equal length (host and path) give way to the one with the longer host.
Null or repeated page ids each give their row. Only the id and URL columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import A_TO_Z
from weft.llm.exact_dedup import join_groups

DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, A_TO_Z, A_TO_Z.lower()), F.substr(rest, F.char_length(host) + 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Rules as (rev, path, stack): stack holds the enclosing rules and the rule itself, innermost last."""
    clean = rules.select(F.translate("host", A_TO_Z, A_TO_Z.lower()).alias("host"), "path", "verdict").dropna()
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    clean = clean.select(reversed_host(F.col("host")).alias("rev"), "path", F.struct(F.char_length("path").alias("depth"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("frame"))
    heads = F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    opened = clean.select("rev", "path", F.explode(heads).alias("head"))
    outer = clean.select("rev", F.col("path").alias("head"), "frame")
    return opened.join(outer, ["rev", "head"]).groupBy("rev", "path").agg(F.sort_array(F.collect_list("frame")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", parts_per_partition: int = 4) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. `rules` has columns host, path, verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    seen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    stacks = _rule_stacks(rules)
    deepest = stacks.agg(F.max(F.size(F.split("rev", r"\.")))).first()[0] or 0
    if not deepest:
        return seen.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))
    # The same URL parts get the same verdict, so distinct ones are judged and joined back by (host, path).
    targets = seen.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    keys = targets.select("host", "path", F.explode(F.transform(levels, lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))).alias("rev"))
    hosts = stacks.select("rev").distinct()
    load = keys.groupBy("rev").count()
    loads = hosts.join(load, "rev")
    share = loads.agg(F.sum("count")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * parts_per_partition)
    sized = loads.select("rev", F.ceil(F.col("count") * parts / F.lit(max(share, 1))).cast("int").alias("parts"))
    keyed = keys.join(sized, "rev").select("host", "path", "rev", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"), F.concat("rev", "path").alias("key"), F.lit(1).alias("kind"))
    starts = stacks.join(sized, "rev").select(F.lit(None).cast("string").alias("host"), "path", "rev", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "stack", F.concat("rev", "path").alias("key"), F.lit(0).alias("kind"))
    sweep = W.partitionBy("rev", "part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = keyed.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    active = swept.select("host", "path", F.try_element_at(F.filter("open", lambda f: F.startswith(F.col("path"), f["path"])), F.lit(-1)).alias("top"))
    length = F.struct(F.char_length("top.rule"), -F.col("top.depth"))
    best = active.filter("top is not null").groupBy("host", "path").agg(F.max_by("top", length).alias("top"))
    # A URL, or the empty parts of all malformed ones, may be that of a third of the pages.
    out = join_groups(seen, best.select("host", "path", "top.rule", "top.verdict"), "host", "path", how="left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
