"""Quality rules by weak supervision, DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules of them, whatever the number of documents) estimates how often each rule is
right on good and on bad documents that it votes on; a document's posterior probability of being good is then one expression
over literals. Nothing is learned from labels. The signals are computed in one pass, inside the row,
and stored (by `judge` in a narrow table, by `keep_good` beside the row's own columns); texts are never shuffled.

Defined cases. A null text has no words and no lines, so all its counts are 0, it fails the base and is
not kept. With an empty table the prior decides and the result is empty. Ids may be null or repeat;
every row gives one row. `judge` reads only the id and text columns; `keep_good` gives all columns back, and its helper
columns carry the prefix `__weft_`. Windows and lines are told apart by 64-bit hash and by text, in this order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import WORD_GAP, let, stored, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: A word of up to three letters, as the function words of prose are in many languages.
SHORT_WORD = r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?![^\x20\x09-\x0D,.;:!?])"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sorted_repeats(hashes: Column) -> Column:
    """Sorted hashes that equal the one before."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i > 0) & (h == F.get(s, i - 1))))


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the (ascending) positions."""
    steps = let(positions, lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def _repeat_positions(hashes: Column) -> Column:
    """Ascending positions of the hashes that occur twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = let(pairs, lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _repeat_words(word_hashes: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def count(h: Column) -> Column:
        # The sort of plain longs settles most texts; only those with a repeat sort (hash, position) pairs.
        return F.when(F.size(_sorted_repeats(h)) == 0, F.lit(0).cast("long")).otherwise(_covered(_repeat_positions(h)))

    some = lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows(w), count))
    return let(word_hashes, some)


def signal_struct(text: Column) -> Column:
    """Counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and n_lines and n_short_words, which rules use beside."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    counted = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
        ),
    )
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
    return F.struct(counted.alias("w"), lined.alias("l"), symbols.alias("n_symbols"), F.regexp_count(text, F.lit(SHORT_WORD)).cast("long").alias("n_short_words"))


def _band(value: Column, good_up_to: float, bad_from: float) -> Column:
    return F.when(value <= good_up_to, 1).when(value >= bad_from, -1).otherwise(0)


def rules(signal: Callable[[str], Column] = F.col) -> list[Column]:
    """The default rules, over the signals; each gives 1, -1 or 0. No two look at one trait, as the model takes votes for independent."""
    n = F.greatest(signal("n_words"), F.lit(1))
    mean = signal("word_chars") / n
    return [
        F.when(signal("n_words") >= 50, 1).when(signal("n_words") < 10, -1).otherwise(0),
        F.when((mean >= 3) & (mean <= 10), 1).when((mean < 2) | (mean > 14), -1).otherwise(0),
        _band(signal("n_symbols") / F.greatest(signal("word_chars"), F.lit(1)), 0.01, 0.08),
        F.when(signal("n_lines") < 3, 0).otherwise(_band(signal("n_dup_lines") / F.greatest(signal("n_lines"), F.lit(1)), 0.05, 0.3)),
        _band(signal("n_repeat_words") / n, 0.02, 0.2),
        F.when(signal("n_words") < 20, 0).when(signal("n_short_words") >= 0.15 * n, 1).when(signal("n_short_words") < 0.02 * n, -1).otherwise(0),
    ]


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, steps: int = 50, prior: float = 0.8) -> tuple[float, list[dict[int, float]]]:
    """EM for a two-class model with independent votes: log-odds of the prior, and of each rule's votes.

    An abstention says nothing: a rule is judged by the documents that it votes on. Rules start out 80 % accurate, so that "good"
    stays the class that rules vote 1 for. One pseudo-document a rule, split between its votes, keeps every estimate inside (0, 1).
    """
    good = [{1: 0.8, -1: 0.2} for _ in range(n_rules)]
    bad = [{1: 0.2, -1: 0.8} for _ in range(n_rules)]
    for _ in range(steps):
        base, share = math.log(prior / (1 - prior)), 0.0
        seen = [[{1: 0.5, -1: 0.5} for _ in range(n_rules)] for _ in range(2)]
        for votes, count in patterns:
            odds = base + sum(math.log(good[r][v] / bad[r][v]) for r, v in enumerate(votes) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            share += p * count
            for side, weight in zip(seen, (p * count, (1 - p) * count), strict=True):
                for r, v in enumerate(votes):
                    if v:
                        side[r][v] += weight
        total = sum(c for _, c in patterns)
        prior = min(max((share + 0.8) / (total + 1), 1e-6), 1 - 1e-6)
        good, bad = ([{v: rule[v] / (rule[1] + rule[-1]) for v in rule} for rule in side] for side in seen)
    return math.log(prior / (1 - prior)), [{v: math.log(good[r][v] / bad[r][v]) for v in (1, -1)} | {0: 0.0} for r in range(n_rules)]


def _voted(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with their signals (__weft_s) and votes, stored; and the names of the votes."""
    named = F.struct("__weft_s.w.n_words", "__weft_s.w.word_chars", "__weft_s.n_symbols", "__weft_s.l.n_dup_lines", "__weft_s.w.n_repeat_words", "__weft_s.l.n_lines", "__weft_s.n_short_words")
    rows = rows.withColumn("__weft_s", named)
    votes = {f"__weft_vote{r}": v.cast("int") for r, v in enumerate(rules(lambda c: F.col(f"__weft_s.{c}")))}
    return stored(rows.withColumns(votes), "signals"), list(votes)


def _posterior(rows: DataFrame, names: list[str]) -> Column:
    """Probability of being good, from the votes: fitted over the patterns of all rows."""
    patterns = [(tuple(row[:-1]), row[-1]) for row in rows.groupBy(*names).count().collect()]
    base, weights = estimate(patterns, len(names))
    odds = F.lit(base)
    for name, weight in zip(names, weights, strict=True):
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def _base_failed() -> Column:
    return (F.col("__weft_s.n_words") < 10) | (100 * F.col("__weft_s.n_repeat_words") > 20 * F.col("__weft_s.n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the counts, base_failed, posterior and kept."""
    found, names = _voted(docs.select(F.col(id_col).alias("id"), signal_struct(F.col(text_col)).alias("__weft_s")))
    out = found.withColumn("posterior", _posterior(found, names)).withColumn("base_failed", _base_failed())
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return out.select(F.col("id").alias(id_col), *[f"__weft_s.{c}" for c in SIGNALS], "base_failed", kept.alias("kept"), "posterior")


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, row by row, with their columns: votes are stored beside them, so nothing is joined."""
    found, names = _voted(docs.withColumn("__weft_s", signal_struct(F.col(text_col))))
    return found.filter(~_base_failed() & (_posterior(found, names) >= threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])
