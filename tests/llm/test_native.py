"""Exact dedup, quality rules, URL rules and mixing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import exact_dedup, mixing, queries, quality_rules, url_filter
from weft.llm.common import table

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_dedup_brute_force(spark, docs):
    rng = random.Random(1)
    texts = [rng.choice(["a", "b", "", None, "long " * 5000, "a ", f"u{i}"]) for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_joined_filter_and_odd_rows(spark, docs):
    rows = docs([(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, None), (3, ""), (None, None)]).withColumn("keep_id", F.lit("own"))
    wide = exact_dedup.exact_duplicates(rows, broadcast_bytes=0).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in wide if r.keep_id == 1) == [(False, 1, 3, True), (False, 1, 3, True), (True, 1, 3, False)]
    assert [(r.group_size, r.kept) for r in wide if r.text_sha256 == hashlib.sha256(b"y").hexdigest()] == [(1, True)]
    kept = exact_dedup.drop_exact_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "", r.keep_id) for r in kept.collect()) == [(0, "y", "own"), (1, "x", "own"), (3, "", "own")]
    assert exact_dedup.exact_duplicates(rows.limit(0)).count() == 0


def exchanges(df):
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return [line for line in plan.split("\n") if "Exchange" in line or "output" in line.lower()], plan


def test_no_exchange_carries_texts(spark, docs):
    rows = docs([f"text number {i % 40}" for i in range(100)])
    for limit in (0, 64 << 20):
        out = exact_dedup.exact_duplicates(rows, broadcast_bytes=limit)
        assert "text#" not in exchanges(out)[1] and out.filter("kept").count() == 40
    stay, copies = exact_dedup.split_copies(rows, "doc_id", "text", broadcast_bytes=0)
    assert (stay.count(), copies.count()) == (40, 60) and stay.agg(F.sum("__weft_size")).first()[0] == 100


def test_hot_groups_are_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 3)
    rows = docs([(i, f"t{i}" if i % 3 else ["hot", "", None][i % 2]) for i in range(60)])
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(rows).collect()}
    assert len(got) == 60 and all((got[i].group_size, got[i].keep_id) == (10, 54 + i % 2 * 3) for i in range(0, 60, 3))
    left = exact_dedup.join_groups(rows.select("doc_id", "text"), rows.filter("text = 'hot'").select("text", F.lit(1).alias("x")).distinct(), "text", how="left")
    assert left.count() == 60 and left.filter("x = 1").count() == 10


def brute_signals(text):
    text = text or ""
    w = GAP.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if GAP.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def check_signals(df):
    texts = {r.doc_id: r.text for r in df.collect()}
    got = quality_rules.judge(df).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, rep = want = brute_signals(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)
    return got


def test_quality_signals_on_table(spark):
    got = check_signals(table(spark, SF, "documents"))
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert all(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_edge_cases(spark, docs):
    rng = random.Random(2)
    texts = [None, "", " \n\t\n", "a b c d e a b c d e", "x\nx\n\nx \nx", "é#ü *\u00a0|", "w " * 30_000, "\U0001f600 " * 7]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    check_signals(docs(texts))
    assert quality_rules.judge(docs(["a"]).limit(0)).count() == 0
    wide = docs([(1, "good clean words in a row make up this line of text right here"), (None, None)]).withColumn("kept", F.lit(1))
    assert quality_rules.keep_good(wide).columns == wide.columns


def brute_em(votes, steps=50, prior=0.8):
    """The two-class model over documents one by one, in numpy; posteriors."""
    x = np.stack([votes == v for v in (1, -1)], 2).astype(float)  # document, rule, vote
    good = np.tile([0.8, 0.2], (x.shape[1], 1))
    bad = good[:, ::-1]
    posterior = lambda: 1 / (1 + (1 - prior) / prior * np.exp(np.einsum("drv,rv->d", x, np.log(bad) - np.log(good))))
    for _ in range(steps):
        p = posterior()
        counts = [np.einsum("d,drv->rv", w, x) + 0.5 for w in (p, 1 - p)]
        good, bad = (c / c.sum(1, keepdims=True) for c in counts)
        prior = min(max((p.sum() + 0.8) / (len(p) + 1), 1e-6), 1 - 1e-6)
    return posterior()


def brute_votes(text):
    n, chars, symbols, dup, rep = brute_signals(text)
    lines = sum(bool(GAP.search(x)) for x in (text or "").split("\n"))
    short = sum(bool(re.fullmatch(r"[^\W\d_]{1,3}(?:[,.;:!?].*)?", w)) for w in GAP.findall(text or ""))
    band = lambda x, low, high: 1 if x <= low else -1 if x >= high else 0
    mean, m = chars / max(n, 1), max(n, 1)
    return [
        1 if n >= 50 else -1 if n < 10 else 0,
        1 if 3 <= mean <= 10 else -1 if mean < 2 or mean > 14 else 0,
        band(symbols / max(chars, 1), 0.01, 0.08),
        0 if lines < 3 else band(dup / lines, 0.05, 0.3),
        band(rep / m, 0.02, 0.2),
        0 if n < 20 else 1 if short >= 0.15 * n else -1 if short < 0.02 * n else 0,
    ]


def test_verdict_against_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    posterior = brute_em(np.array([brute_votes(r.text) for r in rows]))
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, SF, "documents")).collect()}
    for r, p in zip(rows, posterior, strict=True):
        assert got[r.doc_id].posterior == pytest.approx(p, abs=1e-6)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= 0.5)


def test_em_separates_patterns():
    base, weights = quality_rules.estimate([((1, 1, 1), 80), ((1, 1, 0), 10), ((-1, -1, -1), 8), ((-1, -1, 0), 2), ((1, -1, 1), 3)], 3)
    score = lambda v: base + sum(w[x] for w, x in zip(weights, v))
    assert score((1, 1, 1)) > 0 > score((-1, -1, -1))
    assert score((0, 0, 0)) == base and all(w[0] == 0 for w in weights)  # abstentions say nothing


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_clean_documents_are_kept_at_every_size(spark, sf):
    judged = quality_rules.judge(table(spark, f"/root/testdata/{sf}", "documents")).filter("not base_failed")
    found = judged.join(table(spark, f"/root/testdata/{sf}", "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in found}
    assert share[1] >= 0.995 and share[0] <= 0.1


def brute_url(url, rules):
    rest = re.match(r"[^?#]*", url.split("://", 1)[1])[0] if url and "://" in url else ""
    host, slash, path = rest.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    top = max(fits, default=(0, 0, None, "allow"))
    return host, path, top[2], top[3]


def test_url_rules_brute_force(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "EXAMPLE.org", "xexample.com", "org", "", "a..b"]
    paths = ["", "/", "/a", "/a/b", "/a/b/c?x=/q", "/ab#f", "?q", "/é/x"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice([h.lower() for h in hosts if h]), rng.choice(["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/é"])) for _ in range(25))}.values())
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', '://', ':/'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "x://", "http://a://b.com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(0))
    table_of = spark.createDataFrame(rules + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table_of).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages, table_of.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter.judge_urls(pages.limit(0), table_of).count() == 0


def brute_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        for s in over or open_:
            out[s] = 3.0 * sizes[s] if over else level * w[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("case", ["table", "made"])
def test_mix(spark, docs, case):
    df = table(spark, SF, "documents") if case == "table" else docs([(i, "w " * (i % 7), "en", ["b", "a", None, "é", "tiny"][i % 4 if i else 4]) for i in range(400)])
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    first, again = ({r.doc_id: r for r in mixing.mix(x).collect()} for x in (df, df.repartition(3)))
    assert first == again
    assert {i: r.size for i, r in first.items()} == {r.doc_id: len(GAP.findall(r.text or "")) for r in df.collect()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for i, r in first.items():
        sizes[source[i]] += r.size
        taken[source[i]] += r.taken
        largest[source[i]] = max(largest[source[i]], r.size)
        assert r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for i, r in first.items():
        assert r.target == pytest.approx(want[source[i]]) and r.source_size == sizes[source[i]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
        epochs = want[s] // sizes[s] if sizes[s] else 0
        assert all(first[i].taken >= epochs * first[i].size for i in first if source[i] == s)


def test_mix_edge_cases(spark, docs):
    assert mixing.mix(docs(["a"]).limit(0)).count() == 0
    none = docs([(1, None), (None, ""), (2, " ")])
    assert {(r.size, r.target, r.taken) for r in mixing.mix(none).collect()} == {(0, 0.0, 0)}
    wide = docs([(i, "a b c", "en", f"s{i % 2}") for i in range(10)]).withColumn("target", F.lit("own"))
    out = mixing.take_mix(wide)
    assert out.columns == wide.columns and out.count() == 10


def fraction(rows, source, sizes, weight=lambda i: 1.0):
    """Ids that a source's fraction takes, worked out one by one."""
    key = lambda i, t: (-math.log((int(hashlib.md5(f"7|{'' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight(i), i)
    order, at, taken = sorted((key(i, t), n) for i, t, s, n in rows if s == source), 0, []
    for (_, i), n in order:
        if sizes <= 0 or at + n / 2 > sizes:
            break
        taken.append(i)
        at += n
    return taken


def test_mix_with_small_weights_is_a_sample(spark, docs):
    """Weights of 0.01 keep the draw's order: no key saturates, so it does not fall to the id."""
    rows = [(i, f"w{i}", "en", ["a", "b"][i % 2]) for i in range(3000)]
    tiny = lambda text: F.lit(0.01)
    got = {r.doc_id: r for r in mixing.mix(docs(rows), quality=tiny).collect()}
    for source, target in (("a", 1000), ("b", 2000 - 1500)):
        want = fraction([(i, t, s, 1) for i, t, _, s in rows], source, target, lambda i: 0.01)
        base = 1 if source == "b" else 0
        assert {i for i, r in got.items() if rows[i][3] == source and r.copies > base} == set(want)
        assert abs(sum(want) / len(want) - 1500) < 120  # the ids of a sample are spread evenly


def test_take_mix_row_by_row(spark, docs, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, i]), " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5))), "en", ["a", "b", None][i % 3]) for i in range(240)]
    for limit in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        df = docs(rows).withColumn("key", F.lit("own"))
        taken = mixing.take_mix(df)
        assert taken.columns == df.columns
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id, r.size] += r.copies
        have = Counter()
        for r in taken.collect():
            have[r.doc_id, len(GAP.findall(r.text))] += 1
        assert have == Counter({k: v for k, v in want.items() if v})


def test_mix_prefers_quality(spark, docs):
    rows = [(i, "a b c d " + ("#" * 60 if i % 2 else ""), "en", f"s{i % 4 // 2}") for i in range(2000)]
    got = mixing.mix(docs(rows)).filter("copies > 0").collect()
    s0 = Counter(r.doc_id % 2 for r in got if r.doc_id % 4 < 2)
    assert s0[0] > 2 * s0[1]


def test_registered_natives_run(spark):
    assert queries.op1_exact_dedup(spark, SF).count() == 200
