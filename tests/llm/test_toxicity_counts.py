"""The toxicity model's counts and evidences against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from math import log

import numpy as np

from quillframe.llm import toxicity

PAD = "\x02" * (toxicity.ORDER - 1)


def spelt(k: int, hi: int, lo: int) -> str:
    return "".join(chr(x >> s & toxicity.ONE) for x in (hi, lo) for s in (42, 21, 0))[toxicity.ORDER - k - 1 :]


def grams(word: str, k: int) -> list[str]:
    full = f"{PAD}{word}\x03"
    return [full[i - k : i + 1] for i in range(toxicity.ORDER - 1, len(full))]


def discount(counts) -> float:
    once, twice = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5


def plain_model(rows: list[tuple]):
    """The evidence of a word as a function, from (word, ordinary, toxic) rows: Kneser-Ney by the book."""
    top = toxicity.ORDER - 1
    counts: dict[int, dict[str, list]] = {top: defaultdict(lambda: [0.0, 0.0])}
    for w, *n in rows:
        for g in grams(w, top):
            for y in (0, 1):
                counts[top][g][y] += n[y]
    for k in range(top - 1, toxicity.SHARED - 1, -1):
        counts[k] = defaultdict(lambda: [0.0, 0.0])
        for g, n in counts[k + 1].items():
            for y in (0, 1):
                counts[k][g[1:]][y] += n[y] if g[1] == "\x02" else n[y] > 0
    follow = Counter(g[1:] for g in counts[toxicity.SHARED])
    low = discount(follow.values())
    by_order = {k: [discount([n[y] for n in table.values()]) for y in (0, 1)] for k, table in counts.items()}
    total, kinds = Counter(), Counter()
    for g, n in follow.items():
        total[g[0]] += n
        kinds[g[0]] += 1
    sums, many = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0, 0])
    for table in counts.values():
        for g, n in table.items():
            for y in (0, 1):
                sums[g[:-1]][y] += n[y]
                many[g[:-1]][y] += n[y] > 0

    def evidence(word: str) -> float:
        out = 0.0
        for two, *longer in zip(*(grams(word, k) for k in range(1, toxicity.ORDER)), strict=True):
            p = [(max(follow[two] - low, 0) + low * max(kinds[two[0]], 1) / len(follow)) / max(total[two[0]], 1)] * 2
            for k, g in enumerate(longer, 2):
                n, s, m, d = counts[k].get(g, (0, 0)), sums[g[:-1]], many[g[:-1]], by_order[k]
                p = [(max(n[y] - d[y], 0) + d[y] * m[y] * p[y]) / s[y] if s[y] else p[y] for y in (0, 1)]
            assert all(0 < x <= 1 + 1e-9 for x in p)
            out += log(p[1]) - log(p[0])
        return out

    return evidence


def crowded(spark, n: int = 20_000):
    """Many different random words, so that any fixed number of buckets for their grams would be shared."""
    rng = random.Random(11)
    made = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(1, 14))) for _ in range(n)]
    weights = [(float(rng.randrange(3)), float(rng.randrange(2))) for _ in made]
    rows = [(w, *x) for w, x in dict(zip(made, weights, strict=True)).items() if any(x)]
    return rows, spark.createDataFrame(rows, "word string, ordinary double, toxic double")


def test_grams_that_would_share_a_bucket_keep_counts_of_their_own(spark):
    rows, words = crowded(spark)
    expected = defaultdict(lambda: [0.0, 0.0])
    for w, *n in rows:
        for g in grams(w, toxicity.ORDER - 1):
            expected[g] = [a + b for a, b in zip(expected[g], n, strict=True)]
    found = {spelt(toxicity.ORDER - 1, r.hi, r.lo): (r.ordinary, r.toxic) for r in toxicity._longest(words).collect()}
    assert len(found) > 90_000 and found == {g: tuple(n) for g, n in expected.items()}


def test_evidence_is_that_of_the_exact_counts(spark, monkeypatch):
    rows, words = crowded(spark, 3000)
    table = toxicity._grams(words)
    evidence = plain_model(rows)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(rows)[0] + rng.choice(["", "", "xq", "é🙂"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", " \n", "日本語", "a"]
    texts += texts[:3]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string")
    for blocks, lists, asked in ((1, 1021, 2_000_000), (7, 13, 1)):  # 1: a list's questions stream past its counts one by one
        monkeypatch.setattr(toxicity, "ASKED_AT_ONCE", asked)
        model = toxicity.Model(table, toxicity.discounts(table), lists)
        found = {bytes(r._content): (r.evidence, r.length) for r in toxicity.features(docs.repartition(blocks).select(toxicity._content("_text").alias("_content"), "_text"), model).collect()}
        named = {r._text: bytes(r._content) for r in docs.select("_text", toxicity._content("_text").alias("_content")).collect()}
        assert set(found) == set(named.values())
        for t, content in named.items():
            each = [evidence(w) for w in t.split()]
            size = min(toxicity.WINDOW, len(each))
            best = max((sum(each[i : i + size]) / size for i in range(len(each) - size + 1)), default=0.0) if each else 0.0
            assert np.allclose(found[content], (best, np.log1p(len(each))), atol=1e-4)


def test_rows_that_the_calibration_leaves_are_counted(spark):
    rng = random.Random(3)
    rows = [(i, f"only{i} " + " ".join(rng.choice("abcdef") * 3 for _ in range(9)) + (" grobnik" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, per_class=5)
    known = labels.where(~toxicity.in_hold_out(toxicity.F.col("doc_id"))).count()
    ends = model.grams.where(f"k = {toxicity.ORDER - 1}").collect()
    begun = sum(r.ordinary + r.toxic for r in ends if spelt(r.k, r.hi, r.lo) == PAD + "o")
    assert begun == known - 10


def test_no_table_is_left(spark):
    """The bucketed blocks are dropped once the evidences are written."""
    from quillframe.llm import queries

    found = queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("blocks_")]
