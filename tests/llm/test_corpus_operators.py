"""Each operator against its plain version, over nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quillframe.llm import byte_bpe, decontaminate, embedding_dedup, minhash_dedup, preference_format, quality, secret_scan, substring_dedup, token_counts, toxicity

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
rng = random.Random(7)
VOCABULARY = ["alpha", "Beta", "gamma,", "délta", "ÉPSILON", "zeta.", "eta9", "theta", "iota", "kappa", "日本語", "mu nu", "o'mi", "pi"]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n))


LONG = prose(4000)
PASSAGE = prose(70)
BASE = prose(120)
TEXTS = [
    (1, BASE), (2, BASE), (3, " ".join(BASE.split(" ")[:-4])), (4, prose(30) + " " + PASSAGE + "\n" + prose(20)), (5, PASSAGE), (6, prose(5) + "\t" + PASSAGE + " " + prose(9)),
    (7, None), (8, ""), (9, " \n\t "), (10, "one two"), (11, "one two"), (12, LONG), (13, LONG[: len(LONG) // 2]), (14, "the " * 200), (15, "the " * 180), (4, "other text of a repeated id"),
    (1, BASE), (None, BASE), (None, None), (16, "\U0001f642́ \x1c x\x85y <s>▁ a</s> \r\n"), (17, "a" * 700), (18, "=" * 300 + " " * 70 + "abab" * 90),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The texts, with extra columns named like results."""
    rows = [(i, t, "en", None, -1, "x", 2.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, kept string, score double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(t):
    return (t[0] is None, t[0] or 0, str(t[1:]))


def test_token_counts(docs, none):
    found = token_counts.count_tokens(docs, PIECES, limit=500)
    assert "lang" in found.columns and found.columns.count("n_tokens") == 1
    got = sorted(((r.doc_id, r.text, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()), key=key)
    n = brute.pieces([t or "" for _, t in TEXTS])
    assert got == sorted(((i, t, len((t or "").encode()), k, k > 500) for (i, t), k in zip(TEXTS, n, strict=True)), key=key)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_chunk_maps_compose_at_any_size():
    machine = token_counts.Transducer(token_counts.load_pieces(PIECES))
    texts = ["".join(rng.choice("ab  \n\t▁éÉ日本語の\U0001f642x01<>/sñó\x00") for _ in range(rng.choice([0, 1, 2, 3, 50, 400]))) for _ in range(120)] + [" " * 900, "a" * 9000, "日本" * 400, "\n" * 300, "=" * 5000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    expected = brute.pieces(texts)
    for chunk in (64, 256, 10_000):
        assert machine.count(texts, chunk=chunk).tolist() == expected
    short = [t[:100] for t in texts]
    for chunk in (1, 3):
        assert machine.count(short, chunk=chunk).tolist() == brute.pieces(short)


def test_byte_bpe(docs, none):
    library = brute.byte_encoding()
    found = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and r.decoded == (r.text or "").encode()
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_long_words():
    library, encoder = brute.byte_encoding(), byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(of) for _ in range(n))
    texts = ["a" * 2000, "=" * 999, "ab" * 30_000, "日本語" * 90, letters(500, "abcdé"), letters(65), letters(300_000), "the" * 900 + letters(700) + "x" * 3000, letters(5000, "的一是不了人我在有他这"), " " * 5000]
    texts += [letters(rng.randrange(60, 400), ["a", "th", "ing", "é", "日", "aaaa", "tion"]) for _ in range(80)]
    _, ids, _ = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [library.encode_ordinary(t) for t in texts]


def test_substring_dedup(docs, none):
    for largest in (128, 1):  # 1: every shared anchor takes the way of large shards
        found = substring_dedup.remove_repeats(docs, largest_shard=largest)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=key)
        assert got == sorted(brute.without_repeats(TEXTS), key=key)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_suffix_automaton_statistics():
    first, second = [rng.randrange(4) for _ in range(80)], [rng.randrange(4) for _ in range(60)]
    machine = substring_dedup.SuffixAutomaton()
    for part in (first, first[10:50], second):
        machine.add(part)
    probe = [rng.randrange(4) for _ in range(90)]
    known = {tuple(s[i:j]) for s in (first, second) for i in range(len(s)) for j in range(i, len(s) + 1)}
    expected = [max(n for n in range(i + 2) if tuple(probe[i + 1 - n : i + 1]) in known) for i in range(len(probe))]
    assert machine.matching(probe) == expected


def test_minhash_dedup(docs, none):
    found = minhash_dedup.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS)
    rows = [(i, t) for i, t in TEXTS if i is not None and (i, t) != (4, "other text of a repeated id")]
    expected = brute.near_groups(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected
    assert expected[3] == 1 and expected[15] == 14 and expected[11] == 10
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert {r.class_id for r in found if r.doc_id in (1, 2)} == {1} and {r.kept for r in found if r.doc_id in (2, 11)} == {False}
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_signatures_estimate_weighted_jaccard():
    run = np.arange(1, 401, dtype=np.uint64)
    w = np.array([rng.choice([1, 1, 2, 5, 40]) for _ in run])
    v = np.array([max(1, x + rng.choice([-1, 0, 0, 3])) for x in w])
    v[:60] = 0
    doc = np.repeat([0, 1], len(run))
    both, weight = np.concatenate([run, run]), np.concatenate([w, v])
    use = weight > 0
    hits = []
    for salt in range(30):
        t = minhash_dedup.signatures(doc[use], minhash_dedup.mix(both + np.uint64(salt * 1000))[use], weight[use], 2)
        hits.append((t[0] == t[1]).mean())
    assert abs(np.mean(hits) - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.03


def test_a_chain_of_near_copies_stays_one_group(spark):
    """Neighbours are near, ends are not."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words[5 * i : 5 * i + 5] = [f"x{i}_{k}" for k in range(5)]
        rows.append((i, " ".join(words)))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.near_groups(rows) and {r.component_id for r in found} == {0}


def test_large_buckets_are_compared_in_blocks(spark):
    """Two families of 700 texts that share buckets, near within and not across, and strays between: more members in a
    bucket than any block holds, and links that only the comparison of blocks finds."""
    own = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    other = [*base[:150], *(f"v{i}" for i in range(50))]
    rows = []
    for i in range(1400):
        words = list(base if i % 2 else other)
        words[own.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=64).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 2 for i, _ in rows}  # within a family 0.9 and more, across 0.6


def test_suspects_of_a_bucket_need_only_its_minority(spark):
    rows = [(0, i, 0, 50, np.zeros(minhash_dedup.PLACES, "<u2").tobytes()) for i in range(1000)] + [(0, 5000, 1, 50, np.zeros(minhash_dedup.PLACES, "<u2").tobytes())]
    members = spark.createDataFrame(rows, "key long, rep long, comp long, n_shingles long, signature binary")
    found = minhash_dedup._suspects(members, 0.62, 100).collect()
    assert len(found) == 1000 + 11 and {r.x for r in found} == {0} and {r.rep for r in found if r.minor} == {5000}


ITEMS = [(1, PASSAGE), (2, "one TWO"), (3, None), (4, "--"), (5, prose(11)), (None, " ".join(PASSAGE.split(" ")[:12])), (6, "theta")]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = sorted(((i, *brute.contaminated(t, ITEMS)) for i, t in TEXTS), key=key)
    for most in (100_000, 0):  # 0: by a shuffle, without the vocabulary
        found = decontaminate.contamination(docs, items, most_broadcast=most).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in found), key=key) == expected
    clean = decontaminate.decontaminate(docs, items)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((tuple(r) for r in docs.collect() if not brute.contaminated(r.text, ITEMS)[1]), key=str)
    spans = decontaminate.decontaminate(docs, items, remove="spans")
    assert spans.count() == docs.count() and spans.where("doc_id = 10").first().text == "" and spans.where("doc_id = 17").first().text == "a" * 700
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


SECRETS = ["password = 'abcdefgh1'", "PASSWD:short", "token=secret=abcdefgh", "token: secret = longvalue123", "x AKIAABCDEFGHIJKL12 AKIA1 y", "é🙂 " + "0af" * 20 + " api_key=\"Zz0123456789\"", "apikey=0123456789abcdef0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, None, "", "nothing"]


def test_secret_scan(spark):
    rows = [(i, t, "k") for i, t in enumerate([*SECRETS, SECRETS[0], "pad " * 5000 + SECRETS[0]])] + [(None, SECRETS[0], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    found = secret_scan.find_secrets(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s.start, s.ord, s.kind, s.stop) for s in r.secrets if s.kind in secret_scan.BASE] == brute.base_secrets(r.text)
    assert {s.kind for r in found for s in r.secrets} >= {"private_key", "github"}
    redacted = secret_scan.redact(docs)
    assert redacted.columns == docs.columns and redacted.where("secrets = 'k'").count() == len(rows)
    masked = {r.doc_id: r.text for r in redacted.collect()}
    assert masked[5] == "é🙂 [SECRET] [SECRET]" + '"' and masked[6] == "[SECRET]" and masked[9] is None and masked[11] == "nothing"
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_trigram_queries_are_necessary():
    for rule in secret_scan.RULES:
        for text in SECRETS:
            if text and __import__("re").search(rule.pattern, text):
                assert all(any(all(g in text.lower() for g in alternative) for alternative in clause) for clause in secret_scan.trigram_query(rule.pattern))
    assert secret_scan.trigram_query("[0-9a-f]+") == [] and secret_scan.trigram_query("ab") == []


def test_preference_format(spark):
    turns = [(0, 0, "system", "be"), (0, 1, "user", "hi"), (0, 2, "assistant", "yes"), (1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"), (1, 3, "user", None), (2, 0, "user", "a"), (2, None, None, "z"), (3, 0, "user", "a"), (3, None, None, "z"), (None, 0, "user", "lost")]
    conversations = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 0, 9)], "pair_id long, chosen_id long, rejected_id long")
    found = {r.pair_id: r for r in preference_format.format_pairs(conversations, pairs).collect()}
    assert set(found) == {0, 1}
    first = found[0]
    assert first.n_prompt_turns == 2 and first.prompt == "<|system|>\nbe<|end|>\n<|user|>\nhi<|end|>\n" and first.chosen == "<|assistant|>\nyes<|end|>\n"
    assert [first.chosen[int(a) : int(b)] for a, b in (x.split(":") for x in first.chosen_mask.split(","))] == ["yes"]
    assert [first.rejected[int(a) : int(b)] for a, b in (x.split(":") for x in first.rejected_mask.split(","))] == ["no"]
    assert found[1].n_prompt_turns == 2 and (found[1].chosen, found[1].rejected, found[1].chosen_mask) == ("", "", "")
    assert preference_format.format_pairs(conversations.limit(0), pairs).count() == 0


def vector(*at: float) -> list[float]:
    return [*at, *[0.0] * (8 - len(at))]


def checked_links(found, rows):
    expected = brute.cosine_links(rows)
    groups = brute.joined([i for i, _ in rows if i is not None], expected)
    degree = {i: sum(i in p for p in expected) for i in groups}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (degree[i], groups[i], groups[i] == i) for i in groups}


def test_embedding_dedup(spark):
    made = np.random.default_rng(3)
    rows = [(i, made.normal(size=8).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 5][1]) * 2 + made.normal(size=8) * 0.1).tolist()) for i in range(40)] + [(200 + i, rows[0][1]) for i in range(5)]
    rows += [(300, None), (301, vector()), (302, vector(float("nan"))), (303, vector(float("inf"))), (304, [1.0]), (305, [None, *vector(1.0)[1:]]), (306, []), (None, rows[1][1])]
    rows += [(310, [1.0, 2.0]), (311, [2.0, 4.0]), (312, [1e200, 0.0, 0.0]), (313, [2e200, 0.0, 0.0]), (314, [1e-300, 1e-310, 0.0]), (315, [-3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    for block in (2048, 16):  # 16: lists are cut into blocks
        checked_links(embedding_dedup.near_duplicates(df.where("vec_id IS NOT NULL"), block=block).collect(), [r for r in rows if r[0] is not None])
    assert embedding_dedup.near_duplicates(df).where("vec_id IS NULL AND n_links IS NULL").count() == 1
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_registered_parameters(spark):
    """Pairs at a cosine just above the threshold, with pivots instead of one list."""
    made = np.random.default_rng(5)
    x = made.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = made.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    assert embedding_dedup.pivot_plan(len(rows), 64)[0] > 1
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in found) >= 0.98 * 2 * len(x)


def test_pivots_and_depth_grow_with_the_vectors():
    plans = [embedding_dedup.pivot_plan(10**k, 64) for k in range(2, 11)]
    assert plans[0] == (1, 1) and all(a <= b for a, b in zip(plans, plans[1:])) and plans[-1][0] * 64 * 8 <= embedding_dedup.PIVOT_BYTES


@pytest.mark.parametrize("model", [quality, toxicity])
def test_classifiers_survive_odd_tables(spark, docs, none, model):
    odd = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert model.fit(docs, odd.limit(0)) is None and model.fit(none, odd) is None
    scored = model.score(docs, None)
    assert scored.count() == len(TEXTS) and scored.columns.count("score") == 1


def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 3 == 0, i % 5 == 0
        words = prose(60).split(" ")
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            words[rng.randrange(60)] = "grobnik" + rng.choice(["", "s", "ul", "ov"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_the_hold_out(spark):
    docs, labels = labelled(spark)
    for model, label, threshold in ((quality, "quality", 0.7), (toxicity, "toxic", 0.3)):
        scored = model.score(docs, model.fit(docs, labels)).withColumn("held_out", quality.in_hold_out(F.col("doc_id")))
        held = scored.join(labels, "doc_id").where("held_out").collect()
        assert np.mean([r.predicted == r[label] for r in held]) > 0.9, label
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in scored.collect())


def test_quality_scores_are_those_of_the_compressors(spark):
    """Every score from a compression of its own, and the dictionaries from the sampled rows alone."""
    import zstandard

    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(docs, model).collect():
        data = (r.text or "").encode()
        good, bad = (len(c.compress(data)) for c in pair)
        difference, share = (bad - good) / (bad + good + 1), good / (len(data) + 1)
        at = float(np.dot(model.weights, [difference, share, share**2, np.log1p(len(data)), difference * share, 1]))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(at, -30, 30)))) < 1e-9
    few = quality.fit(docs, labels, per_class=5, pieces=1)
    assert few is not None and few.good != model.good


def test_a_logistic_fit_ends_on_separable_and_skewed_rows():
    own = np.random.default_rng(2)
    x = np.column_stack([own.normal(size=300) * 1e-3, own.normal(size=300) * 1e4, np.ones(300)])
    y = (x[:, 0] > 0).astype(float)
    at = x @ quality.logistic(x, y)
    assert np.isfinite(at).all() and ((at > 0) == (y == 1)).mean() > 0.99
