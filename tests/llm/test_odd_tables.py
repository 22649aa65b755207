"""All operators and stages on tables whose columns are named like every internal and result name, with nulls, empty and
long texts, repeats and no rows."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from quillframe.llm import byte_bpe, decontaminate, embedding_dedup, minhash_dedup, preference_format, quality, secret_scan, substring_dedup, token_counts, toxicity

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SOURCES = Path(minhash_dedup.__file__).parent
#: Every short quoted name in the subpackage, so that new internal names are clashes too.
NAMES = sorted({n for f in [*SOURCES.glob("*.py"), Path(corpus_pipeline.__file__)] for n in re.findall(r'"([A-Za-z_][A-Za-z0-9_]{0,15})"', f.read_text())} - {"doc_id", "text", "lang", "source", "n_chars"} - {"vec_id", "embedding", "conv_id", "turn", "role"})
NAMES = [n for i, n in enumerate(NAMES) if n.lower() not in {m.lower() for m in NAMES[:i]}]

PASSAGE = " ".join(f"pass{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE), (2, PASSAGE + " tail of two"), (1, PASSAGE), (3, None), (4, ""), (4, ""), (None, PASSAGE), (None, None), (5, "other words " * 40), (5, PASSAGE),
    (6, "password = 'abcdefgh1' " + " ".join(f"six{i}" for i in range(30))), (7, "bench one two three four five six seven eight nine ten"), (8, " ".join(f"long{i}" for i in range(20_000))), (9, "grobnik ugh"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 5)) for i in range(1, 10)] + [(None, 1, 1), (99, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def labelled(model, label):
    return lambda docs, items, labels: model.score(docs, model.fit(docs, labels, label=label))


OPERATORS = {
    "minhash": (lambda d, i, x: minhash_dedup.near_duplicates(d), False),
    "decontaminate": (lambda d, i, x: decontaminate.decontaminate(d, i), True),
    "decontaminate_spans": (lambda d, i, x: decontaminate.decontaminate(d, i, remove="spans"), True),
    "contamination": (lambda d, i, x: decontaminate.contamination(d, i), False),
    "substring": (lambda d, i, x: substring_dedup.remove_repeats(d), True),
    "tokens": (lambda d, i, x: token_counts.count_tokens(d, PIECES), True),
    "bpe": (lambda d, i, x: byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), True),
    "toxicity": (labelled(toxicity, "toxic"), True),
    "secrets": (lambda d, i, x: secret_scan.find_secrets(d), True),
    "redact": (lambda d, i, x: secret_scan.redact(d), True),
    "quality": (labelled(quality, "quality"), True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_take_columns_of_any_name(docs, items, labels, name):
    run, passes = OPERATORS[name]
    found = run(docs, items, labels)
    assert len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    clean = [t for t in TEXTS if not brute.contaminated(t[1], ITEMS)[1]]
    assert len(rows) == (len(clean) if name == "decontaminate" else len(TEXTS))
    if passes:
        made = {"n_words", "n_removed", "kept", "n_bytes", "n_tokens", "over_limit", "ids", "decoded", "score", "predicted", "secrets"}
        for r in rows:
            assert all(r[n] == f"own {n}" for n in NAMES if n not in made), name
    assert run(docs.limit(0), items, labels).count() == 0 or name in ("toxicity", "quality")


def test_embeddings_and_pairs_take_columns_of_any_name(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (2, [2.0, 0.0])], "vec_id long, embedding array<double>").select("*", *(F.lit("own").alias(n) for n in NAMES))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]
    turns = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    turns = turns.select("*", *(F.lit("own").alias(n) for n in NAMES))
    pairs = spark.createDataFrame([(0, 0, 1)], "pair_id long, chosen_id long, rejected_id long").withColumns({n: F.lit("own") for n in ("turns", "a", "b", "n", "_conv", "text")})
    assert [r.n_prompt_turns for r in preference_format.format_pairs(turns, pairs).collect()] == [1]


@pytest.fixture(scope="module")
def folder(items, labels, tmp_path_factory):
    """A folder of tables with what the stages read beside the documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    items.write.parquet(f"{at}/benchmark.parquet")
    labels.select("doc_id", "quality", "toxic").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, docs, folder, name, stage):
    found = stage(spark, docs, folder)
    rows = found.collect()
    if name != "tokens":
        assert found.columns == docs.columns and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    if name in ("secrets", "tokens"):
        assert len(rows) == len(TEXTS)
    if name == "secrets":
        assert {r.text for r in rows if r.doc_id == 6} == {TEXTS[10][1].replace("password = 'abcdefgh1", "[SECRET]")}
        assert all(r.n_chars == (7 if r.text is None else len(r.text)) for r in rows)
    if name == "tokens":
        assert all(r.round_trip for r in rows)
    if name == "benchmark_leaks":
        assert sorted(map(str, [(r.doc_id, r.text) for r in rows])) == sorted(map(str, [t for t in TEXTS if t[0] != 7]))
    if name == "near_duplicates":
        expected = [t for i, t in enumerate(TEXTS) if i not in (1, 2, 9)]  # of id 5 only the copy of 1 goes
        assert sorted(map(str, [(r.doc_id, r.text) for r in rows])) == sorted(map(str, expected))
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_without_labels_the_quality_stage_keeps_all(spark, docs, labels, tmp_path):
    for i, few in enumerate((labels.limit(0), labels.where("quality = 1"))):
        few.write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert corpus_pipeline.keep_good(spark, docs, f"{tmp_path}/{i}").count() == len(TEXTS)


def test_stages_pass_columns_without_an_order(spark, docs, folder):
    """A map, which has no order, beside the columns of documents."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", F.create_map(F.lit("k"), "lang").alias("m"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, rows, folder)
        assert found.count() > 0 and (name == "tokens" or all(r.m == {"k": "en"} for r in found.collect())), name


def test_rows_of_one_id_are_judged_by_their_text(spark, folder):
    a, b = PASSAGE, " ".join(f"b{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a, "en"), (1, a, "en"), (4, a, "en"), (4, b, "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, rows, folder).collect()) == [(1, a), (4, b)]


def test_a_cluster_without_a_shared_folder_is_refused():
    from quillframe.llm.storage import shared_folder

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.conf = Conf({"spark.master": "local[2]"})
    assert shared_folder(Session)
