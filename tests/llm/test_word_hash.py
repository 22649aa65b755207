"""Words that a polynomial hash modulo 2^64 cannot tell apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillframe.llm import arrow, minhash_dedup, substring_dedup


def thue_morse(letters: str, size: int = 4096) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


A, B = thue_morse("ab"), thue_morse("ba")


def hashes(texts):
    data, offsets = arrow.raw(pa.array(texts))
    starts, stops, _ = arrow.words(data, offsets)
    return arrow.hash_spans(data, starts, stops).tolist()


def test_words_have_hashes_of_their_own():
    words = sorted({"x" * n for n in range(1, 70)} | {f"{i:x}" for i in range(70_000)} | {"a\0", "a", A, B} | {f"{'p' * 30}{i}" for i in range(3000)})
    assert len(set(hashes(words))) == len(words)


def test_hashes_do_not_depend_on_the_place():
    one, many = hashes(["abc " + A + " longer-than-eight"]), hashes(["zz abc", "  longer-than-eight " + A])
    assert one == [many[1], many[3], many[2]]
    assert arrow.hash_spans(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_documents_of_such_words_are_not_copies(spark):
    docs = spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()) == [(1, 1, True), (2, 2, True)]


def test_windows_of_such_words_do_not_repeat(spark):
    common = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{common} {A}"), (2, f"{common} {B}"), (3, f"{common} {A}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 50)]
