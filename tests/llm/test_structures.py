"""Prefix trie, Merkle manifest and source mix against plain versions, on odd tables and the smallest ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import helpers
import pytest
from pyspark.sql import functions as F

from quillframe.llm import merkle_manifest, prefix_trie, queries, source_mix

SMALL = str(helpers.DATA / "sf0.001")
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df):
    """df with columns named like what the operators make."""
    names = ("nth", "key", "bytes", "head", "suffix", "low", "n", "grp", "id", "leaf", "other", "place", "size", "target", "taken", "_row", "_place", "_tie", "_range")
    return df.select("*", *(F.lit("own").alias(n) for n in names))


# --- plain versions ---------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, said in own.items():
        lent = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:lent] + said[lent:])
    members: dict = {}
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    below: dict = {}
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = below.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[k] for k in kids)
    out = []
    for node, ids in members.items():
        ends = sorted(c for c in ids if len(rebuilt[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), above, len(ids), len(below.get(node, [])), leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def reduced(hashes):
    tree = [hashes]
    while len(tree[-1]) > 1:
        tree.append([sha("".join(tree[-1][i : i + 8])) for i in range(0, len(tree[-1]), 8)])
    return tree


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row, text):
        return sha("".join(map(field, (*row[:4], text))))

    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees = {}
    for lang, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[lang] = reduced([leaf(r, r[4]) for r in found])
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = reduced([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, lang in enumerate(langs):
        for i, row in enumerate(groups[lang]):
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, siblings = leaf(row, text), ""
            for tree, at in ((trees[lang], i), (top, k)):
                for level in tree[:-1]:
                    first = at - at % 8
                    before, after = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    siblings, folded, at = siblings + before + after, sha(before + folded + after), at // 8
            out.append((row[0], leaf(row, row[4]), trees[lang][-1][0], top[-1][0], sha(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def plain_targets(sizes):
    """Targets of {source: words} by repeated reshares."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, rest, still = dict.fromkeys(order, 0.0), float(sum(sizes.values())), list(order)
    while still and rest > 1e-9:
        total = sum(weight[s] for s in still)
        for s in still:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 3 * sizes[s]) for s in still)
        for s in still:
            target[s] = min(target[s], 3.0 * sizes[s])
        still = [s for s in still if target[s] < 3 * sizes[s]]
    return target


# --- prefix trie ------------------------------------------------------------------------------------------------------


def odd_turns():
    rnd, rows = random.Random(3), [(None, 1, "u", "x"), (None, None, None, None)]
    for c in range(-12, 40):
        if c % 7 == 3:
            continue  # some conversations have no base
        for t in range(rnd.choice([1, 2, 3, 5, 8, 12, 63, 64, 65, 128, 130])):
            role = rnd.choice(["u", "a", None]) if t > 8 and rnd.random() < 0.05 else "u"
            text = rnd.choice(["x", "y", None, "zé"]) if t < 3 or rnd.random() < 0.02 else f"long{t}"
            rows.append((c, rnd.choice([t, t, t, None, 3]), role, text))
    return rows


@pytest.mark.parametrize("container", [20_000, 400])
def test_trie_of_odd_turns(spark, monkeypatch, container):
    monkeypatch.setattr(prefix_trie, "CONTAINER", container)
    rows = odd_turns()
    found = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, TURNS)))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_trie(rows)


def test_trie_of_copies_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CONTAINER", 60)
    rows = [(c, t, "u", f"t{t}") for c in range(30) for t in range(3 + c % 2)] + [(1000 + c, t, "u", "new" if t else f"{c}") for c in range(40) for t in range(2)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def tampered(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle_manifest.manifest(df, changed={"text": lower}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


@pytest.mark.parametrize("root_rows", [4096, 16])
def test_manifest_of_odd_rows(spark, monkeypatch, root_rows):
    """Null, negative, huge and repeated ids, more than 512 languages, and one with more than 512 leaves."""
    monkeypatch.setattr(merkle_manifest, "ROOT_ROWS", root_rows)
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 5, 5, -3, -1_000_000, 2**62, 7, i, i]), rnd.choice([None, "a"]), rnd.choice(["en"] * 20 + [None, "", "é"]), rnd.choice([None, 3]), rnd.choice([None, "", "Abc"])) for i in range(900)]
    rows += [(5, "s", "en", 1, "Dup")] * 300 + [(i * 977 + 13, "s", f"x{i % 520}", 1, f"T{i}") for i in range(530)]
    assert sorted(map(tuple, tampered(clashing(spark.createDataFrame(rows, DOCS))).collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, None, None, None, None)], [(1, "s", "en", 2, "Ab")], [(i, "s", "en", 2, "Ab") for i in range(9)]):
        df = spark.createDataFrame(rows, DOCS)
        assert sorted(map(tuple, tampered(df).collect()), key=repr) == plain_manifest(rows)
    assert merkle_manifest.manifest(df).where("verified").count() == 9


# --- source mix -------------------------------------------------------------------------------------------------------


def test_mix_of_odd_rows(spark):
    """Null sources and texts, a source without words, repeated ids and equal rows, a source that is clamped."""
    rnd = random.Random(2)
    rows = [(rnd.choice([i, 7, None]), rnd.choice(["a", "b", "é", None]), " ".join("w" * (i % 40)), rnd.choice(["x", None])) for i in range(400)]
    rows += [(1, "tiny", "one two", "x"), (2, "tiny", None, "x"), (3, "blank", " \t\r\n", "x"), (4, "b", "w " * 5000, "x")] + [(9, "same", "p q r", "x")] * 200
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string, lang string"))
    found = source_mix.mix(docs, keep=("doc_id", "source", "text", "size")).collect()
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, s, text, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    targets = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(targets[r.source], abs=1e-6)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    again = source_mix.mix(docs.repartition(7), keep=("doc_id", "source", "text", "size")).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mix_without_rows_or_words(spark):
    kind = "doc_id long, source string, text string"
    assert source_mix.mix(spark.createDataFrame([], kind)).collect() == []
    assert [(r.target, r.taken) for r in source_mix.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], kind)).collect()] == [(0.0, 0)] * 2


def test_repetitions_have_the_words_taken(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0], " ".join(f"w{j}" for j in range(i + 1))) for i in range(30)], "doc_id long, source string, text string")
    mixed = source_mix.mix(docs, keep=("doc_id", "text")).cache()
    words = source_mix.repetitions(mixed).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == mixed.agg(F.sum("taken")).first()[0]


# --- registered -------------------------------------------------------------------------------------------------------


def test_registered_queries_match_the_plain_versions(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, SMALL).collect()), key=repr) == plain_trie(turns)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, SMALL).collect()), key=repr) == plain_manifest([tuple(r) for r in docs])


def test_mix_stays_in_the_jvm(spark):
    plan = queries.op13_source_mix(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
