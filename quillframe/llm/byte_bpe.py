"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions.

Each partition splits its texts into the pattern's matches, and the distinct matches it has not met become
token-position rows, one for each byte. A recursive query joins neighbouring tokens to the merge table and contracts
each word's leftmost pair of least rank until no word has a pair left. An ordered aggregation gathers a word's ids,
and another one, over the ids' byte strings, decodes them. Texts are then put together from their words' results.

A word of over ``LONG`` bytes is cut into pieces of ``PIECE`` bytes that overlap by half. A sequence of tokens is a word's
encoding exactly when each neighbouring pair is the encoding of the pair's bytes, as a merge across a boundary would also
happen in the pair alone. So where two overlapping pieces share a token, the first one's tokens up to it and the second
one's after it are the encoding of both together. Pieces go through the recursive query like words; neighbours that share
no token are put together and contracted anew, until all do. Pieces grown over ``LOOPED`` bytes (short repeats, such as a
run of one letter) go through the same contraction as a loop, which keeps only the current rows; where no token made of
the merged one has a lower rank, all places of the least pair are contracted at once, which gives the same tokens as one
after the other.

Nulls and empty texts have no ids and decode to no bytes. Repeated rows each get their result, other columns pass
through (clashing result columns are replaced), an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from itertools import chain

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillframe.llm.arrow import add_columns

LONG, PIECE, LOOPED = 64, 48, 512
SLICE, WORDS_AT_ONCE, PIECES_AT_ONCE = 1_000_000, 10_000, 2000  # bytes of text, and words or pieces of a query: they bound a worker's memory
MOST_WORDS = 300_000  # words kept by a worker process before it starts anew

CONTRACT = """
WITH RECURSIVE step(it, w, pos, tok, nxt, nxtpos) AS (
  SELECT 0, w, pos, tok, nxt, nxtpos FROM fresh
  UNION ALL
  (WITH best AS (
     SELECT w, min((rank::BIGINT << 40) | (pos::BIGINT << 20) | nxtpos::BIGINT) AS key
     FROM step JOIN merges ON tok = l AND nxt = r GROUP BY w),
   cut AS (
     SELECT best.w, (key >> 40)::INT AS merged, ((key >> 20) & 1048575)::INT AS p, (key & 1048575)::INT AS q, nxt AS after, nxtpos AS afterpos
     FROM best JOIN step ON step.w = best.w AND step.pos = (key & 1048575))
   SELECT it + 1, s.w, pos,
     CASE WHEN pos = p THEN merged ELSE tok END,
     CASE WHEN pos = p THEN after WHEN nxtpos = p THEN merged ELSE nxt END,
     CASE WHEN pos = p THEN afterpos ELSE nxtpos END
   FROM step s JOIN cut ON s.w = cut.w WHERE pos <> q)
), ended AS (SELECT w, max(it) AS it FROM step GROUP BY w)
SELECT s.w AS w, list(s.tok ORDER BY pos) AS ids, string_agg(piece, '' ORDER BY pos) AS decoded
FROM step s JOIN ended USING (w, it) JOIN pieces USING (tok) GROUP BY s.w ORDER BY s.w
"""

CONTRACT_LONG = """
CREATE OR REPLACE TEMP TABLE grown AS
WITH pair AS (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt FROM long_words),
ranked AS (SELECT w, pos, tok, rank, safe, rank IS NOT NULL AND rank = min(rank) OVER (PARTITION BY w) AS least FROM pair LEFT JOIN merges ON tok = l AND nxt = r),
placed AS (SELECT *, row_number() OVER (PARTITION BY w, least ORDER BY pos) AS nth FROM ranked),
runs AS (SELECT *, pos - min(pos) OVER (PARTITION BY w, least, pos - nth) AS inner_pos FROM placed),
kept AS (SELECT *, least AND inner_pos % 2 = 0 AND (safe OR nth = 1) AS hit FROM runs),
shown AS (SELECT w, pos, CASE WHEN hit THEN rank ELSE tok END AS tok, hit, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM kept)
SELECT w, (row_number() OVER (PARTITION BY w ORDER BY pos) - 1)::INT AS pos, tok, bool_or(hit) OVER (PARTITION BY w) AS moved FROM shown WHERE NOT gone
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with one base64 token and its rank a line. All 256 single bytes must be there."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


class Encoder:
    """A worker's merge table and the words it has encoded so far."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*rows, strict=True))
        early = np.union1d(left[left > rank], right[right > rank])  # tokens that a merge of lower rank uses
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        self._fill("merges", {"l": left, "r": right, "rank": rank, "safe": ~np.isin(rank, early)})
        self._fill("pieces", {"tok": np.array(list(ranks.values()), np.int32), "piece": [t.hex() for t in ranks]})
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size_of[list(ranks.values())] = list(map(len, ranks))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def _fill(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM given")
        self.con.unregister("given")

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts = {"ids": [], "bytes": []}
        self.sizes = {"ids": [], "bytes": []}

    def _rows(self, encoded: list[bytes]) -> dict:
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        w = np.repeat(np.arange(len(encoded), dtype=np.int32), sizes)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.of_byte[np.frombuffer(b"".join(encoded), np.uint8)]
        end = pos == np.repeat(sizes, sizes) - 1
        return {"w": w, "pos": pos, "tok": tok, "nxt": np.where(end, -1, np.append(tok[1:], -1)).astype(np.int32), "nxtpos": np.where(end, -1, pos + 1).astype(np.int32)}

    def _keep(self, fresh: list[str], found: list[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]) -> None:
        """found: (number of tokens of each word, their ids, decoded bytes of each word one after the other, their sizes)."""
        for word in fresh:
            self.known[word] = len(self.known)
        for sizes, ids, decoded, lengths in found:
            self.sizes["ids"].append(sizes)
            self.parts["ids"].append(ids)
            self.parts["bytes"].append(np.frombuffer(decoded, np.uint8))
            self.sizes["bytes"].append(lengths)

    def _contracted(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """Tokens of each byte string by the recursive query, and what they decode to."""
        self._fill("fresh", self._rows(encoded))
        return self._read(self.con.sql(CONTRACT))

    def _looped(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """The same by the loop."""
        rows = self._rows(encoded)
        self._fill("long_words", {k: rows[k] for k in ("w", "pos", "tok")})
        self.con.execute("CREATE OR REPLACE TEMP TABLE finished (w INT, pos INT, tok INT)")
        while self.con.sql("FROM long_words LIMIT 1").fetchall():
            self.con.execute(CONTRACT_LONG)
            self.con.execute("INSERT INTO finished SELECT w, pos, tok FROM grown WHERE NOT moved")
            self.con.execute("CREATE OR REPLACE TEMP TABLE long_words AS SELECT w, pos, tok FROM grown WHERE moved")
        return self._read(self.con.sql("SELECT w, list(tok ORDER BY pos) AS ids, string_agg(piece, '' ORDER BY pos) AS decoded FROM finished JOIN pieces USING (tok) GROUP BY w ORDER BY w"))

    @staticmethod
    def _read(relation) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        found = relation.to_arrow_table()
        ids, decoded = found["ids"].combine_chunks(), found["decoded"].to_pylist()
        lengths = np.fromiter(map(len, decoded), np.int64, len(decoded)) // 2
        return np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy().astype("<u4"), bytes.fromhex("".join(decoded)), lengths

    def _ends(self, data: bytes, spans: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids and their end places within data of each span."""
        out: list = [None] * len(spans)
        for looped in (False, True):
            some = [i for i, (a, b) in enumerate(spans) if (b - a > LOOPED) == looped]
            for at in range(0, len(some), PIECES_AT_ONCE):
                part = some[at : at + PIECES_AT_ONCE]
                sizes, ids, *_ = (self._looped if looped else self._contracted)([data[slice(*spans[i])] for i in part])
                lengths = self.size_of[ids]
                cuts = np.cumsum(sizes)[:-1]
                for i, own, each in zip(part, np.split(ids, cuts), np.split(lengths, cuts), strict=True):
                    out[i] = own, spans[i][0] + np.cumsum(each)
        return out

    def _stitched(self, word: bytes) -> np.ndarray:
        """Token ids of a long word from its overlapping pieces."""
        step = PIECE // 2
        spans = [(a, min(a + PIECE, len(word))) for a in range(0, max(1, len(word) - step), step)]
        found = self._ends(word, spans)
        while True:
            meets = []  # where each piece hands over to the next: after a token that both have
            for (own, ends), (ids, after) in zip(found, found[1:], strict=False):
                at = np.flatnonzero(np.isin(ends, after))
                place = np.searchsorted(after, ends[at])
                same = np.flatnonzero(own[at] == ids[place])  # equal ends and equal tokens
                meets.append((int(at[same[0]]), int(place[same[0]])) if len(same) else None)
            if None not in meets:
                break
            grown, new = [spans[0]], [found[0]]
            for span, tokens, meet in zip(spans[1:], found[1:], meets, strict=True):
                if meet is None:
                    grown[-1], new[-1] = (grown[-1][0], span[1]), None
                else:
                    grown.append(span)
                    new.append(tokens)
            fresh = [i for i, x in enumerate(new) if x is None]
            for i, x in zip(fresh, self._ends(word, [grown[i] for i in fresh]), strict=True):
                new[i] = x
            spans, found = grown, new
        parts, begin = [], 0
        for (own, _), (leave, enter) in zip(found, meets, strict=False):
            parts.append(own[begin : leave + 1])
            begin = enter + 1
        return np.concatenate([*parts, found[-1][0][begin:]]).astype("<u4")

    def learn(self, fresh: list[str]) -> None:
        """Encodes and decodes words that are not known yet."""
        short, long = [], []
        for x in fresh:
            (long if len(x) > LONG // 4 and len(x.encode()) > LONG else short).append(x)
        for at in range(0, len(short), WORDS_AT_ONCE):
            part = short[at : at + WORDS_AT_ONCE]
            self._keep(part, [self._contracted([x.encode() for x in part])])
        if long:
            coded = [self._stitched(x.encode()) for x in long]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.concatenate(coded)
            self._fill("given_ids", {"w": np.repeat(np.arange(len(long), dtype=np.int32), sizes), "pos": np.arange(len(ids)), "tok": ids.astype(np.int32)})
            decoded = [bytes.fromhex(x) for (x,) in self.con.sql("SELECT string_agg(piece, '' ORDER BY pos) FROM given_ids JOIN pieces USING (tok) GROUP BY w ORDER BY w").fetchall()]
            self._keep(long, [(sizes, ids, b"".join(decoded), np.fromiter(map(len, decoded), np.int64, len(decoded)))])

    def joined(self, kind: str, word: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids or bytes of all texts one after the other, and how many each text has."""
        self.parts[kind], self.sizes[kind] = [np.concatenate(self.parts[kind])], [np.concatenate(self.sizes[kind])]
        flat, sizes = self.parts[kind][0], self.sizes[kind][0]
        starts = np.cumsum(sizes) - sizes
        each = sizes[word]
        ends = np.cumsum(each)
        at = np.repeat(starts[word] - (ends - each), each)
        at += np.arange(len(at))
        return flat[at], np.bincount(doc, weights=each, minlength=n_docs).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[pa.Array]:
        """Number of tokens, packed ids and decoded bytes of each text."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        found = [self.pattern.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes, distinct = pd.factorize(np.fromiter(chain.from_iterable(found), object, int(sizes.sum())))
        if not len(distinct):
            empty = pa.array([b""] * len(texts), pa.binary())
            return [pa.array(np.zeros(len(texts), np.int64)), empty, empty]
        self.learn([w for w in distinct if w not in self.known])
        word = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[codes]
        doc = np.repeat(np.arange(len(texts)), sizes)
        ids, n_ids = self.joined("ids", word, doc, len(texts))
        decoded, n_bytes = self.joined("bytes", word, doc, len(texts))
        return [pa.array(n_ids), _binary(ids, n_ids * 4), _binary(decoded, n_bytes)]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_encoders: dict[tuple[str, str], Encoder] = {}  # for each worker process


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """docs with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers, packed) and ``decoded`` (the ids' bytes)."""

    def make():
        key = (ranks_path, pattern)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        return lambda texts: _encoders[key].encode(texts.to_pylist())

    return add_columns(docs, text, "n_tokens long, ids binary, decoded binary", make, SLICE)
