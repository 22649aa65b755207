"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def contaminated(text: str | None, items: list[tuple]) -> tuple:
    """(n_words, n_hit, sorted item ids as strings)."""
    words = WORD.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    named.add(item)
    return len(words), len(hit), sorted(str(i) for i in named if i is not None)


def without_repeats(rows: list[tuple], window: int = 50) -> list[tuple]:
    """(id, n_words, n_removed, kept) of each row."""
    first: dict = {}
    for doc, text in rows:
        w = SPACED.findall(text or "")
        for i in range(len(w) - window + 1 if doc is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = SPACED.findall(text or "")
        hit = set()
        for i in range(len(w) - window + 1 if doc is not None else 0):
            if first[tuple(w[i : i + window])] < doc:
                hit.update(range(i, i + window))
        out.append((doc, len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def bag(text: str | None, size: int = 5) -> Counter:
    w = SPACED.findall(text or "")
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def likeness(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def joined(ids: list, links: list[tuple]) -> dict:
    """Least id of each id's component."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_groups(rows: list[tuple], similarity: float = 0.8) -> dict:
    bags = {i: bag(t) for i, t in rows}
    ids = [i for i in bags if bags[i]]
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if likeness(bags[a], bags[b]) >= similarity]
    return joined(list(bags), links)


def pieces(texts: list[str]) -> list[int]:
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [len(x) for x in library.encode(texts, num_threads=1)]


def byte_encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text: str | None) -> list[tuple]:
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def cosine_links(rows: list[tuple], similarity: float = 0.9) -> list[tuple]:
    sane = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sane = [(i, v / np.abs(v).max()) for i, v in sane]
    return [(a, b) for n, (a, x) in enumerate(sane) for b, y in sane[n + 1 :] if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity]
