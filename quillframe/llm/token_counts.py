"""Token counts of a SentencePiece BPE model by a finite-state transducer.

A token sequence is the model's own segmentation exactly when each of its tokens segments to itself and each
neighbouring pair segments to that pair, because a merge across a boundary would also happen in the pair alone.
So the last token of a prefix follows from what ended a few characters before, and the tokenizer is a deterministic
transducer: a state holds, for each suffix that may still grow into a token, the token that ended before that suffix
and how many tokens have been emitted since. A transition carries the change of the count. States and transitions
are compiled when a text first needs them.

Texts are cut into chunks of fixed length. A chunk's state map tells, for each state in which it may be entered, the state
in which it is left and the tokens emitted on the way. All chunks run side by side from a likely entry state: a space
after another character puts the transducer into one known state whatever came before, so a chunk starts at the last such
space before it, or a fixed way ahead where there is none. States in which a chunk is left but the next one has not been
entered are then added to the next one's map, again side by side, until every exit is an entry. Neighbouring maps are
composed pairwise in a parallel prefix scan, with the counts added up along it; a text's count is its last chunk's
composed map at the start state.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows each get their own result, other columns pass through
(a clashing ``n_bytes``, ``n_tokens`` or ``over_limit`` is replaced), an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.arrow import add_columns, raw

SPACE = "▁"
CHUNK, AHEAD, EACH_FOR_ITSELF = 256, 32, 4


def _fields(data: bytes):
    """(field number, wire type, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at : at + size]
            at += size


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> score of the model's normal pieces. The model must be BPE with byte fallback, the identity
    normaliser, a dummy prefix and kept white space; anything else is refused."""
    pieces, normal, spec, trainer = {}, 1, {}, {}
    with open(path, "rb") as f:
        data = f.read()
    for number, _, value in _fields(data):
        if number == 1:
            entry = {n: v for n, _, v in _fields(value)}
            if entry.get(3, normal) == normal:
                pieces[entry[1].decode()] = float(np.frombuffer(entry[2], "<f4")[0])
        elif number == 2:
            trainer = {n: v for n, _, v in _fields(value)}
        elif number == 3:
            spec = {n: v for n, _, v in _fields(value)}
    if trainer.get(3) != 2 or not trainer.get(35) or spec.get(1) != b"identity" or spec.get(3, 1) != 1 or spec.get(4, 1) != 0:
        raise ValueError("needs a BPE model with byte fallback, identity normaliser, dummy prefix and kept white space")
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or any(c not in pieces for p in pieces for c in p):
        raise ValueError("needs pieces with the space mark at their start only, of characters that are pieces")
    return pieces


class Transducer:
    """Lazily compiled states and transitions over the characters of the texts seen so far."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.start = ("", ((0, None, 0),))
        self.states, self.ids = [self.start], {self.start: 0}
        self.classes = np.zeros(0x110000, np.int32)  # 0: not seen
        self.letters = [""]
        self._table(1 << 14)

    def _table(self, slots: int) -> None:
        """Transitions as an open-addressing table, so memory follows the transitions in use."""
        self.used, self.mask = 0, np.uint64(slots - 1)
        self.keys = np.full(slots, -1, np.int64)  # state << 21 | letter class
        self.next, self.emit = np.zeros(slots, np.int32), np.zeros(slots, np.int8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        """Each key's slot, or the free slot where it would go."""
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & self.mask
        seen = self.keys[at]
        clash = np.flatnonzero((seen != key) & (seen >= 0))
        while len(clash):
            at[clash] = (at[clash] + np.uint64(1)) & self.mask
            seen = self.keys[at[clash]]
            clash = clash[(seen != key[clash]) & (seen >= 0)]
        return at

    def segment(self, text: str) -> list[str]:
        """The model's merges one by one: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.pieces.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def holds(self, before: str | None, token: str) -> bool:
        """Whether ``token`` stands as a token after ``before``."""
        if token not in self.pieces:
            return False
        if token not in self.whole:
            self.whole[token] = self.segment(token) == [token]
        if before is None or not self.whole[token]:
            return self.whole[token]
        pair = (before, token)
        if pair not in self.pairs:
            self.pairs[pair] = self.segment(before + token) == [before, token]
        return self.pairs[pair]

    def step(self, state: tuple, letter: str) -> tuple[tuple, int]:
        suffix, entries = state
        if letter == SPACE and not suffix.endswith(SPACE):
            suffix, entries = self.start
        grown = suffix + letter
        for k, before, since in entries:
            token = grown[len(grown) - k - 1 :]
            if self.holds(before, token):
                change = 1 - since
                break
        else:  # a character outside the vocabulary: one token for each byte, nothing merges with it
            return self.start, len(letter.encode("utf-8", "surrogatepass"))
        kept = [(k + 1, before, since + change) for k, before, since in entries if grown[len(grown) - k - 1 :] in self.prefixes]
        longest = max((k for k, _, _ in kept), default=0)
        return (grown[len(grown) - longest :] if longest else "", (*kept, (0, token, 0))), change

    def compile(self, keys: list[int]) -> None:
        if self.used + len(keys) > len(self.keys) // 2:
            old, to, change = self.keys[self.keys >= 0], self.next[self.keys >= 0], self.emit[self.keys >= 0]
            slots = len(self.keys)
            while self.used + len(keys) > slots // 4:
                slots *= 2
            self._table(slots)
            for k, t, c in zip(old.tolist(), to.tolist(), change.tolist(), strict=True):
                self._put(k, t, c)
        for key in keys:
            after, change = self.step(self.states[key >> 21], self.letters[key & 0x1FFFFF])
            to = self.ids.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
            self._put(key, to, change)

    def _put(self, key: int, to: int, change: int) -> None:
        mask = len(self.keys) - 1
        at = ((key * 0x9E3779B97F4A7C15 % 2**64) >> 32) & mask
        while self.keys[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.next[at], self.emit[at] = key, to, change
        self.used += 1

    def size(self) -> int:
        """About how many bytes are held for what is compiled: measured per state (390 to 540 on prose, random letters and
        base64), judged pair, piece and table slot."""
        return 600 * len(self.states) + 250 * (len(self.pairs) + len(self.whole)) + 13 * len(self.keys)

    def letters_of(self, points: np.ndarray) -> np.ndarray:
        """Letter classes of code points; new letters get a class."""
        found = self.classes[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                self.classes[p] = len(self.letters)
                self.letters.append(chr(p))
            found = self.classes[points]
        return found

    def run(self, letters: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs letters[begin:end] from ``state``, all ranges side by side: exit states and counts."""
        order = np.argsort(begin - end, kind="stable")
        begin, left, now = begin[order], (end - begin)[order], state[order].copy()
        count = np.zeros(len(order), np.int64)
        live = len(order)
        for j in range(int(left[0]) if live else 0):
            live = int(np.searchsorted(-left[:live], -j, "left"))
            key = (now[:live].astype(np.int64) << 21) | letters[begin[:live] + j]
            at = self._slot(key)
            new = self.keys[at] < 0
            if new.any():
                self.compile(np.unique(key[new]).tolist())
                at = self._slot(key)
            count[:live] += self.emit[at]
            now[:live] = self.next[at]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return now[back], count[back]

    def count(self, texts: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        marked = [SPACE + t if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(len(texts), np.int64)
        points = np.where(points == 0x20, np.uint32(0x2581), points)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        letters = self.letters_of(points)
        space = points == 0x2581
        sync = space.copy()
        sync[1:] &= ~space[:-1]
        first = np.cumsum(sizes) - sizes
        sync[first[sizes > 0]] = True
        n = -(-sizes // chunk)
        doc = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        begin = first[doc] + nth * chunk
        end = np.minimum(begin + chunk, first[doc] + sizes[doc])
        last_sync = np.maximum.accumulate(np.where(sync, np.arange(len(points)), -1))[begin]
        likely, _ = self.run(letters, np.maximum(last_sync, begin - AHEAD), begin, np.zeros(len(doc), np.int32))
        exits, counts = self.run(letters, begin, end, likely)
        entries, exits, counts = likely[:, None], exits[:, None], counts[:, None]
        inner, used = np.flatnonzero(nth > 0), np.ones(len(doc), np.int64)
        unsure = last_sync < begin - AHEAD
        ends = np.append(np.flatnonzero(~unsure), len(doc))  # a stretch of unsure chunks reaches to the next sure one
        for turn in itertools.count():  # maps grow until each exit is an entry of the next chunk
            left, known = exits[inner - 1], entries[inner]
            missing = (left >= 0) & ~(left[:, :, None] == known[:, None, :]).any(axis=2)
            rows, columns = np.nonzero(missing)
            if not len(rows):
                break
            new = np.unique(np.column_stack([inner[rows], left[rows, columns]]), axis=0)
            if turn >= EACH_FOR_ITSELF:  # short repeats: the same state will be missing all along the stretch
                reach = ends[np.searchsorted(ends, new[:, 0], "right")] - new[:, 0]
                new = np.unique(np.column_stack([np.repeat(new[:, 0], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach), np.repeat(new[:, 1], reach)]), axis=0)
                new = new[~(entries[new[:, 0]] == new[:, 1:]).any(axis=1)]
            out, emitted = self.run(letters, begin[new[:, 0]], end[new[:, 0]], new[:, 1].astype(np.int32))
            place = used[new[:, 0]] + np.arange(len(new)) - np.searchsorted(new[:, 0], new[:, 0])  # the chunk's next free entries
            grow = max(0, int(place.max()) + 1 - entries.shape[1])
            entries, exits, counts = (np.pad(x, ((0, 0), (0, grow)), constant_values=fill) for x, fill in ((entries, -1), (exits, -1), (counts, 0)))
            for x, values in ((entries, new[:, 1]), (exits, out), (counts, emitted)):
                x[new[:, 0], place] = values
            used += np.bincount(new[:, 0], minlength=len(used))
        return np.bincount(doc, weights=self._composed(entries, exits, counts, nth), minlength=len(sizes)).astype(np.int64)

    @staticmethod
    def _composed(entries: np.ndarray, exits: np.ndarray, counts: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """At each text's last chunk the count of the whole text, zero elsewhere, by a prefix scan over the maps. nth: the
        chunk's place in its text. A text's first chunk has one entry, the start state."""
        after = np.zeros_like(exits, dtype=np.int64)  # which entry of the next chunk each exit is
        inner = np.flatnonzero(nth > 0)
        after[inner - 1] = (exits[inner - 1][:, :, None] == entries[inner][:, None, :]).argmax(axis=2)
        total, width = counts.astype(np.int64), 1
        while width <= nth.max(initial=0):  # each map covers ``width`` chunks up to its own
            late = np.flatnonzero(nth >= width)
            middle = after[late - width]
            total[late], after[late] = total[late - width] + np.take_along_axis(total[late], middle, axis=1), np.take_along_axis(after[late], middle, axis=1)
            width *= 2
        last = np.append(nth[1:] == 0, True) if len(nth) else np.zeros(0, bool)
        return np.where(last, total[:, 0], 0)


MOST_BYTES = 300_000_000  # of a worker process, by the sizes below
_loaded: dict[str, Transducer] = {}  # for each worker process: model path -> what is compiled so far


def count_tokens(docs: DataFrame, model_path: str, *, text: str = "text", limit: int = 4096) -> DataFrame:
    """docs with ``n_bytes``, ``n_tokens`` (no begin, end or other added tokens) and ``over_limit``."""

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            if model_path not in _loaded or _loaded[model_path].size() > MOST_BYTES:  # bounded memory: compile anew
                _loaded[model_path] = Transducer(load_pieces(model_path))
            tokens = _loaded[model_path].count(["" if t is None else t for t in texts.to_pylist()])
            return [pa.array(np.diff(raw(texts)[1])), pa.array(tokens), pa.array(tokens > limit)]

        return compute

    return add_columns(docs, text, "n_bytes long, n_tokens long, over_limit boolean", make)
