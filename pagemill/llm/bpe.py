"""Byte-level BPE as a lazily determinised transducer.

The encoding of a byte string ends, at each position, in exactly one vocabulary token: of the tokens that are suffixes of
the prefix read so far, the one that the merge rules leave standing beside the last token of what precedes it. A state
therefore holds the longest suffix that is still the start of a token (a trie node) and the token paths to those earlier
positions where a later token could still begin. Tokens that all these paths share can change no more and are emitted, so
the lookahead never exceeds the longest token. States and transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Sequence
from itertools import islice

import numpy as np
import regex

#: Contractions that the public pre-tokenizer pattern splits off, in its order.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank in each line."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Transducer:
    """Encodes one pre-token at a time. `keep` bounds the stored transitions; beyond it the store starts anew."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 2_000_000):
        self.ranks = ranks
        self.keep = keep
        self.bytes_of = {r: t for t, r in ranks.items()}
        self._next: dict[int, int] = {}
        self._depth = [0]
        self._token = [-1]
        self._text = [b""]
        for token, rank in ranks.items():
            node = 0
            for i, b in enumerate(token):
                key = node << 8 | b
                child = self._next.get(key)
                if child is None:
                    child = len(self._depth)
                    self._next[key] = child
                    self._depth.append(i + 1)
                    self._token.append(-1)
                    self._text.append(token[: i + 1])
                node = child
            self._token[node] = rank
        self._fail: dict[int, int] = {0: 0}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple] = [(0, -1, ((),))]
        self._ids: dict[tuple, int] = {self._states[0]: 0}
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _suffix(self, node: int) -> int:
        """The node of the longest proper suffix of this node's bytes that starts a token."""
        found = self._fail.get(node)
        if found is None:
            text = self._text[node]
            found = self._walk(self._suffix(self._parent(text)), text[-1]) if len(text) > 1 else 0
            self._fail[node] = found
        return found

    def _parent(self, text: bytes) -> int:
        node = 0
        for b in text[:-1]:
            node = self._next[node << 8 | b]
        return node

    def _walk(self, node: int, b: int) -> int:
        while True:
            child = self._next.get(node << 8 | b)
            if child is not None:
                return child
            if node == 0:
                return 0
            node = self._suffix(node)

    def _stand(self, left: int, right: int) -> bool:
        """Whether the merge rules, applied to the two tokens' bytes alone, give back these two tokens."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > self.keep:
                self._pairs.clear()
            known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._pairs[key] = known
        return known

    def merge(self, data: bytes) -> list[int]:
        """The definition: always merge the adjacent pair of lowest rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _move(self, state: int, b: int) -> tuple[int, tuple[int, ...]]:
        node, last, paths = self._states[state]  # paths[-1] leads to the current position, paths[-1 - d] to d bytes before
        after = self._walk(node, b)
        at = after
        path = None
        while at:
            token = self._token[at]
            if token >= 0:
                before = paths[-self._depth[at]]
                left = before[-1] if before else last
                if left < 0 or self._stand(left, token):
                    path = (*before, token)
                    break
            at = self._suffix(at)
        if path is None:
            raise ValueError(f"byte {b} has no token in this vocabulary")
        live = [*paths, path][-(self._depth[after] + 1) :]
        shared = 0
        shortest = min(map(len, live))
        while shared < shortest and all(p[shared] == path[shared] for p in live):
            shared += 1
        emitted = path[:shared]
        key = (after, emitted[-1] if emitted else last, tuple(p[shared:] for p in live))
        to = self._ids.get(key)
        if to is None:
            to = len(self._states)
            self._states.append(key)
            self._ids[key] = to
        return to, emitted

    def encode(self, data: bytes) -> list[int]:
        if len(self._moves) > self.keep:
            self._reset()
        out: list[int] = []
        state = 0
        moves = self._moves
        for b in data:
            key = state << 8 | b
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, b)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(self._states[state][2][-1])
        return out


def _classes() -> np.ndarray:
    """Class of every code point under the pre-tokenizer pattern."""
    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            # a run may span the surrogates, which no text has
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1])
            table[a : b + 1] = kind
    return table


class Encoder:
    """Texts to token ids: vectorised pre-tokenization, one transducer run for each new pre-token.

    `remember` bounds the pre-tokens whose ids are kept, `letters` their characters; beyond either the store starts anew.
    `chunk` is the number of characters worked on at once.
    """

    def __init__(self, ranks: dict[bytes, int], remember: int = 1_000_000, chunk: int = 4_000_000, letters: int = 30_000_000):
        self.transducer = Transducer(ranks)
        self.classes = _classes()
        self.remember, self.letters = remember, letters
        self.chunk = chunk
        self.lengths_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths_of[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self._index: dict[str, int] = {}
        self._held = 0
        self._flat = np.zeros(1 << 16, np.int32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._counts = np.zeros(1 << 14, np.int64)
        self._used = 0

    def _learn(self, word: str) -> int:
        n = len(self._index)
        ids = self.transducer.encode(word.encode("utf-8", "replace"))
        if n == len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
            self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + len(ids)] = ids
        self._starts[n], self._counts[n] = self._used, len(ids)
        self._used += len(ids)
        self._index[word] = n
        self._held += len(word)
        return n

    def words(self, joined: str, first: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of concatenated texts; `first` marks the texts' first characters."""
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[points]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
        start[after - 1] = True  # the last blank of a run goes with what follows, or stands alone
        start[after] = points[after - 1] != 32
        apostrophes = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
        for at in apostrophes.tolist():
            for ending in CONTRACTIONS:
                if joined.startswith(ending, at + 1) and not first[at + 1 : at + 1 + len(ending)].any():
                    start[at + 1] = False
                    end = at + 1 + len(ending)
                    if end < len(start):
                        start[end] = True
                    break
        return np.flatnonzero(start)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids; null and empty texts have none."""
        ids, counts = [], []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= self.chunk:
                self._encode(group, ids, counts)
                group, size = [], 0
        if group:
            self._encode(group, ids, counts)
        empty = np.zeros(0, np.int64)
        return np.concatenate([*ids, empty.astype(np.int32)]), np.concatenate([*counts, empty])

    def _encode(self, texts: list[str], ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = lengths.cumsum()
        total = int(ends[-1])
        if not total:
            counts.append(np.zeros(len(texts), np.int64))
            return
        first = np.zeros(total, bool)
        first[(ends - lengths)[lengths > 0]] = True
        joined = "".join(texts)
        starts = self.words(joined, first)
        if len(self._index) > self.remember or self._held > self.letters:
            self._forget()
        index = self._index
        learn = self._learn
        bounds = starts.tolist()
        bounds.append(total)
        found = []
        add = found.append
        a = bounds[0]
        for b in bounds[1:]:
            word = joined[a:b]
            n = index.get(word)
            add(learn(word) if n is None else n)
            a = b
        which = np.array(found, np.int64)
        each = self._counts[which]
        to = each.cumsum()
        out = self._flat[np.arange(int(to[-1])) + np.repeat(self._starts[which] - (to - each), each)]
        ids.append(out)
        # ids before each text's end: pre-tokens never cross texts
        upto = np.concatenate([[0], to])[np.searchsorted(starts, ends, "left")]
        counts.append(np.diff(np.concatenate([[0], upto])))


class Utf8Machine:
    """Bytes in pieces to text: an incremental machine that holds back an unfinished character."""

    def __init__(self) -> None:
        self.missing = 0
        self.value = 0
        self.least = 0

    def feed(self, data: bytes, last: bool = False) -> str:
        if not self.missing:  # whole characters at once, up to what may be unfinished or broken
            try:
                return data.decode()
            except UnicodeDecodeError as e:
                return data[: e.start].decode() + self._step(data[e.start :], last)
        return self._step(data, last)

    def _step(self, data: bytes, last: bool) -> str:
        out: list[str] = []
        for b in data:
            if self.missing:
                if b & 0xC0 == 0x80:
                    self.value = self.value << 6 | b & 0x3F
                    self.missing -= 1
                    if not self.missing:
                        good = self.least <= self.value <= 0x10FFFF and not 0xD800 <= self.value <= 0xDFFF
                        out.append(chr(self.value) if good else "�")
                    continue
                out.append("�")
                self.missing = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xE0:
                self.missing, self.value, self.least = 1, b & 0x1F, 0x80
            elif 0xE0 <= b < 0xF0:
                self.missing, self.value, self.least = 2, b & 0x0F, 0x800
            elif 0xF0 <= b < 0xF5:
                self.missing, self.value, self.least = 3, b & 0x07, 0x10000
            else:
                out.append("�")
        if last and self.missing:
            out.append("�")
            self.missing = 0
        return "".join(out)


def decode(ids: Iterable[int], bytes_of: dict[int, bytes], size: int = 4096) -> str:
    """The text of ids, a few at a time: what a piece ends with is held back until the next one ends the character."""
    machine, rest = Utf8Machine(), iter(ids)
    parts = iter(lambda: b"".join([bytes_of[i] for i in islice(rest, size)]), b"")
    return "".join(map(machine.feed, parts)) + machine.feed(b"", last=True)
