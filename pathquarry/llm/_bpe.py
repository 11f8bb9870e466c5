"""Exact byte-pair encoding by backtracking over longest matches.

Symbols are characters: a byte is its Latin-1 character, and a vocabulary with
word ends uses characters 256..511 for "byte that ends the word".  pyahocorasick
finds the longest vocabulary entry at every position in one pass.  The encoder
takes longest matches and steps back whenever two neighbours could not stand
beside each other after merging in rank order; that test depends on the two
tokens alone and is memoised, so every position is tried a bounded number of
times.
"""

from __future__ import annotations

import base64
import json

import ahocorasick

#: Bytes of a memo, and pairs of tokens in another, before they are dropped; both bound a worker's memory.
MEMO, PAIRS = 128_000_000, 400_000
#: Later than any merge.
NEVER = 1 << 60
#: Bytes of an entry beside its key and value.
ENTRY = 180


class PairBpe:
    """tokens: id -> symbol string (None for ids that are no tokens); ids are merge ranks."""

    def __init__(self, tokens: list[str | None]):
        self.length = [len(t) if t else 0 for t in tokens]
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [-1] * len(tokens)
        for t, i in ids.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := ids.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.fits: dict[int, bool] = {}  # by both ids in one number
        self.merged: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(tokens))]
        for i, t in enumerate(tokens):  # a token is merged from the two parts that stand beside each other before it
            if t is None or len(t) < 2:
                continue
            left = self.shorter[i]
            while left >= 0:
                right = ids.get(t[self.length[left] :])
                if right is not None and left < i and right < i and self._beside(left, right):
                    self.merged[left, right] = i
                    self.parts[i] = (left, right)
                    break
                left = self.shorter[left]
        self.fits.clear()

    def _spine(self, token: int, side: int) -> list[int]:
        """The token, its last (side 1) or first (side 0) part, that one's, and so on down to a symbol."""
        out = [token]
        while (part := self.parts[out[-1]][side]) != out[-1]:
            out.append(part)
        return out

    def _beside(self, a: int, b: int) -> bool:
        """Whether a then b survives merging.

        Merging builds the right spine of a and the left spine of b from their
        symbols up, lowest rank first and the leftmost of equal ones; it must not
        come to a merge of what stands at the border on either side.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        x, y = left.pop(), right.pop()
        while True:
            across = self.merged.get((x, y), NEVER)
            in_a, in_b = left[-1] if left else NEVER, right[-1] if right else NEVER
            if across < in_a and across <= in_b:
                return False
            if in_a == in_b == NEVER:
                return True
            if in_a <= in_b:
                x = left.pop()
            else:
                y = right.pop()

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._beside(a, b)
        return known

    def encode(self, piece: str) -> list[int]:
        n, fits = len(piece), self.fits
        out: list[int] = []
        at, last = 0, -1
        for _, token in self.automaton.iter_long(piece):  # mostly the longest matches stand as they are
            if last >= 0 and not (fits.get(last << 32 | token) or self.compatible(last, token)):
                break
            out.append(token)
            at += self.length[token]
            last = token
        if at == n:
            return out
        # Go on from the first two neighbours that cannot stand beside each other.
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(piece):
            longest[end - self.length[i] + 1] = i
        dead = set()  # places from which nothing reaches the end
        token = longest[at]
        while at < n:
            while token >= 0 and (at + self.length[token] in dead or out and not self.compatible(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at]
            elif out:
                dead.add(at)
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            else:
                raise ValueError("no encoding: a symbol is missing in the vocabulary")
        return out


class Memo(dict):
    """A memo of bounded bytes in two generations: make(key) fills what is missing, and what the last two did not use is forgotten."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.size, self.old = make, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.size += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
        if self.size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


def byte_vocabulary(path: str) -> list[bytes]:
    """A tiktoken file: one base64 token and its rank a line."""
    ranks = {}
    with open(path, "rb") as lines:
        for token, rank in (x.split() for x in lines if x.strip()):
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def visible_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def word_end_vocabulary(path: str) -> tuple[list[str | None], dict[tuple[int, int], int]]:
    """A tokenizers file with word ends: id -> symbols, and merges as pairs of ids."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    back, suffix = visible_bytes(), model["end_of_word_suffix"]

    def symbols(token: str) -> str:
        ends = token.endswith(suffix)
        body = [back[c] for c in (token[: -len(suffix)] if ends else token)]
        if ends:
            body[-1] += 256
        return "".join(map(chr, body))

    vocab = model["vocab"]
    tokens: list[str | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        tokens[i] = symbols(token) if not token.startswith("<|") else None
    merges = {}
    for pair in model["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[a], vocab[b]] = vocab[a + b]
    return tokens, merges


def as_word(data: bytes) -> str:
    """The symbols of a word: its last byte is the one that ends it."""
    return data[:-1].decode("latin-1") + chr(256 + data[-1]) if data else ""
