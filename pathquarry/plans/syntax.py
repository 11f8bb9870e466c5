"""The filename query language: words, operators and modifiers to a tree.

`a b` both, `a | b` either, `!a` not, `<...>` groups; NOT binds before AND
before OR.  Quotes keep spaces and operators; a word that starts with a quote
has no modifiers.  Modifiers: `ext:` or `exts:`, `path:`, `regex:`.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

MOST_TOKENS = 256
_OPERATORS = b"|!<>"
_SKIPPED = b" \t\n\r"
#: Bytes that end a bare word: ASCII white space and operators.
_ENDS = b" \t\n\r\x0c" + _OPERATORS


class QueryError(ValueError):
    """The query text is not valid."""


@dataclass(frozen=True)
class Word:
    text: bytes
    literal: bool


@dataclass(frozen=True)
class Term:
    pattern: bytes
    whole_path: bool
    regex: bool = False
    fold: bool = True


@dataclass(frozen=True)
class Extension:
    names: tuple[bytes, ...]


@dataclass(frozen=True)
class Not:
    inner: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Term | Extension | Not | And | Or

_BARE = re.compile(rb'(?:"[^"]*"|[^"' + re.escape(_ENDS) + rb"])+", re.S)


def lex(patterns: list[str | bytes]) -> list[bytes | Word]:
    """Operators as single bytes, words as Word."""
    text, at, out = b" ".join(map(os.fsencode, patterns)), 0, []
    while at < len(text):
        c = text[at : at + 1]
        if c in _SKIPPED:
            at += 1
            continue
        if c in _OPERATORS:
            out.append(c)
            at += 1
        else:
            found = _BARE.match(text, at)
            end = found.end() if found else at
            if text[end : end + 1] == b'"':
                raise QueryError("unclosed quote in search expression")
            word = text[at:end].replace(b'"', b"")
            if not word:
                raise QueryError("empty search term")
            out.append(Word(word, c == b'"'))
            at = end
        if len(out) > MOST_TOKENS:
            raise QueryError(f"search expression is too complex (maximum {MOST_TOKENS} tokens)")
    return out


class _Parser:
    def __init__(self, tokens: list[bytes | Word], case_sensitive: bool, whole_path: bool):
        self.tokens, self.at, self.fold, self.whole_path = tokens, 0, not case_sensitive, whole_path

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        token = self.peek()
        self.at += 1
        return token

    def either(self) -> Node:
        node = self.both()
        while self.peek() == b"|":
            self.take()
            node = Or(node, self.both())
        return node

    def both(self) -> Node:
        node = self.one()
        while isinstance(self.peek(), Word) or self.peek() in (b"!", b"<"):
            node = And(node, self.one())
        return node

    def one(self) -> Node:
        token = self.take()
        if token == b"!":
            return Not(self.one())
        if token == b"<":
            node = self.either()
            if self.take() != b">":
                raise QueryError("unclosed <...> search group")
            return node
        if isinstance(token, Word):
            return self.term(token)
        raise QueryError("expected a search term or <...> group")

    def term(self, word: Word) -> Node:
        text, whole, regex = word.text, self.whole_path or b"/" in word.text, False
        if not word.literal:
            head, colon, rest = text.partition(b":")
            if colon and head in (b"ext", b"exts"):
                names = tuple(x.removeprefix(b".") for x in re.split(b"[,;]", rest))
                if any(not x or set(x) & set(b"/\\*?") for x in names):
                    raise QueryError("exts: requires comma-separated extensions, e.g. exts:docx,pdf")
                return Extension(names)
            if colon and head in (b"file", b"folder"):
                raise QueryError("file: and folder: need the type of an entry, which is not stored")
            if colon and head == b"path":
                text, whole = rest, True
            elif colon and head == b"regex":
                text, regex = rest, True
        if not text:
            raise QueryError("empty search term after modifier")
        return Term(text, whole, regex, self.fold)


def parse(patterns: list[str | bytes], case_sensitive: bool = False, whole_path: bool = False) -> Node:
    parser = _Parser(lex(patterns), case_sensitive, whole_path)
    node = parser.either()
    if parser.peek() is not None:
        raise QueryError("unexpected search operator or closing group")
    return node
