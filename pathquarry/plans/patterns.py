"""Globs and regular expressions as column predicates, byte for byte."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import as_view, fold, folded
from .syntax import QueryError

_GLOB = re.compile(rb"[*?\[]")
#: Escapes that mean the same here and there, or what they become.
_CLASSES = {c: f"\\{c}" for c in "dDwWsSAztnrfa"} | {"v": "\\x0B", "b": "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", "B": "(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"}
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "graph": "Graph", "print": "Print", "blank": "Blank", "cntrl": "Cntrl", "xdigit": "XDigit", "space": "Space"}


def _byte(b: int) -> str:
    return f"\\x{b:02X}"


def glob_pattern(pattern: bytes) -> str:
    """A regular expression that matches the whole of what the glob matches."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at : at + 1]
        if c == b"*":
            out.append(".*")
        elif c == b"?":
            out.append(".")
        elif c == b"[":
            negated = pattern[at + 1 : at + 2] in (b"!", b"^") and at + 1 < len(pattern)
            first = at + 1 + negated
            end = pattern.find(b"]", first)
            if end <= first:
                raise QueryError("invalid or unclosed glob character class")
            members = "".join("-" if b == 0x2D else _byte(b) for b in pattern[first:end])
            # A dash at either end, or beside another, is itself.
            members = re.sub(r"\A-|-\Z|(?<=-)-", r"\\x2D", members)
            out.append(f"[{'^' * negated}{members}]")
            at = end
        else:
            out.append(_byte(c[0]))
        at += 1
    return f"(?s)\\A{''.join(out)}\\z"


def glob(target: Column, pattern: bytes, ignore_case: bool = True) -> Column:
    """A pattern without `*?[` is sought anywhere; stars at its ends alone need no regular expression either."""
    text = as_view(pattern)
    stem = text.strip("*")
    if not _GLOB.search(pattern) or not _GLOB.search(stem.encode("latin-1")):
        own, stem = (fold(target), folded(stem)) if ignore_case else (target, stem)
        if not stem:
            return F.lit(True)
        head, tail = text.startswith("*"), text.endswith("*")
        return own.contains(stem) if head == tail else own.endswith(stem) if head else own.startswith(stem)
    java = glob_pattern(pattern)
    check(java)
    return target.rlike(("(?i)" if ignore_case else "") + java)


def check(java: str) -> None:
    """Raise here rather than in a task."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as error:
            raise QueryError(f"invalid pattern: {java}") from error


def regex_pattern(pattern: bytes) -> str:
    """A byte-mode regular expression in Java's dialect; constructs without linear-time meaning are errors."""
    text, out, at, in_class = pattern.decode("utf-8", "surrogateescape"), [], 0, 0
    many_lines = bool(re.search(r"\(\?[a-z]*m", text))

    def refuse(what: str):
        raise QueryError(f"regular expressions with {what} are not supported")

    while at < len(text):
        c = text[at]
        if c == "\\":
            e = text[at + 1 : at + 2]
            if e == "x" and (m := re.compile(r"x([0-9A-Fa-f]{2})|x\{([0-9A-Fa-f]{1,2})\}").match(text, at + 1)):
                out.append(_byte(int(m[1] or m[2], 16)))
                at = m.end()
                continue
            if not e:
                raise QueryError("a regular expression ends with a backslash")
            if e in _CLASSES and not (in_class and e in "bBAz"):
                out.append(_CLASSES[e])
            elif e.isascii() and not e.isalnum():
                out.append(_byte(ord(e)))
            else:
                refuse(f"\\{e}")
            at += 2
            continue
        if in_class:
            if c == "[" and (m := re.compile(r"\[:(\^?)([a-z]+):\]").match(text, at)):
                if m[2] not in _POSIX:
                    refuse(m[0])
                out.append(f"\\{'P' if m[1] else 'p'}{{{_POSIX[m[2]]}}}")
                at = m.end()
                continue
            if text.startswith(("--", "~~"), at):
                refuse("set operators")
            in_class += (c == "[") - (c == "]")
            if not c.isascii():
                refuse("non-ASCII members of a class")
            out.append(c)
            at += 1
            if c == "[" and text[at : at + 1] == "^":
                out.append("^")
                at += 1
            continue
        if c == "[":
            in_class = 1
            m = re.compile(r"\[\^?(\]?)").match(text, at)
            out.append(m[0].replace("]", "\\]"))
            at = m.end()
            continue
        if c == "(" and text.startswith("(?", at):
            m = re.compile(r"\(\?(?:P?<([A-Za-z][A-Za-z0-9]*)>|([ismx]*(?:-[ismx]+)?)([:)]))").match(text, at)
            if not m:
                refuse("look-around or unknown groups")
            out.append(f"(?<{m[1]}>" if m[1] else m[0])
            at = m.end()
            continue
        if c == "$":
            out.append("$" if many_lines else "\\z")
        elif c in "*+?}" and text[at + 1 : at + 2] == "+":
            refuse("possessive repetition")
        elif not c.isascii():
            data = c.encode("utf-8", "surrogateescape")
            out.append(f"(?:{''.join(map(_byte, data))})")
        else:
            out.append(c)
        at += 1
    if in_class:
        raise QueryError("unclosed character class")
    return "(?d)" + "".join(out)


#: A group that repeats or has alternatives, repeated itself: Java may try it in exponentially many ways.
_NESTED = re.compile(r"\)(?:[*+]|\{\d+,?\d*\})")


def linear_pattern(pattern: bytes) -> str:
    """The same expression, which regex_pattern() has accepted, for RE2 over Latin-1."""
    text = pattern.decode("latin-1")
    flags = re.findall(r"\(\?([a-z]*)", text)
    if any("x" in f for f in flags):
        raise QueryError("repeated groups in an expression with the flag x are not supported")
    out = re.sub(r"\\.|\[(?:\\.|\[:.*?:\]|[^\]\\])*\]|\$", lambda m: "\\z" if m[0] == "$" and not any("m" in f for f in flags) else m[0], text, flags=re.S)
    return "".join(c if ord(c) < 128 else _byte(ord(c)) for c in out.replace("(?<", "(?P<"))


def _linear(target: Column, pattern: bytes, ignore_case: bool) -> Column:
    """RE2 by Arrow, in time linear in the text whatever the pattern."""
    re2 = linear_pattern(pattern)
    try:
        pc.match_substring_regex(pa.array([b""]), re2, ignore_case=ignore_case)
    except pa.ArrowInvalid as error:
        raise QueryError(f"invalid pattern: {re2}") from error

    def found(text: pa.Array) -> pa.Array:
        return pc.match_substring_regex(text, re2, ignore_case=ignore_case)

    return F.arrow_udf(found, "boolean")(F.encode(target, "ISO-8859-1"))


def regex(target: Column, pattern: bytes, ignore_case: bool = True) -> Column:
    """Java's engine runs inside code generation, but backtracks; what could take it exponentially long goes to a linear one."""
    java = ("(?i)" if ignore_case else "") + regex_pattern(pattern)
    check(java)
    return _linear(target, pattern, ignore_case) if _NESTED.search(pattern.decode("latin-1")) else target.rlike(java)
