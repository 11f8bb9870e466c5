"""A plain evaluation of query trees on bytes, to hold the compiled predicates against."""

from __future__ import annotations

import re

from pathquarry.plans.syntax import And, Extension, Not, Or, Term


def glob(pattern: bytes) -> bytes:
    out, i = b"", 0
    while i < len(pattern):
        c = pattern[i : i + 1]
        if c == b"[":
            end = pattern.index(b"]", i + 2 + (pattern[i + 1 : i + 2] in (b"!", b"^")))
            body = pattern[i + 1 : end]
            negated = body[:1] in (b"!", b"^")
            out += b"[" + b"^" * negated + re.escape(body[negated:]).replace(b"\\-", b"-") + b"]"
            i = end
        else:
            out += {b"*": b".*", b"?": b"."}.get(c, re.escape(c))
        i += 1
    return out


def matches(node, path: bytes) -> bool:
    name = path.rsplit(b"/", 1)[-1]
    if isinstance(node, Term):
        target, flags = path if node.whole_path else name, re.S | (re.I if node.fold else 0)
        if node.regex:
            return bool(re.search(node.pattern.replace(b"$", b"\\Z"), target, flags & ~re.S))
        if not re.search(rb"[*?\[]", node.pattern):
            return bool(re.search(re.escape(node.pattern), target, flags))
        return bool(re.fullmatch(glob(node.pattern), target, flags))
    if isinstance(node, Extension):
        return b"." in name and name.rsplit(b".", 1)[1].lower() in {x.lower() for x in node.names}
    if isinstance(node, Not):
        return not matches(node.inner, path)
    both = matches(node.left, path), matches(node.right, path)
    return all(both) if isinstance(node, And) else any(both)


__all__ = ["Or", "matches"]
