"""Path functions as columns.

Paths are BINARY.  Text functions work on a view that maps each byte to the
Latin-1 character of that number: one character a byte, nothing lost, and
regular expressions apply.  Functions below take and return that view unless
they say otherwise.
"""

from __future__ import annotations

import os
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
_FOLD = str.maketrans(UPPER, LOWER)


def view(raw: Column | str) -> Column:
    return F.decode(raw, "ISO-8859-1")


def raw(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def as_view(value: str | bytes) -> str:
    """A literal in the view: text stands for its UTF-8 bytes."""
    return (os.fsencode(value) if isinstance(value, str) else value).decode("latin-1")


def folded(value: str) -> str:
    return value.translate(_FOLD)


def fold(c: Column) -> Column:
    """Only A-Z change; lower() would change accented letters of the view too."""
    return F.translate(c, UPPER, LOWER)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def last_suffix(name: Column) -> Column:
    """What follows the last dot of a name, dotfiles included; null without a dot."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))


def file_name(path: Column) -> Column:
    """The last component, trailing slashes aside; null where that is none or `..`."""
    name = F.regexp_extract(path, r"(?s)([^/]+)/*\z", 1)
    return F.when((name != "") & (name != ".."), name)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name unless that dot starts it; null without one."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)\A.+\.[^.]*\z"), F.substring_index(name, ".", -1))


def is_root(path: Column) -> Column:
    return path.rlike(r"\A/+\z")


def parent(path: Column) -> Column:
    """The directory that holds a path.  Slashes that start a path are its root and stay as they are."""
    return (
        F.when(F.instr(path, "/") == 0, F.lit(None).cast("string"))
        .when(path.rlike(r"(?s)\A/+[^/]*\z"), F.regexp_extract(path, r"\A(/+)", 1))
        .otherwise(F.regexp_extract(path, r"(?s)\A(.*[^/])/+[^/]*\z", 1))
    )


def ancestors(directory: Column) -> Column:
    """A directory and the directories above it, without the root, as an array."""
    parts = F.regexp_extract_all(directory, F.lit(r"(?s)(/*[^/]+)"), F.lit(1))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """The distinct folded three-byte strings of a text, as an array."""
    low = fold(text)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_key(gram: Column) -> Column:
    """A trigram as the number of its three bytes."""
    return sum(F.ascii(F.substring(gram, k + 1, 1)).cast("int") * 256 ** (2 - k) for k in range(3))


def trigram_set(value: bytes) -> set[str]:
    low = folded(value.decode("latin-1"))
    return {low[i : i + 3] for i in range(len(low) - 2)}


# -- paths of other systems: drive letters and network shares are recognised wherever the engine runs ---------------

_DRIVE = re.compile(rb"[A-Za-z]:(?:[/\\]|\Z)", re.S)


def is_drive_or_share(path: bytes) -> bool:
    return bool(_DRIVE.match(path)) or path.startswith((b"//", b"\\\\"))


def is_absolute(path: bytes) -> bool:
    return path.startswith(b"/") or is_drive_or_share(path)


def portable(path: bytes) -> bytes:
    """Drive and share paths with slashes; a bare drive gets its root."""
    if not is_drive_or_share(path):
        return path
    if len(path) == 2 and path[1:] == b":":
        path += b"/"
    return path.replace(b"\\", b"/")


def comparable(path: bytes) -> bytes:
    """The form in which paths are compared: no trailing slashes, small drive letters, plain share names."""
    if is_drive_or_share(path):
        path = path.replace(b"\\", b"/")
        if path[:8].lower() == b"//?/unc/":
            path = b"//" + path[8:]
        elif path.startswith(b"//?/"):
            path = path[4:]
    if len(path) >= 2 and path[1:2] == b":" and path[:1].isalpha() and path[:1].isascii():
        path = path[:1].lower() + path[1:]
    while len(path) > 1 and path.endswith(b"/") and not (len(path) == 3 and path[1:2] == b":"):
        path = path[:-1]
    return path


_SHARE, _DEVICE = r"(?:[A-Za-z]:(?:[/\\]|\z)|//|\\\\)", r"(?://|\\\\)\?[/\\]"


def _starts(key: str, slash: str) -> str:
    """What text has that equals the key or lies below it."""
    stem = key.removesuffix("/")
    body = "".join(slash if c == "/" else re.escape(c) for c in stem)
    if re.match("[a-z]:", stem):
        body = f"[{stem[0].upper()}{stem[0]}]{body[1:]}"
    return body + (slash if key.endswith("/") else rf"(?:{slash}|\z)")


def _pattern_under(key: str) -> str:
    """For paths as they are, what their comparable form has to the key.  Slashes at the end decide nothing: `key/` is below the key."""
    found = [rf"(?!{_SHARE}){_starts(key, '/')}"]
    if "\\" not in key:  # drive and share paths have none in that form
        either = r"[/\\]"
        found += [rf"(?={_SHARE})(?!{_DEVICE}){_starts(key, either)}", rf"{_DEVICE}(?!(?i:unc){either}){_starts(key, either)}"]
        if key == "/" or key.startswith("//"):
            found.append(rf"{_DEVICE}(?i:unc){either}{_starts(key, either).removeprefix(either * 2) if key != '/' else ''}")
    return rf"\A(?:{'|'.join(found)})"


def under(path: Column, prefix: str | bytes, plain: bool = False) -> Column:
    """Whether a path is the prefix or lies below it, by whole components.  plain: paths are known to be in comparable form.

    One pattern, since a column for the comparable form would repeat the path some hundred times in the plan.
    """
    key = comparable(os.fsencode(prefix) if isinstance(prefix, str) else prefix).decode("latin-1")
    if not key:
        return F.lit(False)
    return (path == key) | path.startswith(f"{key.removesuffix('/')}/") if plain else path.rlike(_pattern_under(key))


def resolve(path: str | bytes, base: str | bytes | None = None) -> bytes:
    """An absolute path without `.` and `..`, by text alone."""
    path = os.fsencode(path)
    if not is_absolute(path):
        path = os.path.join(os.fsencode(base) if base is not None else os.getcwdb(), path)
    path = portable(path)
    share = path.startswith(b"//")
    drive = path[:2] if _DRIVE.match(path) else b""
    parts: list[bytes] = []
    for part in path[len(drive) :].split(b"/"):
        if part == b"..":
            parts = parts[:-1]
        elif part not in (b"", b"."):
            parts.append(part)
    return drive + (b"//" if share else b"/") + b"/".join(parts)


def resolve_user(path: str | bytes, base: str | bytes | None = None) -> bytes:
    """Like resolve, with `~` for the home folder."""
    return resolve(os.path.expanduser(os.fsencode(path)), base)
