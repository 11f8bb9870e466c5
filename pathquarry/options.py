"""Options and reports of the public calls."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchOptions:
    patterns: tuple[str | bytes, ...] = ()
    indexes: tuple[str, ...] = ()  # all, if none is named
    regex: bool = False  # each pattern is a regular expression, and all must match
    case_sensitive: bool = False
    whole_path: bool = False
    extensions: tuple[str, ...] = ()
    scope: str | bytes | None = None
    files: bool = False
    dirs: bool = False
    existing: bool = False
    ignored: tuple[str, ...] = ()
    offset: int = 0
    limit: int | None = None

    def __post_init__(self):
        if self.files and self.dirs:
            raise ValueError("files and dirs exclude each other")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be greater than zero")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        if not self.patterns:
            raise ValueError("a search needs a pattern")
        for item in self.extensions:
            if not item.lstrip(".") or any(c in item for c in "/\\*?"):
                raise ValueError(f"not an extension: {item!r}")


@dataclass(frozen=True)
class StatsOptions:
    indexes: tuple[str, ...] = ()
    scope: str | bytes | None = None
    recursive: bool = True
    limit: int = 20
    reapply_exclude_paths: bool | None = None  # None: unless a single index is counted from its directories alone


@dataclass(frozen=True)
class RefreshReport:
    entries: int
    scanned: int
    reused: int
    skipped: int
    published: bool
