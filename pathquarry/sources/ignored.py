"""Directory names that searches hide: a JSON list beside the configuration."""

from __future__ import annotations

import json
import os
import tempfile


def file_of(config_path: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(config_path)), "ignore.json")


def _valid(names: list[str]) -> None:
    for name in names:
        if name in ("", ".", "..") or "/" in name or "\0" in name:
            raise ValueError(f"not a directory name: {name!r}")


def load(config_path: str) -> list[str]:
    try:
        with open(file_of(config_path), encoding="utf-8") as file:
            names = json.load(file)
    except FileNotFoundError:
        return []
    except ValueError as error:
        raise ValueError(f"the ignore list is damaged: {error}") from error
    if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
        raise ValueError("the ignore list is damaged")
    _valid(names)
    return names


def save(config_path: str, names: list[str]) -> None:
    target = file_of(config_path)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(target))
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump(sorted(set(names)), file, ensure_ascii=False, indent=1)
        file.flush()
        os.fsync(file.fileno())
    os.replace(part, target)


def add(config_path: str, names: list[str]) -> list[str]:
    """All names or, if one is invalid, none; names that are there already stay."""
    _valid(names)
    found = sorted({*load(config_path), *names})
    save(config_path, found)
    return found


def remove(config_path: str, names: list[str]) -> list[str]:
    _valid(names)
    found = sorted({*load(config_path)} - {*names})
    save(config_path, found)
    return found
