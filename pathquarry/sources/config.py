"""Configuration: named indexes, their roots and their filters, as TOML."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, replace

from ..functions.paths import is_absolute

FILTERS = ("exclude_dirs", "exclude_paths", "exclude_extensions", "exclude_files")
ENGINES = ("rust", "plocate")


class ConfigError(ValueError):
    """The configuration is not valid."""


@dataclass(frozen=True)
class Filters:
    exclude_dirs: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()

    def over(self, own: dict) -> Filters:
        """Fields that an index states replace those of all indexes; an empty list turns one off."""
        return replace(self, **{k: tuple(own[k]) for k in FILTERS if k in own})


@dataclass(frozen=True)
class IndexConfig:
    name: str
    root: str
    database: str
    filters: Filters = field(default_factory=Filters)
    update_database: str | None = None
    search_database: str | None = None


@dataclass(frozen=True)
class Config:
    indexes: tuple[IndexConfig, ...]
    engine: str | None = None
    outdir: str | None = None

    def select(self, names: tuple[str, ...] = ()) -> tuple[IndexConfig, ...]:
        """Named indexes in the order of the configuration, each once; all if none is named."""
        known = {x.name for x in self.indexes}
        if unknown := [n for n in names if n not in known]:
            raise ConfigError(f"unknown index: {', '.join(unknown)}")
        return tuple(x for x in self.indexes if not names or x.name in names)

    def for_update(self) -> Config:
        return replace(self, indexes=tuple(replace(x, database=x.update_database or x.database) for x in self.indexes))

    def for_search(self) -> Config:
        return replace(self, indexes=tuple(replace(x, database=x.search_database or x.database) for x in self.indexes))


def parse(text: str) -> Config:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error)) from error
    common = Filters().over(raw.get("filters", {}))
    outdir, indexes = raw.get("outdir"), []
    for item in raw.get("index", []):
        name = item.get("name", "")
        if not name or name in (".", "..") or any(c in name for c in "/\\:\0"):
            raise ConfigError(f"invalid index name: {name!r}")
        database = item.get("database") or (os.path.join(outdir, f"{name}.db") if outdir else None)
        if not database:
            raise ConfigError(f"index {name} has no database and there is no outdir")
        indexes.append(IndexConfig(name, item.get("root", ""), database, common.over(item | item.get("filters", {})), item.get("update_database"), item.get("search_database")))
    config = Config(tuple(indexes), raw.get("engine"), outdir)
    _validate(config)
    return config


def _validate(config: Config) -> None:
    if not config.indexes:
        raise ConfigError("there is no index")
    if config.engine is not None and config.engine not in ENGINES:
        raise ConfigError(f"unknown engine: {config.engine}")
    names, databases = [x.name for x in config.indexes], [x.database for x in config.indexes]
    if len(set(names)) < len(names):
        raise ConfigError("index names must differ")
    if len(set(databases)) < len(databases):
        raise ConfigError("databases must differ")
    for x in config.indexes:
        for what, path in (("root", x.root), ("database", x.database)):
            if not is_absolute(os.fsencode(path)):
                raise ConfigError(f"{what} of {x.name} must be absolute: {path!r}")
        if any("/" in d for d in x.filters.exclude_dirs):
            raise ConfigError("exclude_dirs holds names, not paths")


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as file:
        return parse(file.read())


#: What reads a configuration: searching (with its statistics), and updating.
ROLES = {"locate": "locate", "search": "locate", "updatedb": "updatedb", "index": "updatedb"}


def _home(env) -> str:
    return os.path.join(env.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "pathquarry")


def saved(environment: dict[str, str] | None = None) -> dict[str, str]:
    """The configuration saved for each role."""
    try:
        with open(os.path.join(_home(os.environ if environment is None else environment), "roles.json"), encoding="utf-8") as file:
            return json.load(file)
    except FileNotFoundError:
        return {}


def save(role: str, path: str, environment: dict[str, str] | None = None) -> str:
    """Use the file for a role from now on; returns its absolute path."""
    if role not in ROLES:
        raise ConfigError(f"unknown role: {role}")
    path = os.path.abspath(path)
    load(path)  # it must be valid
    env = os.environ if environment is None else environment
    roles = saved(env) | {ROLES[role]: path}
    os.makedirs(_home(env), exist_ok=True)
    target = os.path.join(_home(env), "roles.json")
    with open(f"{target}.new", "w", encoding="utf-8") as file:
        json.dump(roles, file)
    os.replace(f"{target}.new", target)
    return path


def discover(explicit: str | None = None, environment: dict[str, str] | None = None, role: str = "locate") -> str | None:
    """The configuration that applies: given, from the environment, saved for the role, of the user, of the system."""
    env = os.environ if environment is None else environment
    for path in (explicit, env.get("PATHQUARRY_CONFIG"), saved(env).get(ROLES[role])):
        if path:
            return path
    home = os.path.join(_home(env), "config.toml")
    return next((p for p in (home, "/etc/pathquarry/config.toml") if os.path.exists(p)), None)
