"""Command line: locate, stats, updatedb, ignore, config, doctor.  Any error exits with 2."""

from __future__ import annotations

import argparse
import os
import sys

COMMANDS = {"locate", "search", "stats", "updatedb", "index", "ignore", "config", "init", "doctor"}

EXAMPLE = """outdir = "/var/lib/pathquarry"

[filters]
exclude_dirs = ["node_modules"]
exclude_extensions = ["tmp"]

[[index]]
name = "home"
root = "/home"
"""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pathquarry")
    top.add_argument("-c", "--config")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("locate", "search"):
        p = commands.add_parser(name)
        p.add_argument("patterns", nargs="+")
        p.add_argument("-d", "--database", action="append", default=[])
        p.add_argument("-C", "--case-sensitive", action="store_true")
        p.add_argument("-p", "--whole-path", action="store_true")
        p.add_argument("-e", "--existing", action="store_true")
        p.add_argument("-r", "--regex", action="store_true")
        p.add_argument("--exts", "--ext", action="append", default=[])
        kind = p.add_mutually_exclusive_group()
        kind.add_argument("--dirs", action="store_true")
        kind.add_argument("--files", action="store_true")
        p.add_argument("--path", dest="scope")
        p.add_argument("-o", "--offset", type=int, default=0)
        p.add_argument("-n", "--max", type=int, dest="limit")
        form = p.add_mutually_exclusive_group()
        form.add_argument("--json", action="store_true")
        form.add_argument("-0", "--null", action="store_true")
    p = commands.add_parser("stats")
    p.add_argument("place", nargs="?")
    p.add_argument("--path", dest="scope")
    p.add_argument("-n", "--max", type=int, dest="limit", default=20)
    p.add_argument("-d", "--database", action="append", default=[])
    p.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
    for name in ("updatedb", "index"):
        p = commands.add_parser(name)
        p.add_argument("action", nargs="?", choices=["update", "init", "list"], default="update")
        p.add_argument("--index", action="append", default=[])
        p.add_argument("--folder", action="append", default=[])
        p.add_argument("-j", "--jobs", type=int, default=8)
    p = commands.add_parser("ignore")
    p.add_argument("action", choices=["add", "list", "rm"])
    p.add_argument("names", nargs="*")
    p = commands.add_parser("config")
    p.add_argument("action", choices=["list", "set", "engine"])
    p.add_argument("value", nargs="?")
    p.add_argument("file", nargs="?")
    commands.add_parser("init")
    commands.add_parser("doctor")
    return top


def with_command(argv: list[str]) -> list[str]:
    """Arguments that name no command are a search; options of the program itself stay in front."""
    at = 0
    while at < len(argv) and (argv[at] in ("-c", "--config") or argv[at].startswith("--config=")):
        at += 1 if "=" in argv[at] else 2
    rest = argv[at:]
    if rest and rest[0] not in COMMANDS and rest[0] not in ("-h", "--help"):
        rest = ["locate", *rest]
    return argv[:at] + rest


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pathquarry").getOrCreate()


def set_engine(path: str, value: str) -> None:
    """Change the one value and nothing else of the file."""
    import re

    from .sources.config import ENGINES

    if value not in ENGINES:
        raise ValueError(f"unknown engine: {value}")
    with open(path, newline="", encoding="utf-8") as file:
        text = file.read()
    head = re.search(r"(?m)^\s*\[", text)
    top = text[: head.start()] if head else text
    changed, n = re.subn(r"""(?m)^(\s*(?:engine|"engine"|'engine')\s*=\s*)("[^"]*"|'[^']*')""", lambda m: m[1] + m[2][0] + value + m[2][0], top, count=1)
    if not n:
        changed = f'engine = "{value}"' + ("\r\n" if "\r\n" in text else "\n") + top
    with open(path, "w", newline="", encoding="utf-8") as file:
        file.write(changed + text[len(top) :])


def run(argv: list[str]) -> int:
    from .operators import output, refresh, search, stats
    from .options import SearchOptions, StatsOptions
    from .sources import config as configs
    from .sources import ignored
    from .sources.snapshot import Store

    args = parser().parse_args(with_command(argv))
    path = configs.discover(args.config, role="updatedb" if args.command in ("updatedb", "index") else "locate")
    if args.command == "init":
        target = path or os.path.expanduser("~/.config/pathquarry/config.toml")
        if os.path.exists(target):
            raise FileExistsError(f"{target} exists")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as file:
            file.write(EXAMPLE)
        print(target)
        return 0
    if args.command == "config" and args.action == "set":
        if not args.value or not args.file:
            raise ValueError("config set needs a role and a file")
        print(configs.save(args.value, args.file))
        return 0
    if args.command == "config" and args.action == "list":
        for role in ("locate", "updatedb"):
            print(f"{role}: {configs.discover(args.config, role=role) or 'none'}")
        return 0
    if path is None:
        raise FileNotFoundError("there is no configuration; `init` writes an example")
    if args.command == "ignore":
        if args.action != "list" and not args.names:
            raise ValueError("which names?")
        names = ignored.load(path) if args.action == "list" else (ignored.add if args.action == "add" else ignored.remove)(path, args.names)
        print("\n".join(names))
        return 0
    if args.command == "config":
        if args.action == "engine" and args.value:
            set_engine(path, args.value)
        print(configs.load(path).engine or "rust")
        return 0
    config = configs.load(path)
    if args.command in ("locate", "search"):
        exts = tuple(x for item in args.exts for x in item.split(","))
        options = SearchOptions(tuple(args.patterns), tuple(args.database), args.regex, args.case_sensitive, args.whole_path, exts, args.scope, args.files, args.dirs, args.existing, tuple(ignored.load(path)), args.offset, args.limit)
        output.write_paths(search.search(session(), config, options), sys.stdout.buffer, args.null, args.json)
    elif args.command == "stats":
        place = args.scope or args.place
        ranking, total = stats.stats(session(), config, StatsOptions(tuple(args.database), place, args.recursive, args.limit))
        output.write_counts(ranking, total, sys.stdout.buffer, sys.stderr.buffer)
    elif args.command in ("updatedb", "index"):
        if args.action == "list":
            for x in config.indexes:
                print(f"{x.name}\t{x.root}\t{x.database}")
        else:
            for name, report in refresh.update(session(), config, tuple(args.index), tuple(args.folder), args.jobs, args.action == "init").items():
                print(f"{name}: {report.entries} entries, {report.scanned} directories read, {report.reused} reused, {report.skipped} skipped")
    else:
        for x in config.indexes:
            found = Store(session(), x).manifest()
            root = "present" if os.path.isdir(x.root) else "missing"
            print(f"{x.name}: root {root}; " + (f"{found.entry_count} entries" if found else "no snapshot"))
    return 0


def main() -> int:
    try:
        return run(sys.argv[1:])
    except SystemExit as end:
        return int(bool(end.code)) * 2
    except Exception as error:  # the command line reports and exits
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
