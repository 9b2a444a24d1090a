"""Command line: lint files, add words, clean the cache.

    python -m quillspark.cli [--root DIR] lint [-u] [-s] [--lexicon FILE] FILES...
    python -m quillspark.cli [--root DIR] add [-g] WORDS...
    python -m quillspark.cli clean [--cache DIR]
    python -m quillspark.cli regions FILE
    python -m quillspark.cli [--root DIR] settings [PATH]
    python -m quillspark.cli [--root DIR] serve [--lexicon FILE]

lint exits with 0 if nothing was found, 1 if something was, 2 if something failed.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from .plans.policy import Policy


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    lint = commands.add_parser("lint")
    lint.add_argument("-u", "--unique", action="store_true")
    lint.add_argument("-s", "--suggest", action="store_true")
    lint.add_argument("--lexicon", action="append", default=[], help="a word list; the first is primary")
    lint.add_argument("--dictionaries", help="a folder of <id>.txt or <id>.aff and <id>.dic")
    lint.add_argument("files", nargs="+")
    add = commands.add_parser("add")
    add.add_argument("-g", "--global", dest="everywhere", action="store_true")
    add.add_argument("words", nargs="+")
    clean = commands.add_parser("clean")
    clean.add_argument("--cache", default=os.path.join(os.path.expanduser("~"), ".cache", "quillspark"))
    regions = commands.add_parser("regions")
    regions.add_argument("file")
    settings = commands.add_parser("settings")
    settings.add_argument("path", nargs="?", help="with the overrides for this path")
    serve = commands.add_parser("serve")
    serve.add_argument("--lexicon", action="append", default=[], help="a word list; the first is primary")
    serve.add_argument("--dictionaries", help="a folder of <id>.txt or <id>.aff and <id>.dic")
    args = parser.parse_args(argv)

    if args.command == "add":
        policy = Policy(args.root)
        for word in args.words:
            print(f"{'added' if policy.add('words', word, args.everywhere) else 'already there'}: {word}")
        return 0
    if args.command == "clean":
        from .sources.resources import Cache

        print(f"{Cache(args.cache, None).clean()} files deleted" if Path(args.cache).is_dir() else "no cache")
        return 0
    if args.command == "regions":
        from .operators.capture import outline
        from .plans.registry import language_of_path

        print("\n".join(outline(Path(args.file).read_text(encoding="utf-8"), language_of_path(args.file))))
        return 0
    if args.command == "settings":
        from .plans.policy import render

        policy = Policy(args.root)
        for name, watched in (("project", policy.project), ("global", policy.everywhere)):
            print(f"# {name}: {watched.path}{'' if watched.settings else ' (not there)'}")
        print(render(policy.for_path(args.path)), end="")
        return 0

    from pyspark.sql import SparkSession

    from .operators.lexicon import read_word_list
    from .plans.engine import Engine

    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    policy = Policy(args.root)
    engine = Engine(spark, policy, args.dictionaries, embedded=True)
    for k, path in enumerate(args.lexicon):
        engine.add_lexicon(f"list{k}", read_word_list(spark, f"file://{Path(path).resolve()}", f"list{k}"), primary=k == 0)
    if args.command == "serve":
        from .streaming.server import of_engine

        return of_engine(engine, policy, sys.stdin.buffer, sys.stdout.buffer).run()
    if not engine.warm()["available"]:
        print("no primary lexicon", file=sys.stderr)
        return 2
    report, summary = engine.lint(args.files, args.root, args.unique, args.suggest)
    last = None
    for row in report.orderBy("path", "start_byte").toLocalIterator():
        if row["path"] != last:
            print(row["path"])
            last = row["path"]
        print(row["value"])
    s = summary.first()
    print(f"{s['total']} files, {s['checked']} checked, {s['ignored']} ignored, {s['excluded']} excluded", file=sys.stderr)
    print(f"{s['errors']} {'unique ' * args.unique}findings in {s['files_with_errors']} files", file=sys.stderr)
    return s["status"]


if __name__ == "__main__":
    sys.exit(main())
