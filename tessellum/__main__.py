"""The engine on the command line: python -m tessellum COMMAND."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessellum", description="Index, search and describe source code with Spark.")
    p.add_argument("--store", default="tessellum-index", help="folder of the index's tables, on storage that all executors share")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, root: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        if root:
            c.add_argument("--root", default=".")
        return c

    command("setup", "make the tables", root=False)
    for name, text in (("index", "bring the index up to date"), ("reindex", "clear the project and index it anew")):
        c = command(name, text)
        c.add_argument("--embedding")
        c.add_argument("--file")
        c.add_argument("--gitignore")
        c.add_argument("--force", action="store_true")
        c.add_argument("--chunk-size", type=int, default=1000)
        c.add_argument("--chunk-overlap", type=int, default=100)
        c.add_argument("--max-bytes", type=int, default=524_288)
    c = command("search", "find chunks by meaning")
    c.add_argument("words", nargs="+")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--threshold", type=float, default=0.0)
    c.add_argument("--lang")
    c.add_argument("--files-only", action="store_true")
    c.add_argument("--json", action="store_true")
    c = command("tree", "print the outline of the folders")
    c.add_argument("--path", default="")
    c.add_argument("--depth", type=int, default=6)
    c.add_argument("--inline", type=int, default=6)
    c.add_argument("--all", action="store_true")
    command("status", "what is indexed, and what is stale")
    command("clear", "take the project out of the index")
    command("list", "all indexed projects", root=False)
    c = command("scan", "functions, bindings and exports of scripts")
    c.add_argument("--mode", choices=("compact", "verbose", "files", "folders"), default="compact")
    c.add_argument("--include", type=lambda x: x.split(","))
    c.add_argument("--exclude", type=lambda x: x.split(","))
    c.add_argument("--max-bytes", type=int, default=1_048_576)
    c.add_argument("--function-kinds", choices=("top", "top+arrow", "top+arrow+class", "all"), default="all")
    c.add_argument("--file")
    return p


def run(args: argparse.Namespace, spark) -> str:  # noqa: ANN001
    """The text that a command prints."""
    from tessellum.engine import Engine
    from tessellum.operators import search
    from tessellum.structure import scan

    e, root = Engine(spark, args.store), getattr(args, "root", ".")
    if args.command == "setup":
        e.setup()
        return ""
    if args.command in ("index", "reindex"):
        how = {"embedding_spec": args.embedding, "file": args.file, "ignore_file": args.gitignore, "force": args.force, "chunk_size": args.chunk_size, "chunk_overlap": args.chunk_overlap, "max_bytes": args.max_bytes}
        n = (e.index if args.command == "index" else e.reindex)(root, **how)
        return f"✓ +{n['added']} added  ={n['skipped']} skipped  ~{n['updated']} updated  -{n['deleted']} deleted\n"
    if args.command == "search":
        found = e.search(args.words, root, args.limit, args.threshold, args.lang)
        if args.json:
            return search.json_text(found)
        if n := e.stale(root):
            print(f"⚠ {n} file(s) changed since they were indexed", file=sys.stderr)
        rows = search.best_of_files(found).collect() if args.files_only else search.snippets(found).collect()
        return "".join(r["line" if args.files_only else "snippet"] + "\n" for r in rows)
    if args.command == "tree":
        return e.tree(root, args.path, args.depth, args.inline, args.all)
    if args.command == "status":
        return e.status(root)
    if args.command == "clear":
        from pathlib import Path

        from tessellum.sources.files import project_id

        return f"Cleared {e.clear(root)} chunks for {project_id(str(Path(root).resolve()))}\n"
    if args.command == "list":
        return e.list()
    return scan.rendered(e.scan(root, args.include, args.exclude, args.max_bytes, args.function_kinds, args.file), args.mode, root) + "\n"


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessellum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.stdout.write(run(args, spark))
    return 0


if __name__ == "__main__":
    sys.exit(main())
