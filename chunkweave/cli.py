"""Command line: python -m chunkweave index|search|status|monitor."""

from __future__ import annotations

import argparse
import os

from chunkweave import catalogue
from chunkweave.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunkweave", description="Index folders of sources and documents, and search them.")
    p.add_argument("--store", default=os.path.join(os.path.expanduser("~"), ".chunkweave"), help="folder of the indexed repositories")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index", help="index a folder or a git url")
    a.add_argument("path")
    a.add_argument("--name")
    a.add_argument("--force", action="store_true", help="index again what is there already")
    a = sub.add_parser("search", help="search what is indexed")
    a.add_argument("query")
    a.add_argument("--repo")
    a.add_argument("--limit", type=int, default=10)
    sub.add_parser("status", help="what is indexed")
    a = sub.add_parser("monitor", help="index new files of a folder as they come")
    a.add_argument("path")
    a.add_argument("--name")
    a.add_argument("--seconds", type=int, help="how long; for ever if not given")
    return p


def rendered(df) -> str:
    """A small result as a table of text."""
    rows = [df.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("\n", " ") for v in r] for r in df.collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(args.master)
    if args.command == "index":
        name = catalogue.index(spark, args.path, args.store, args.name, args.force)
        print(f"indexed {name}\n" + rendered(catalogue.status(spark, args.store).filter(f"repository = '{name}'")))
    elif args.command == "monitor":
        query = catalogue.monitor(spark, args.path, args.store, args.name)
        query.awaitTermination(args.seconds)
        query.stop()
    else:
        found = catalogue.status(spark, args.store) if args.command == "status" else catalogue.search(spark, args.store, args.query, args.repo, args.limit)
        print(rendered(found) if found is not None else "nothing is indexed")
    return 0
