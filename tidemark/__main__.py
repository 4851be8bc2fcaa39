"""Command line: search, status, config, index, maintenance."""

from __future__ import annotations

import argparse
import csv
import datetime as dt
import io
import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.api import as_json
from tidemark.config import Settings, load_config
from tidemark.engine import Engine
from tidemark.log import set_up
from tidemark.operators import retrieval as R
from tidemark.session import release, ship_package


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    top.add_argument("--config", default="config.yaml")
    top.add_argument("--store", default="./data/index", help="folder of the index tables")
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="ranked search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--vaults", nargs="+")
    search.add_argument("--mode", choices=("hybrid", "keyword", "semantic"), default="hybrid")
    search.add_argument("--alpha", type=float)
    search.add_argument("--beta", type=float)
    search.add_argument("--similar", type=float, help="leave out chunks whose vectors are so similar to a better one")
    search.add_argument("--output", choices=("console", "json", "csv"), default="console")
    search.add_argument("--verbose", action="store_true")
    commands.add_parser("status", help="counts, shares of deleted rows, size")
    config = commands.add_parser("config", help="settings")
    config.add_argument("--show", action="store_true", help="the file as it is")
    config.add_argument("--parsed", action="store_true", help="the settings as JSON")
    config.add_argument("--validate", action="store_true", help="whether the settings and their folders can be used")
    index = commands.add_parser("index", help="build or bring up to date").add_subparsers(dest="action", required=True)
    index.add_parser("build").add_argument("--force", action="store_true", help="anew, even if there is an index")
    index.add_parser("scan")
    upkeep = commands.add_parser("maintenance", help="remove deleted rows, compact")
    upkeep.add_argument("--dry-run", action="store_true")
    upkeep.add_argument("--force", action="store_true")
    only = upkeep.add_mutually_exclusive_group()
    only.add_argument("--clean-only", action="store_true")
    only.add_argument("--vacuum-only", action="store_true")
    return top


def show_results(rows: list[dict], style: str, seconds: float = 0.0) -> str:
    """Results of a search as text: all fields as JSON, ten as CSV, or a few lines each."""
    if style == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
    if style == "csv":
        out = io.StringIO()
        names = ("rank", "file_path", "absolute_path", "section", "vault_name", "chunk_type", "content", "final_score", "confidence_score", "confidence_reason")
        table = csv.DictWriter(out, names, extrasaction="ignore")
        table.writeheader()
        table.writerows({**r, "content": r["content"][:200].replace("\n", " ")} for r in rows)
        return out.getvalue()
    lines = [f"{len(rows)} results, {seconds:.2f} s"]
    for r in rows:
        text = r["content"][:200] + ("..." if len(r["content"]) > 200 else "")
        lines += [
            f"{r['rank']}. final={r['final_score']:.3f} semantic={r['semantic_score']:.3f} keyword={r['keyword_score']:.3f} confidence={r['confidence_score']:.2f}",
            f"   {r['absolute_path']}", f"   {r['vault_name']} / {r['chunk_type']} | {r['section']}", f"   {text}",
        ]
    return "\n".join(lines)


def problems(settings: Settings) -> list[str]:
    """What would keep these settings from being used."""
    found = [f"vault {v.name}: no folder {v.path}" for v in settings.vaults if v.enabled and not os.path.isdir(v.path)]
    found += [] if settings.vaults else ["no vaults"]
    a, b = settings.retrieval.get("alpha", 0), settings.retrieval.get("beta", 0)
    return found + ([] if abs(a + b - 1) <= 0.01 else [f"alpha and beta must make 1, not {a + b:g}"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config" and args.show:
        print(Path(args.config).read_text(encoding="utf-8"))
        return 0
    try:
        settings = load_config(args.config)
    except (FileNotFoundError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    log = set_up("DEBUG" if getattr(args, "verbose", False) else settings.log_level)
    if args.command == "config":
        if args.validate:
            wrong = problems(settings)
            print("\n".join(wrong) or "valid")
            return 1 if wrong else 0
        print(json.dumps(as_json(settings), ensure_ascii=False, indent=2, default=dict))
        return 0
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    ship_package(spark)
    engine = Engine(spark, settings, args.store, cache_file=settings.cache.db_path)
    try:
        print(_run(engine, args))
        return 0
    except Exception as error:  # the end of the program: said in one line, traced in the log
        log.error("%s failed: %s", args.command, error, exc_info=True)
        return 1
    finally:
        release(spark)


def _run(engine: Engine, args: argparse.Namespace) -> str:
    as_text = lambda x: json.dumps(x, ensure_ascii=False, indent=2, default=str)
    if args.command == "search":
        began = time.perf_counter()
        s = engine.settings.retrieval
        w = R.weights(None if args.mode == "hybrid" else args.mode, args.alpha, args.beta, (s["alpha"], s["beta"]))
        found = engine.results(args.query, args.top_k, w=w, vaults=R.enabled_vaults(args.vaults, engine.enabled()), as_of=dt.datetime.now(dt.UTC).date(), similar=args.similar)
        return show_results([r.asDict() for r in found.orderBy("rank").collect()], args.output, time.perf_counter() - began)
    if args.command == "status":
        return as_text({**engine.statistics(), "deleted": engine.store.state()})
    if args.command == "maintenance":
        return as_text(engine.maintenance(args.force, args.dry_run, not args.vacuum_only, not args.clean_only))
    if args.action == "scan":
        return as_text(engine.scan_index())
    if engine.store.version() and not args.force:
        return as_text({"status": "there is an index; --force builds it anew, scan brings it up to date"})
    return as_text(engine.rebuild())


if __name__ == "__main__":
    sys.exit(main())
