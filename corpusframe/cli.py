"""The command line: index a repository, search it, look at its history.

    corpusframe --catalog hdfs:///index --repo /checkout/my_repo index --incremental
    corpusframe --catalog hdfs:///index --repo /checkout/my_repo symbols Parser --kind class --limit 5
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from corpusframe.operators import embeddings
from corpusframe.operators.languages import all_suffixes
from corpusframe.plans import render
from corpusframe.plans.api import Engine
from corpusframe.sources import git, session
from corpusframe.sources.catalog import Catalog
from corpusframe.sources.state import IndexState, Locked


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusframe", description=__doc__.splitlines()[0])
    p.add_argument("--catalog", required=True, help="folder of the index, on any file system that Spark reads")
    p.add_argument("--repo", required=True, help="the repository's folder")
    p.add_argument("--json", action="store_true", help="results as JSON")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index", help="index the repository")
    c.add_argument("--incremental", action="store_true", help="only what has changed")
    c.add_argument("--embeddings", action="store_true", help="with vectors")
    c.add_argument("--tracked", action="store_true", help="only files under version control")
    sub.add_parser("status", help="what is indexed, and up to which commit")
    for name, options in (("symbols", ("kind", "visibility", "module", "package-prefix", "file-pattern")), ("code", ("file-type", "module", "enclosing-class")), ("files", ("extension", "module"))):
        c = sub.add_parser(name, help=f"search {name}")
        c.add_argument("query")
        c.add_argument("--limit", type=int, default=10)
        for o in options:
            c.add_argument(f"--{o}", action="append" if o in ("kind", "file-type") else "store")
    c = sub.add_parser("complete", help="what begins so")
    c.add_argument("prefix")
    c.add_argument("--fuzzy", action="store_true")
    c = sub.add_parser("implementations", help="what implements or extends a type")
    c.add_argument("name")
    c = sub.add_parser("references", help="what refers to a symbol")
    c.add_argument("name")
    c = sub.add_parser("commits", help="search the history")
    for o in ("query", "author", "since", "until", "file-path"):
        c.add_argument(f"--{o}")
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("history", help="how a file came to be")
    c.add_argument("path")
    c.add_argument("--diff", action="store_true")
    return p


def engine_of(spark: SparkSession, catalog: str, repo: str, with_history: bool = False) -> Engine:
    root = Path(repo).resolve()
    tables, parents = (None, None, None), None
    if with_history:
        git.register(spark)
        tables = tuple(spark.read.format("gitlog").option("repo", str(root)).option("table", t).load() for t in ("commits", "changes", "blobs"))
        parents = spark.read.format("gitlog").option("repo", str(root)).option("table", "parents").load()
    return Engine(spark, Catalog(spark, catalog, root.name), *tables, folder=str(root / ".corpusframe"), repo=str(root) if (root / ".git").exists() else None, parents=parents)


def run(spark: SparkSession, given: list[str]) -> str:
    """What a command has to say."""
    a = parser().parse_args(given)
    engine = engine_of(spark, a.catalog, a.repo, a.command in ("commits", "history"))
    if a.command == "index":
        began, tracked = time.perf_counter(), None
        if a.tracked:
            git.register(spark)
            tracked = spark.read.format("gitlog").option("repo", a.repo).option("table", "files").load()
        changes = engine.reindex_folder(str(Path(a.repo).resolve()), "incremental" if a.incremental else "full", embeddings.hashing_encoder if a.embeddings else None, tracked, all_suffixes())
        counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
        state = IndexState.load(engine.state_path)
        told = {"files": {"indexed": counts.get("A", 0) + counts.get("M", 0), "deleted": counts.get("D", 0)}, "symbols": state.total_symbols, "chunks": state.total_chunks, "failures": state.total_failures, "seconds": round(time.perf_counter() - began, 1)}
        return json.dumps(told, indent=None if a.json else 2)
    if a.command == "status":
        state = IndexState.load(engine.state_path)
        head = git.head(a.repo) if engine.repo else ""
        return json.dumps({"last_commit": state.last_commit, "head": head, "is_stale": state.last_commit != head, "collections": {r.collection: r.doc_count for r in engine.index_status().collect()}}, indent=None if a.json else 2)
    if a.command == "symbols":
        best, facets = engine.search_symbols(a.query, limit=a.limit, kinds=tuple(a.kind or ()), visibility=a.visibility, module=a.module, package_prefix=a.package_prefix, file_pattern=a.file_pattern)
        return render.hits(best, a.query, as_json=a.json) + ("" if a.json else "\n\n" + render.facets(facets))
    if a.command == "code":
        return render.hits(engine.search_code(a.query, limit=a.limit, file_types=tuple(a.file_type or ()), module=a.module, enclosing_class=a.enclosing_class), a.query, as_json=a.json)
    if a.command == "files":
        return render.hits(engine.search_files(a.query, limit=a.limit, extension=a.extension, module=a.module), a.query, as_json=a.json)
    rows = {
        "complete": lambda: engine.autocomplete(a.prefix, fuzzy=a.fuzzy),
        "implementations": lambda: engine.find_implementations(a.name),
        "references": lambda: engine.find_references(a.name),
        "commits": lambda: engine.search_commits(query=a.query, author=a.author, since=a.since, until=a.until, file_path=a.file_path, limit=a.limit),
        "history": lambda: engine.file_history(a.path, include_diff=a.diff),
    }[a.command]()
    found = [r.asDict(True) for r in rows.collect()]
    return json.dumps(found, default=str) if a.json else "\n".join("  ".join(f"{k}: {v}" for k, v in r.items() if v not in (None, "")) for r in found) or "Nothing found."


def main(given: list[str] | None = None) -> int:
    given = sys.argv[1:] if given is None else given
    parser().parse_args(given)  # errors and help before a session is made
    spark = SparkSession.builder.appName("corpusframe").getOrCreate()
    session.ship(spark)
    try:
        print(run(spark, given))
    except (Locked, ValueError, KeyError, git.GitError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
