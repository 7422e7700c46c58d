"""Command line: python -m tessera.cli --home FOLDER COMMAND ...

serve answers requests for the engine's tools, one JSON object a line, {"id": 1, "tool": "search", "arguments": {"project": "p", "query": "q"}}, with
{"id": 1, "result": ...} or {"id": 1, "error": "..."}, until its input ends. setup makes the models once on all workers.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from typing import TextIO

VERSION = "0.1.0"
TOOLS = ("list_projects", "delete_project", "index_project", "reindex_project", "index_status", "await_index", "cancel_index", "list_jobs", "search")


def serve(engine, lines: Iterable[str], out: TextIO) -> None:
    """Answer requests in turn; indexing runs in the background meanwhile."""
    for line in filter(str.strip, lines):
        number = None
        try:
            request = json.loads(line)
            number, tool = request.get("id"), request.get("tool")
            if tool not in TOOLS:
                raise ValueError(f"unknown tool: {tool}")
            found = getattr(engine, tool)(**request.get("arguments", {}))
            answer = {"id": number, "result": [json.loads(r) for r in found.toJSON().collect()] if hasattr(found, "toJSON") else found}
        except Exception as e:  # a bad request must not end the others
            answer = {"id": number, "error": f"{type(e).__name__}: {str(e)[:500]}"}
        print(json.dumps(answer), file=out, flush=True)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("--home", default="tessera-projects")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("projects")
    sub.add_parser("serve")
    sub.add_parser("setup")
    for name in ("index", "reindex", "delete", "search"):
        p = sub.add_parser(name)
        p.add_argument("project")
        if name == "index":
            p.add_argument("folder")
            p.add_argument("--mode", default="auto")
        if name == "search":
            p.add_argument("query")
            p.add_argument("-k", type=int, default=5)
            p.add_argument("--file-glob")
            p.add_argument("--subdirectory")
            p.add_argument("--page-min", type=int)
            p.add_argument("--page-max", type=int)
            p.add_argument("--min-similarity", type=float, default=0.0)
    a = parser.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from tessera.plans.engine import Engine

    engine = Engine(SparkSession.builder.appName("tessera").getOrCreate(), a.home)
    if a.command in ("serve", "setup"):
        engine.warm_up()
        if a.command == "serve":
            serve(engine, sys.stdin, sys.stdout)
        return 0
    if a.command in ("index", "reindex"):
        job = engine.index_project(a.folder, a.project, a.mode) if a.command == "index" else engine.reindex_project(a.project)
        while (state := engine.await_index(job["job_id"], 10))["status"] in ("pending", "running"):
            print(f"{state['progress']} of {state['total']} {state['message']}", file=sys.stderr)
        print(json.dumps(state, indent=1))
        return int(state["status"] != "completed")
    if a.command == "delete":
        print(json.dumps(engine.delete_project(a.project)))
    else:
        rows = engine.list_projects() if a.command == "projects" else engine.search(a.project, a.query, a.k, file_glob=a.file_glob, subdirectory=a.subdirectory, page_min=a.page_min, page_max=a.page_max, min_similarity=a.min_similarity)
        for r in rows.toJSON().collect():
            print(r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
