"""Command line: map a source tree, then query the graph.

    python -m loomgraph.cli map ROOT GRAPH
    python -m loomgraph.cli find|impact|path|file|stats|ask|explain|stacks|report|models|tools|doctor ...

``map --cache FOLDER`` extracts only what changed, ``map --json FILE`` also writes one JSON document, in ROOT; ``--root ROOT`` beside a query
adds snippets, ``--text`` gives lines in place of JSON.  Limits come from the environment (``plans/settings.py``).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import ship
from loomgraph.operators import egress, graph_ops, render, retrieve
from loomgraph.operators.engine import Engine
from loomgraph.operators.policy import QueryCaps, QueryRefused
from loomgraph.plans import settings
from loomgraph.plans.storage import shared_dir
from loomgraph.sources import document, extract, graph_files, models, stacks
from loomgraph.sources.languages import LANGUAGES
from loomgraph.sources.repository import RepositorySource

OK, FAILED, REFUSED, NOT_CONFIGURED, INTERRUPTED = 0, 1, 2, 78, 130


def scan(spark: SparkSession, root: str, contents: str = "true") -> DataFrame:
    ship(spark)
    spark.dataSource.register(RepositorySource)
    limits = settings.of(settings.Limits, spark)
    bounds = {"maxFiles": limits.max_files, "maxBytes": limits.max_file_bytes, "maxDepth": limits.max_depth, "maxSeconds": limits.max_wall_seconds}
    return spark.read.format("repository").options(root=root, withContent=contents, **bounds).load()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in {
        "map": ("root", "graph"),
        "find": ("graph", "name"),
        "impact": ("graph", "symbol"),
        "path": ("graph", "source", "target"),
        "file": ("graph", "path"),
        "stats": ("graph",),
        "report": ("graph",),
        "ask": ("graph", "question"),
        "explain": ("graph", "symbol"),
        "models": ("document",),
        "stacks": ("root",),
        "tools": (),
        "doctor": (),
    }.items():
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
        if verb == "impact":
            sub.add_argument("--direction", default="callers")
        if verb == "map":
            sub.add_argument("--cache")
            sub.add_argument("--json")
        if verb in ("impact", "ask", "explain"):
            sub.add_argument("--root")
        if verb in ("find", "impact", "path", "file"):
            sub.add_argument("--text", action="store_true")
        if verb == "models":
            sub.add_argument("--free", action="store_true")
        if verb in ("impact", "path"):
            sub.add_argument("--depth", type=int, default=2 if verb == "impact" else 5)
    return p


def doctor(spark: SparkSession) -> dict[str, object]:
    """What a scan and a query would run with: each language, ready where Spark's JVM takes its
    patterns and else with its error; the limits; where temporary tables go."""
    languages = {}
    for lang in LANGUAGES:
        try:
            for pattern in (*(of for _, of in lang.definitions), *lang.imports, lang.calls):
                spark._jvm.java.util.regex.Pattern.compile(pattern)
            languages[lang.name] = f"ready: {' '.join(lang.extensions)}"
        except Py4JJavaError as e:
            languages[lang.name] = f"failed: {e.java_exception.getMessage()}"
    try:
        tables = shared_dir(spark)
    except ValueError as e:
        tables = f"failed: {e}"
    limits, caps = settings.of(settings.Limits, spark), settings.of(QueryCaps, spark, prefix="query_")
    ready = sum(v.startswith("ready") for v in languages.values())
    return {
        "spark": spark.version,
        "languages": dict(sorted(languages.items())),
        "languages_ready": f"{ready} of {len(LANGUAGES)}",
        "limits": dataclasses.asdict(limits),
        "query_caps": dataclasses.asdict(caps),
        "sending": "never",
        "tables": tables,
        "ok": ready == len(LANGUAGES) and not tables.startswith("failed"),
    }


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    if args.verb == "doctor":
        return doctor(spark)
    if args.verb == "map":
        built = extract.build(scan(spark, args.root, "sources"), args.cache, settings.of(settings.Limits, spark).max_total_bytes)
        graph_files.write(built, args.graph)
        if args.json:
            document.write_document(graph_files.read(spark, args.graph), args.json, args.root)
        return Engine(graph_files.read(spark, args.graph)).stats()
    if args.verb == "stacks":
        return [r.asDict() for r in stacks.detect(scan(spark, args.root)).orderBy("category", "name").collect()]
    if args.verb == "tools":
        return Engine(None).manifest()
    if args.verb == "models":
        listed = models.parse(spark.read.text(args.document, wholetext=True), "value")
        shown = models.price_label(models.free_only(listed) if args.free else listed).orderBy("id").limit(60)
        return [f"{r.id}  {r.context}  {r.price}" for r in shown.collect()]
    root = getattr(args, "root", None)
    contents = scan(spark, root).where("content is not null").select("path", F.col("content").try_cast("string").alias("content")) if root else None
    engine = Engine(graph_files.read(spark, args.graph), settings.of(QueryCaps, spark, prefix="query_"), contents, log=sys.stderr)
    if args.verb == "explain":
        found = engine.impact(args.symbol, "both", 1, include_snippets=contents is not None)
        return dataclasses.asdict(egress.build_plan(f"What does {args.symbol} do?", found, egress.EgressPolicy(), "none"))
    if args.verb == "report":
        return [r.asDict() for r in graph_ops.report(engine.graph.files).orderBy("path").limit(200).collect()]
    if args.verb == "ask":
        return retrieve.answer(retrieve.retrieve(engine, args.question))
    if args.verb == "stats":
        return engine.stats()
    calls = {
        "find": lambda: engine.find_symbol(args.name),
        "impact": lambda: engine.impact(args.symbol, args.direction, args.depth, include_snippets=contents is not None),
        "path": lambda: engine.path_between(args.source, args.target, args.depth),
        "file": lambda: engine.file_summary(args.path),
    }
    found = calls[args.verb]()
    return render.shown(found) if args.text else dataclasses.asdict(found)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        settings.check_start()
        out = run(SparkSession.builder.appName("loomgraph").getOrCreate(), args)
    except settings.StartupError as e:
        print(e, file=sys.stderr)
        return NOT_CONFIGURED
    except QueryRefused as e:
        print(e, file=sys.stderr)
        return REFUSED
    except (ValueError, PermissionError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return FAILED
    except KeyboardInterrupt:
        return INTERRUPTED
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return FAILED if args.verb == "doctor" and not out["ok"] else OK


if __name__ == "__main__":
    sys.exit(main())
