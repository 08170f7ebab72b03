"""The query surface: admission, the operators, caps, and an audit record of each query."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import redact, text
from loomgraph.operators import graph_ops, policy
from loomgraph.operators.policy import QueryCaps, QueryRefused, QueryResult
from loomgraph.plans.schema import DIRECTIONS, EDGE_COLUMNS, KINDS, NODE_COLUMNS, Graph


LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40}


class Engine:
    """Answers capped queries on one graph.

    ``contents`` (path, content) serves snippets; ``log`` gets one JSON line for
    each record of at least ``level``."""

    def __init__(self, graph: Graph, caps: QueryCaps | None = None, contents: DataFrame | None = None, log: TextIO | None = None, level: str = "info"):
        self.graph, self.caps, self.contents, self.log = graph, caps or QueryCaps(), contents, log
        self.level = LEVELS[policy.one_of(level, tuple(LEVELS), "level")]
        self._total: int | None = None

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.graph.nodes.count()
        return self._total

    def audit(self, event: str, level: str = "info", **fields: Any) -> None:
        """Redacts and writes one line; never raises."""
        try:
            record, _ = redact.redact_tree({"ts": time.time(), "level": level, "event": event, **fields})
            if self.log and LEVELS.get(level, LEVELS["info"]) >= self.level:
                print(json.dumps(record, sort_keys=True, default=str), file=self.log)
        except (OSError, TypeError, ValueError):
            pass

    def _finish(self, result: QueryResult, **params: Any) -> QueryResult:
        for name, most in (("nodes", self.caps.max_nodes), ("edges", self.caps.max_edges)):
            rows = getattr(result, name)
            if len(rows) > most:
                setattr(result, name, rows[:most])
                result.truncated = True
                result.notes.append(f"{name} capped at {most}")
        self.audit("query", operation=result.operation, nodes=len(result.nodes), edges=len(result.edges), **params)
        return result

    def _hops(self, asked: int, result: QueryResult) -> int:
        hops = self.caps.hops(asked)
        if hops < asked:
            result.notes.append(f"{hops} hops are the most, {asked} were asked for")
        return hops

    def _rows(self, df: DataFrame, order: tuple[str, ...], most: int) -> list[dict]:
        """The first rows by ``order``: a bounded top-k, one more than the cap tells that it cut."""
        return [r.asDict() for r in df.orderBy(*order).limit(most).collect()]

    def find_symbol(self, name: str = "", kind: str = "", language: str = "", path_prefix: str = "", exact: bool = False) -> QueryResult:
        if kind:
            policy.one_of(kind, KINDS, "kind")
        policy.check_selector("find_symbol", any((name, kind, language, path_prefix)))
        found = graph_ops.find_nodes(self.graph.nodes, name, kind, language, path_prefix, exact)
        result = QueryResult("find_symbol", total_matched=found.count())
        policy.check_bulk("find_symbol", result.total_matched, self.total, self.caps)
        result.nodes = self._rows(found, ("id",), self.caps.max_nodes + 1)
        return self._finish(result, name=name, kind=kind)

    def impact(self, symbol: str, direction: str = "callers", depth: int = 2, include_snippets: bool = False) -> QueryResult:
        policy.one_of(direction, DIRECTIONS, "direction")
        policy.require(symbol, "impact", "a symbol")
        result = QueryResult("impact")
        depth = self._hops(depth, result)
        nodes, edges = graph_ops.impact(self.graph, symbol, direction, depth)
        result.total_matched = nodes.count()
        if not result.total_matched:
            result.notes.append(f"no symbol is called {symbol!r}")
            return self._finish(result, symbol=symbol)
        policy.check_bulk("impact", result.total_matched, self.total, self.caps)
        # nodes are cut without the flag: total_matched tells
        result.nodes = self._rows(nodes.select(*NODE_COLUMNS), ("id",), self.caps.max_nodes)
        result.edges = self._rows(edges, ("src", "type", "dst", "path", "line", "col"), self.caps.max_edges + 1)
        if include_snippets:
            self._attach_snippets(result, nodes)
        return self._finish(result, symbol=symbol, direction=direction, depth=depth)

    def path_between(self, source: str, target: str, max_depth: int = 5) -> QueryResult:
        policy.require(source, "path_between", "a source")
        policy.require(target, "path_between", "a target")
        result = QueryResult("path_between")
        depth = self._hops(max_depth, result)
        result.edges = [{c: r[c] for c in EDGE_COLUMNS} for r in graph_ops.path_between(self.graph, source, target, depth).orderBy("step").collect()]
        ids = list(dict.fromkeys(i for e in result.edges for i in (e["src"], e["dst"])))
        if not ids:
            result.notes.append(f"{depth} hops do not lead from {source!r} to {target!r}")
        else:
            by_id = {r.id: r.asDict() for r in self.graph.nodes.where(F.col("id").isin(ids)).select(*NODE_COLUMNS).collect()}
            result.nodes = [by_id[i] for i in ids if i in by_id]
        result.total_matched = len(ids)
        return self._finish(result, source=source, target=target)

    def file_summary(self, path: str) -> QueryResult:
        policy.require(path, "file_summary", "a path")
        nodes, edges = graph_ops.file_summary(self.graph, path)
        result = QueryResult("file_summary", total_matched=nodes.count())
        if not result.total_matched:
            result.notes.append(f"the graph has no file {path!r}")
            return self._finish(result, path=path)
        result.nodes = self._rows(nodes, ("id",), self.caps.max_nodes)
        result.edges = self._rows(edges, ("src", "type", "dst", "path", "line", "col"), self.caps.max_edges)
        if self.graph.files is not None and (r := self.graph.files.where(F.col("path") == path).first()):
            result.notes.append(f"status={r.status} language={r.language} {r.reason}".strip())
        return self._finish(result, path=path)

    def stats(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for r in graph_ops.summarize(self.graph).collect():
            if r.key:
                out.setdefault(r.section, {})[r.key] = r["count"]
            else:
                out[r.section] = r["count"]
        self.audit("query", operation="stats", nodes=0, edges=0)
        return {k: dict(sorted(v.items())) if isinstance(v, dict) else v for k, v in sorted(out.items())}

    def _attach_snippets(self, result: QueryResult, nodes: DataFrame) -> None:
        """Redacted lines of the first nodes, joined with the contents on the path."""
        if self.contents is None:
            return
        first = nodes.where("path != '' and start_line > 0").orderBy("id").limit(self.caps.max_nodes).select("id", "path", "start_line", "end_line")
        most = F.least(F.lit(self.caps.max_snippet_lines), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))
        lines = F.slice(text.snippet(F.col("content"), F.col("start_line"), self.caps.max_snippet_lines), F.lit(1), most)
        rows = self.contents.join(F.broadcast(first), "path").select("id", redact.redacted(F.array_join(lines, "\n")).alias("r")).collect()
        for r in rows:
            result.snippets[r.id] = r.r["text"].split("\n")
            result.redactions += r.r["count"]

    def tools(self) -> dict[str, Callable]:
        return {"find_symbol": self.find_symbol, "impact": self.impact, "path_between": self.path_between, "file_summary": self.file_summary, "stats": self.stats}

    def call(self, tool: str, params: dict[str, Any]) -> Any:
        """Dispatch by name; refuses unknown tools and parameters."""
        import inspect

        found = self.tools().get(tool)
        if found is None:
            raise QueryRefused(f"unknown tool {tool!r}")
        if extra := set(params) - set(inspect.signature(found).parameters):
            raise QueryRefused(f"{tool}: unexpected parameters {sorted(extra)}")
        return found(**params)

    def manifest(self) -> list[dict[str, Any]]:
        """Name and parameters of each tool, as they are."""
        import inspect

        return [{"name": k, "parameters": {p.name: None if p.default is p.empty else p.default for p in inspect.signature(f).parameters.values()}} for k, f in self.tools().items()]
