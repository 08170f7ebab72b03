"""Answers as lines of text, bounded whatever their size."""

from __future__ import annotations

from collections.abc import Iterator

from loomgraph.operators.policy import QueryResult

# How much of an answer is shown.
NODES, EDGES, SNIPPETS = 60, 60, 6


def _last(node_id: str) -> str:
    return node_id.rpartition("::")[2]


def _more(shown: int, there: int) -> Iterator[str]:
    if there > shown:
        yield f"  ({there - shown} more)"


def lines(result: QueryResult) -> Iterator[str]:
    """Nodes with their places, edges, snippets, then remarks; a line says what is left out."""
    if not (result.nodes or result.edges or result.notes):
        yield "nothing found"
    if result.nodes:
        yield f"{result.total_matched} symbols"
        for n in result.nodes[:NODES]:
            place = f"{n['path']}:{n['start_line']}" if n["path"] else ""
            yield f"  {n['kind']:<9} {n['name']:<32} {place}".rstrip()
        yield from _more(NODES, len(result.nodes))
    if result.edges:
        yield f"{len(result.edges)} edges"
        for e in result.edges[:EDGES]:
            yield f"  {_last(e['src'])} -[{e['type']}]-> {_last(e['dst'])}  {e['path']}:{e['line']}"
        yield from _more(EDGES, len(result.edges))
    for node_id, code in list(result.snippets.items())[:SNIPPETS]:
        yield node_id
        yield from (f"  | {line}" for line in code)
    yield from _more(SNIPPETS, len(result.snippets))
    yield from (f"note: {note}" for note in result.notes)
    if result.truncated:
        yield "note: a cap cut this answer"


def shown(result: QueryResult) -> str:
    return "\n".join(lines(result))
