"""A plan of what would be sent to a model: redacted, trimmed, priced, never sent."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from loomgraph.functions.redact import redact, redact_tree
from loomgraph.functions.text import CHARS_PER_TOKEN
from loomgraph.operators.policy import QueryRefused, QueryResult


@dataclass(frozen=True)
class EgressPolicy:
    enabled: bool = False
    dry_run: bool = True
    max_prompt_tokens: int = 8000
    max_completion_tokens: int = 1000
    max_cost: float = 0.5
    price_per_million: float = 5.0


@dataclass
class EgressPlan:
    model: str
    body: dict[str, Any]
    prompt_tokens: int
    cost: float
    redactions: int
    notes: list[str] = field(default_factory=list)


def estimated_tokens(text: str) -> int:
    return int(len(text) / CHARS_PER_TOKEN) + 1


def context_lines(result: QueryResult, most_edges: int = 200) -> list[str]:
    """What a model is told: symbols with their places, then relations, then snippets under their ids."""
    place = lambda x, line: f"{x['path']}:{x[line]}" if x["path"] else "elsewhere"
    symbols = [f"* {n['name']}, {n['kind']}, {place(n, 'start_line')}" for n in result.nodes]
    relations = [f"* {e['src']} {e['type']} {e['dst']} ({place(e, 'line')})" for e in result.edges[:most_edges]]
    quoted = [text for k, lines in sorted(result.snippets.items()) for text in (f"# {k}", *lines)]
    return [*symbols, *relations, *quoted]


def build_plan(question: str, result: QueryResult, policy: EgressPolicy, model: str) -> EgressPlan:
    """Redacts, trims the context to the token ceiling, and refuses what would cost too much."""
    asked, n_asked = redact(question)
    context, n_context = redact("\n".join(context_lines(result)))
    notes = []
    room = int((policy.max_prompt_tokens - estimated_tokens(asked) - 1) * CHARS_PER_TOKEN)
    if room <= 0:
        raise QueryRefused("egress: the question alone takes more tokens than allowed.")
    if len(context) > room:
        context = context[:room]
        notes.append(f"context trimmed to {room} characters")
    tokens = estimated_tokens(asked) + estimated_tokens(context)
    cost = round((tokens + policy.max_completion_tokens) / 1e6 * policy.price_per_million, 6)
    if cost > policy.max_cost:
        raise QueryRefused(f"egress would spend {cost}, more than {policy.max_cost}.")
    body, more = redact_tree({"model": model, "max_tokens": policy.max_completion_tokens, "messages": [{"role": "user", "content": f"{asked}\n\n{context}"}]})
    return EgressPlan(model, body, tokens, cost, n_asked + n_context + more + result.redactions, notes)


def execute(plan: EgressPlan, policy: EgressPolicy, key: str = "") -> None:
    """Always refuses: this library has no network sink."""
    for closed, why in ((not policy.enabled, "egress is not enabled"), (policy.dry_run, "this is a dry run"), (not key, "there is no key")):
        if closed:
            raise QueryRefused(f"egress: {why}.")
    raise QueryRefused("egress: no network sink is built in.")
