"""Questions about a run: a model proposes guarded SQL over masked views, at
most four times, then answers. Providers are plug-ins; none is needed offline."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..operators.filters import RejectedQuery, flatten, run_query

MAX_STEPS = 4
RULES = """Answer from the facts and query results below; personal fields are masked.
Reply with one JSON object:
{"action": "sql", "query": "SELECT ..."} to look at data (Spark SQL, one SELECT; put dotted names in backticks), or
{"action": "answer", "markdown": "..."} to answer."""


class Provider(ABC):
    @abstractmethod
    def complete(self, prompt: str) -> str: ...


class Scripted(Provider):
    """Fixed replies, for tests and offline use."""

    def __init__(self, replies: Sequence[str]):
        self.replies, self.prompts = list(replies), []

    def complete(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.replies.pop(0) if self.replies else '{"action": "answer", "markdown": "no provider"}'


def first_json(text: str) -> dict[str, Any] | None:
    """The first JSON object in a text: plain, fenced or between other words."""
    decoder = json.JSONDecoder()
    for i, ch in enumerate(text):
        if ch == "{":
            try:
                found, _ = decoder.raw_decode(text[i:])
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return None


def ask(question: str, facts: Mapping[str, Any], views: Mapping[str, DataFrame], provider: Provider, deadline_s: float = 5.0) -> dict[str, Any]:
    """``{"markdown", "steps"}``; a reply outside the protocol is the answer."""
    steps: list[dict[str, Any]] = []
    flat = {name: flatten(df) for name, df in views.items()}
    tables = "\n".join(f"{name}({', '.join(df.columns)})" for name, df in flat.items())
    for _ in range(MAX_STEPS + 1):
        log = "\n".join(f"[query] {s['sql']}\n[result] {json.dumps(s['result'], default=str)[:4000]}" for s in steps)
        text = provider.complete(f"{RULES}\n\nFacts: {json.dumps(facts, default=str)}\n\nViews:\n{tables}\n\n{log}\n\nQuestion: {question}")
        action = first_json(text) or {}
        if action.get("action") == "sql" and len(steps) < MAX_STEPS:
            try:
                result: dict[str, Any] = run_query(flat, str(action.get("query", "")), deadline_s=deadline_s)
            except RejectedQuery as e:
                result = {"error": str(e)}
            steps.append({"sql": action.get("query", ""), "result": result})
            continue
        return {"markdown": str(action.get("markdown", text.strip())), "steps": steps}
    return {"markdown": "no answer within the steps allowed", "steps": steps}


def as_markdown(question: str, reply: Mapping[str, Any]) -> str:
    return f"## {question}\n\n{reply['markdown']}\n" + "".join(f"\n```sql\n{s['sql']}\n```\n" for s in reply["steps"])
