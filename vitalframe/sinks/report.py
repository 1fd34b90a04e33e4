"""Summaries as Markdown and HTML, run artifacts, a relationship graph."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any


def run_summary(run, tag: str, run_date: str) -> dict[str, Any]:
    """A compact view of a run: scores, volumes, personal data, drift, actions."""
    rows = {r["object"]: r["rows"] for r in run.rows.collect()}  # one row per object
    q = [r.asDict() for r in run.quality.collect()]
    mean = lambda k: (sum(x[k] for x in q if x[k] is not None) / n) if (n := sum(x[k] is not None for x in q)) else None
    dims = ("completeness", "consistency", "uniqueness", "validity", "timeliness", "granularity", "accuracy")
    worst = lambda xs: next((s for s in ("fail", "warn") if any(x == s for x in xs)), "ok")
    return {
        "tag": tag,
        "run_date": run_date,
        "scores": {"health": run.health["score"], "dqi": mean("dqi"), **{d: mean(d) for d in dims}},
        "health": run.health,
        "objects": {x["object"]: {"rows": rows.get(x["object"]), "dqi": x["dqi"]} for x in q},
        "pii": {"fields": run.pii["total_pii_fields"], "high_risk": [f"{f['object']}.{f['field']}" for f in run.pii["high_risk_fields"]]},
        "keys": run.keys,
        "drift": worst([f["severity"] for f in run.findings]),
        "contract": worst([c["status"] for c in run.checks]),
        "top_actions": run.actions[:3],
    }


def markdown(summary: Mapping[str, Any]) -> str:
    out = [f"# Data health {summary['tag']}", "", f"Health {summary['scores']['health']} ({summary['health']['status']}), {summary['run_date']}", "", "| object | rows | DQI |", "|-|-|-|"]
    out += [f"| {o} | {x['rows']} | {x['dqi']:.1f} |" for o, x in sorted(summary["objects"].items())]
    out += ["", "## Actions", *(f"- {a['id']} ({a['severity']}) {a['title']}" for a in summary["top_actions"])]
    return "\n".join(out) + "\n"


def page(summary: Mapping[str, Any]) -> str:
    """A minimal HTML page of the same facts."""
    e = html.escape
    rows = "".join(f"<tr><td>{e(o)}</td><td>{x['rows']}</td><td>{x['dqi']:.1f}</td></tr>" for o, x in sorted(summary["objects"].items()))
    actions = "".join(f"<li>{e(a['title'])} ({e(a['severity'])})</li>" for a in summary["top_actions"])
    return f"<!doctype html><meta charset=utf-8><title>Data health {e(summary['tag'])}</title><h1>Health {summary['scores']['health']}</h1><table><tr><th>object<th>rows<th>DQI</tr>{rows}</table><ul>{actions}</ul>\n"


def graph(references: Sequence[Mapping[str, Any]]) -> str:
    """References as a Mermaid graph."""
    return "graph LR\n" + "".join(f"  {r['child']} -->|{r['child_path']}| {r['parent']}\n" for r in references)


def write_artifacts(folder: str, summary: Mapping[str, Any], findings: Sequence[Mapping], checks: Sequence[Mapping]) -> list[str]:
    """JSON, Markdown and HTML files; none holds raw values."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    texts = {"run-summary.json": json.dumps(summary, indent=1, default=str), "drift.json": json.dumps(list(findings), default=str), "contract.json": json.dumps(list(checks), default=str), "summary.md": markdown(summary), "report.html": page(summary)}
    for name, text in texts.items():
        (at / name).write_text(text, encoding="utf-8")
    return sorted(texts)


# Terms and their meaning.
GLOSSARY = {
    "coverage": "Rows in which a field is present, not null and not empty, in per cent of all rows.",
    "DQI": "Weighted mean of the quality dimensions that can be scored, 0 to 100.",
    "health": "DQI less penalties for personal data, drift, failed contract checks and mixed types.",
    "orphan": "A reference whose value no row of the parent has.",
    "PSI": "Sum over bins of (new - old) times ln(new / old), of shares.",
    "rolling band": "Median and median deviation of recent runs, widened to what was seen.",
    "material type": "A type with at least two per cent of a field's filled values.",
}


def glossary() -> str:
    return "# Glossary\n\n" + "".join(f"- **{k}**: {v}\n" for k, v in sorted(GLOSSARY.items()))
