"""Alerts, notification channels and metric exports (driver side)."""

from __future__ import annotations

import json
import smtplib
import socket
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from email.message import EmailMessage
from typing import Any

from ..operators.filters import holds


@dataclass
class Alert:
    rule: str
    severity: str
    message: str
    source: str = ""
    context: dict[str, Any] = field(default_factory=dict)


@dataclass
class AlertRule:
    """``condition`` is an expression over the run's numbers."""

    name: str
    condition: str
    message: str
    severity: str = "warning"


# The rules that come with the library.
DEFAULT_RULES = (
    AlertRule("low_quality_score", "quality_score < 70", "quality is {quality_score}"),
    AlertRule("pii_detected", "pii_count > 0", "{pii_count} fields hold personal data"),
    AlertRule("low_coverage", "avg_coverage < 50", "mean coverage is {avg_coverage}"),
    AlertRule("high_null_rate", "max_null_rate > 50", "{high_null_field} is {max_null_rate}% empty"),
    AlertRule("mixed_types", "multi_type_fields > 0", "{multi_type_fields} fields mix types", "info"),
)


def context(quality: Mapping[str, Any], pii: Mapping[str, Any], fields: Sequence[Mapping[str, Any]]) -> dict[str, Any]:
    worst = min(fields, key=lambda f: f["coverage"], default=None)
    return {
        "quality_score": quality.get("overall_dqi", quality.get("overall_score", 0)),
        "pii_count": pii.get("total_pii_fields", pii.get("total_fields", 0)),
        "pii_types": ", ".join(pii.get("by_type", {})) or "none",
        "avg_coverage": sum(f["coverage"] for f in fields) / len(fields) if fields else 100,
        "max_null_rate": 100 - worst["coverage"] if worst else 0,
        "high_null_field": worst["path"] if worst else "",
        "multi_type_fields": sum(len([t for t in f["types"] if t != "null"]) > 1 for f in fields),
    }


def evaluate(numbers: Mapping[str, Any], rules: Sequence[AlertRule] = DEFAULT_RULES, source: str = "") -> list[Alert]:
    return [Alert(r.name, r.severity, r.message.format_map(_Known(numbers)), source, dict(numbers)) for r in rules if holds(r.condition, numbers)]


class _Known(dict):
    def __missing__(self, key):
        return f"{{{key}}}"


class Channel(ABC):
    @abstractmethod
    def send(self, alert: Alert) -> bool: ...

    def send_all(self, alerts: Sequence[Alert]) -> int:
        return sum(map(self.send, alerts))


def _post(url: str, body: Any, timeout: float = 10) -> bool:
    request = urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return 200 <= r.status < 300


@dataclass
class Webhook(Channel):
    url: str

    def send(self, alert: Alert) -> bool:
        return _post(self.url, asdict(alert))


@dataclass
class Slack(Channel):
    url: str

    def send(self, alert: Alert) -> bool:
        return _post(self.url, {"text": f"[{alert.severity}] {alert.rule}: {alert.message}"})


@dataclass
class PagerDuty(Channel):
    routing_key: str
    url: str = "https://events.pagerduty.com/v2/enqueue"

    def send(self, alert: Alert) -> bool:
        return _post(self.url, {"routing_key": self.routing_key, "event_action": "trigger", "payload": {"summary": alert.message, "severity": alert.severity, "source": alert.source or "run"}})


@dataclass
class Email(Channel):
    host: str
    sender: str
    to: str
    port: int = 25

    def send(self, alert: Alert) -> bool:
        m = EmailMessage()
        m["Subject"], m["From"], m["To"] = f"[{alert.severity}] {alert.rule}", self.sender, self.to
        m.set_content(alert.message)
        with smtplib.SMTP(self.host, self.port) as s:
            s.send_message(m)
        return True


@dataclass
class JsonLines(Channel):
    """Appends to a file of the driver."""

    path: str

    def send(self, alert: Alert) -> bool:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(asdict(alert), default=str) + "\n")
        return True


def notify(targets: Sequence[str], alerts: Sequence[Alert]) -> list[str]:
    """``slack:URL``, ``webhook:URL`` and ``file:PATH``; failures are reported, not raised."""
    out = []
    for t in targets:
        kind, _, to = t.partition(":")
        make = {"slack": Slack, "webhook": Webhook, "file": JsonLines}.get(kind)
        try:
            out.append(f"{kind}: unknown target" if make is None else f"{kind}: sent {make(to).send_all(alerts)}")
        except Exception as e:
            out.append(f"{kind}: {e}")
    return out


# ---------------------------------------------------------------- metric exports


def prometheus(rows: Sequence[Mapping[str, Any]], prefix: str = "data_health") -> str:
    """Metrics (metric, object, path, value) as exposition text."""
    esc = lambda s: str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    out = []
    for name in sorted({r["metric"] for r in rows}):
        out.append(f"# TYPE {prefix}_{name} gauge")
        out += [f'{prefix}_{name}{{object="{esc(r["object"])}",path="{esc(r["path"])}"}} {float(r["value"])!r}' for r in rows if r["metric"] == name]
    return "\n".join(out) + "\n"


def statsd(rows: Sequence[Mapping[str, Any]], host: str = "127.0.0.1", port: int = 8125, prefix: str = "data_health") -> int:
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for r in rows:
            name = ".".join(x for x in (prefix, r["metric"], r["object"], r["path"]) if x)
            s.sendto(f"{name}:{r['value']}|g".encode(), (host, port))
    return len(rows)


def write_json(rows: Sequence[Mapping[str, Any]], path: str) -> int:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([dict(r) for r in rows], f, default=str)
    return len(rows)
