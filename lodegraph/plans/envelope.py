"""What a request is answered in: status, rows, warnings, how fresh and how complete they are."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame

# Statuses, codes, states, reasons.
STATUSES = ("ok", "partial", "not_found", "unavailable", "invalid")
CODES = (
    "INVALID_QUERY", "PATH_OUTSIDE_ROOT", "SCOPE_EXCLUDED", "CAPABILITY_UNCONFIGURED", "CAPABILITY_UNAVAILABLE", "CAPABILITY_UNSUPPORTED", "STATE_PERMISSIONS", "PROJECT_NOT_INITIALIZED",
    "PROJECT_STATE_INVALID", "PROJECT_STATE_NEWER", "PROJECT_STATE_ALIAS", "PROJECT_LEASE_UNAVAILABLE", "DAEMON_START_FAILED", "DAEMON_UNAVAILABLE", "PROTOCOL_MISMATCH", "ENTITY_AMBIGUOUS",
    "ENTITY_NOT_FOUND", "NO_PATH_FOUND", "STALE_RESULT", "INDEX_BUILDING", "REVISION_TOO_OLD", "TIMEOUT", "CANCELLED", "RESULT_TRUNCATED", "INTERNAL_ERROR",
)
GRAPH_STATES = ("current", "stale", "building", "unknown")
LEXICAL_STATES = ("current", "bypassed_lagging", "disabled", "failing")
COVERAGE = ("complete", "partial", "unknown")
TRUNCATIONS = ("limit", "bytes", "lines", "depth", "breadth", "provider", "timeout")


@dataclass(frozen=True)
class Warned:
    code: str
    message: str

    def __post_init__(self) -> None:
        if self.code not in CODES:
            raise ValueError(f"{self.code} is no code")


@dataclass(frozen=True)
class Freshness:
    graph_revision: int | None = None
    graph_state: str = "unknown"
    lexical_revision: int | None = None
    lexical_state: str = "disabled"
    coverage: str = "unknown"
    observed_at: int | None = None


@dataclass(frozen=True)
class Truncation:
    returned: int
    reason: str
    available: int | None = None
    truncated: bool = True


@dataclass
class Envelope:
    status: str
    data: Any = None
    warnings: list[Warned] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    freshness: Freshness = field(default_factory=Freshness)
    truncation: Truncation | None = None
    evidence: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.status not in STATUSES:
            raise ValueError(f"{self.status} is no status")

    def rendered(self) -> str:
        """As JSON: a table's rows in full."""
        data = [json.loads(x) for x in self.data.toJSON().collect()] if isinstance(self.data, DataFrame) else self.data
        out = {k: v for k, v in asdict(Envelope(self.status, None, self.warnings, self.sources, self.freshness, self.truncation, self.evidence)).items() if v not in (None, [])}
        return json.dumps(out | {"data": data}, default=str)

    def shown(self, rows: int = 50) -> str:
        """As text: a row a line."""
        head = [f"[{self.status}]"] + [f"{w.code}: {w.message}" for w in self.warnings]
        if isinstance(self.data, DataFrame):
            head += ["  ".join(f"{c}={r[c]}" for c in self.data.columns if r[c] is not None) for r in self.data.limit(rows).collect()]
        elif self.data is not None:
            head.append(str(self.data))
        return "\n".join(head)


def now() -> int:
    return int(time.time())


def failed(status: str, code: str, message: str) -> Envelope:
    return Envelope(status, None, [Warned(code, message)])
