"""Facts of one file: nodes, containment and pending references, with places and identities."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

from lodegraph.functions.ids import MARK


class Places:
    """Byte offsets, 1-based lines and columns (in characters) of a text's character offsets. `\\n` and `\\r\\n` end lines."""

    def __init__(self, text: str):
        self.text, self.starts, self.bytes = text, [0], [0]
        for line in text.split("\n")[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
            self.bytes.append(self.bytes[-1] + len(line.encode("utf-8", "surrogateescape")) + 1)

    def at(self, offset: int) -> tuple[int, int, int]:
        """(byte offset, line, column); an offset beyond the text is an error."""
        if not 0 <= offset <= len(self.text):
            raise ValueError(f"{offset} is not within the text")
        line = bisect_right(self.starts, offset) - 1
        before = self.text[self.starts[line] : offset]
        return self.bytes[line] + len(before.encode("utf-8", "surrogateescape")), line + 1, len(before) + 1


def clean(text: str | None) -> str | None:
    return None if text is None else text.encode("utf-8", "replace").decode()


@dataclass
class Facts:
    """Collects what a pack finds. `chain` is the containers' labels; the parent is a node's id."""

    root: str
    path: str
    text: str
    language: str
    producer: str
    version: str = "1"
    rows: list[dict] = field(default_factory=list)
    seen: Counter = field(default_factory=Counter)
    sought: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.places = Places(self.text)

    def node(self, kind: str, name: str, chain: list[str], start: int, end: int, parent: str | None = None, qualified: str | None = None, **attributes) -> str:
        """Adds a node, and the edge by which its parent contains it. Same-named siblings are told apart in source order."""
        key = (kind, *chain, name)
        ordinal, self.seen[key] = self.seen[key], self.seen[key] + 1
        made = hashlib.sha256(MARK.join(("node:v1", kind, self.root, self.path, "::".join(chain), name, str(ordinal))).encode("utf-8", "replace")).hexdigest()
        a, b = self.places.at(start), self.places.at(end)
        held = {k: v if isinstance(v, str) else json.dumps(v) for k, v in attributes.items() if v not in (None, "", [])}
        self.rows.append({"tag": "node", "node_id": made, "kind": kind, "name": clean(name), "qualified_name": clean(qualified or "::".join([*chain, name])), "chain": clean("::".join(chain)), "ordinal": ordinal, "start": a[0], "end": b[0], "start_line": a[1], "start_column": a[2], "end_line": b[1], "end_column": b[2], "attributes": {k: clean(v) for k, v in held.items()}})
        if parent is not None:
            edge = hashlib.sha256(MARK.join(("edge:v1", parent, made, "contains", self.producer)).encode()).hexdigest()
            self.rows.append({"tag": "edge", "edge_id": edge, "from_id": parent, "to_id": made, "kind": "contains"})
        return made

    def seek(self, source: str, seeking: str, kind: str, hint: str | None = None) -> None:
        """Adds a pending reference, once for each (source, text, kind)."""
        seeking = seeking.strip()
        if seeking and (source, seeking, kind) not in self.sought:
            self.sought.add((source, seeking, kind))
            self.rows.append({"tag": "unresolved", "from_id": source, "seeking": clean(seeking), "scope_hint": clean(hint), "kind": kind})

    def file(self, kind: str = "file") -> str:
        return self.node(kind, self.path, [], 0, len(self.text), qualified=self.path)

    def diagnostic(self, message: str) -> None:
        self.rows.append({"tag": "diagnostic", "name": clean(message)})
