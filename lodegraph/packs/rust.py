"""Rust: items of modules, traits and implementations; function bodies are not looked into."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts
from lodegraph.packs.source import Source

SUFFIXES = (".rs",)
VISIBLE = r"(?P<visible>pub(?:\s*\([^)]*\))?)?\s*"
ITEM = re.compile(
    rf"\b{VISIBLE}(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*\b(?P<word>fn|struct|enum|trait|mod)\s+(?P<name>\w+)"
    rf"|\b(?:unsafe\s+)?(?P<impl>impl)\b|\b(?:pub(?:\s*\([^)]*\))?\s+)?(?P<use>use)\s+(?P<path>[^;]+);"
)
KINDS = {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module"}


def accepts(path: str, sample: str) -> bool:
    return path.endswith(SUFFIXES)


def implemented(header: str) -> str:
    """`T` or `Trait for T` of what stands between `impl` and the body."""
    header = header.strip()
    if header.startswith("<"):
        depth = 0
        for k, c in enumerate(header):
            depth += (c == "<") - (c == ">" and header[k - 1] != "-")
            if depth == 0:
                header = header[k + 1 :]
                break
    return " ".join(re.split(r"\bwhere\b", header)[0].split())


def extract(facts: Facts) -> None:
    source, file = Source(facts.text, "rust"), facts.file()

    def documented(at: int) -> str | None:
        lines = [c.removeprefix("///").strip() for c in source.comment_before(at) if c.startswith("///")]
        return " ".join(lines) or None

    def visit(start: int, end: int, chain: list[str], parent: str, split_use_groups: bool = False) -> None:
        flat, at = source.flat(start, end), start
        while m := ITEM.search(flat, at):
            at, begin = m.end(), m.start()
            if m["use"]:
                # The last segment as it is written: a group stays one text, a rename too.
                text = facts.text[m.start("path") : m.end("path")]
                shut = source.code.find(";", m.start("path"))
                text, at = facts.text[m.start("path") : shut], shut
                facts.seek(parent, re.sub(r"\s+", " ", text.rsplit("::", 1)[-1]) if "{" not in text else text[text.rfind("::", 0, text.index("{")) + 2 :], "imports", text)
                continue
            body = source.body(m.end(), end)
            stop = body[1] + 1 if body else source.statement_end(m.end(), end)
            if m["impl"]:
                if body:
                    visit(*body, [*chain, f"impl {implemented(source.code[m.end() : body[0] - 1])}"], parent)
                at = stop
                continue
            name, word = m["name"], m["word"]
            if word == "fn":
                inside = chain[-1] if chain else ""
                kind = "method" if inside.startswith(("impl", "trait")) else "function"
                facts.node(kind, name, chain, begin, stop, parent, visibility=m["visible"], doc_summary=documented(begin))
            else:
                made = facts.node(KINDS[word], name, chain, begin, stop, parent, doc_summary=documented(begin) if word != "mod" else None)
                if body and word in ("trait", "mod"):
                    visit(*body, [*chain, f"trait {name}" if word == "trait" else name], made)
            at = stop

    visit(0, len(source.code), [], file)
