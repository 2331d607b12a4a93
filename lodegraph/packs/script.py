"""TypeScript and JavaScript: declarations at any depth but within functions, and members of classes."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts
from lodegraph.packs.source import Source

SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
FUNCTION = r"(?:async\s+)?(?:function\b\s*\*?\s*\w*\s*(?:<[^>]*>)?\s*\(|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^=;{]+)?=>|[\w$]+\s*=>)"
DECLARED = re.compile(
    r"(?P<export>\bexport\s+(?:default\s+)?)?(?:\b(?:declare|abstract|async)\s+)*"
    r"(?:\b(?P<word>function|class|interface|enum|type)\b\s*\*?\s*(?P<name>[\w$]+)(?=\s*[<({=]|\s+(?:extends|implements)\b)"
    rf"|\b(?P<var>const|let|var)\s+(?P<holder>[\w$]+)\s*(?::[^=;]+)?=\s*(?P<value>{FUNCTION})?"
    r"|\b(?P<import>import)\b(?!\s*\())"
)
IMPORTED = re.compile(r"import\b\s*(?:[^'\"`;()]*?\bfrom\s*)?(?P<quote>['\"])(?P<address>[^'\"\n]*)(?P=quote)")
METHOD = re.compile(r"(?:\b(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*(?:\*\s*)?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>{}()]*>)?\s*\(")
WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "super", "new", "await", "typeof"}


def accepts(path: str, sample: str) -> bool:
    return path.endswith(SUFFIXES)


def sought(address: str) -> str:
    name = address.rsplit("/", 1)[-1]
    return name.removesuffix(".js").removesuffix(".ts")


def extract(facts: Facts) -> None:
    source, file = Source(facts.text, "script"), facts.file()

    def documented(at: int) -> str | None:
        """The comment right before, if it is a documenting one."""
        near = source.comment_before(at)
        return source.doc(at) if near and near[-1].startswith("/**") and len(near) == 1 else " ".join(x for x in (y.strip().lstrip("*").strip() for y in near[-1][3:-2].splitlines()) if x) if near and near[-1].startswith("/**") else None

    def members(start: int, end: int, chain: list[str], parent: str) -> None:
        flat, at = source.flat(start, end), start
        while m := METHOD.search(flat, at):
            shut = source.close.get(m.end() - 1)
            at = m.end()
            if shut is None or m["name"] in WORDS or re.search(r"=[^;]*$", flat[max(start, flat.rfind("\n", start, m.start())) : m.start()]):
                continue
            after = re.match(r"\s*(?::[^;{=]+)?\{", flat[shut + 1 : end])
            if after:
                open_ = shut + after.end()
                at = source.close.get(open_, open_) + 1
                facts.node("method", m["name"], chain, m.start(), at, parent, doc_summary=documented(m.start()))
            else:
                at = shut + 1

    def visit(start: int, end: int, chain: list[str], parent: str) -> None:
        at = start
        while m := DECLARED.search(source.code, at, end):
            at = m.end()
            if m["import"]:
                if whole := IMPORTED.match(facts.text, m.start("import"), end):
                    facts.seek(parent, sought(whole["address"]), "imports", whole.group())
                    at = whole.end()
                continue
            if m["var"]:
                if m["value"]:
                    stop = source.statement_end(m.start("value"), end)
                    facts.node("function", m["holder"], chain, m.start("holder"), stop, parent, doc_summary=documented(m.start()))
                else:
                    stop = source.statement_end(m.end(), end)
                at = stop
                continue
            word, name = m["word"], m["name"]
            if word == "type":
                stop = source.statement_end(m.end(), end)
                facts.node("type", name, chain, m.start("word"), stop, parent)
                at = stop
                continue
            body = source.body(m.end(), end)
            stop = body[1] + 1 if body else source.statement_end(m.end(), end)
            made = facts.node(word, name, chain, m.start("word"), stop, parent, doc_summary=documented(m.start()) if word != "enum" else None)
            if word == "class" and body:
                members(*body, [*chain, f"class {name}"], made)
            at = stop

    visit(0, len(source.code), [], file)
