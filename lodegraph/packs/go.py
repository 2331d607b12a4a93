"""Go: top-level declarations, fields, interface methods, and references of bodies."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts
from lodegraph.packs.source import Source, last

SUFFIXES = (".go",)
# Names that are no references.
TYPES = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any comparable nil true false iota".split())
FUNCTIONS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())
TOP = re.compile(r"(?m)^[ \t]*(?P<word>package|import|func|type|const|var)\b")
CALL = re.compile(r"(?P<on>(?:[\w)\]]+\s*\.\s*)*)\b(?P<name>[A-Za-z_]\w*)\s*\(")
LITERAL = re.compile(r"(?:[=(,:&\[\]{}]|\breturn\b|\brange\b)\s*&?(?P<type>[A-Za-z_]\w*(?:\.\w+)?)\{")
TYPED = re.compile(r"\bvar\s+\w+\s+[*\[\]]*(?P<a>[A-Za-z_][\w.]*)|\.\(\s*\*?(?P<b>[A-Za-z_][\w.]*)\s*\)|\b(?:make|new)\(\s*[*\[\]]*(?P<c>[A-Za-z_][\w.]*)|\[\]\*?(?P<d>[A-Za-z_][\w.]*)\{")


def accepts(path: str, sample: str) -> bool:
    return path.endswith(SUFFIXES)


def extract(facts: Facts) -> None:
    source, file = Source(facts.text, "go"), facts.file()
    code, text = source.code, facts.text

    def lines(start: int, end: int):
        """(start, text) of lines with code at the first level between two places."""
        flat, at = source.flat(start, end), start
        for line in flat[start:end].split("\n"):
            for piece in re.finditer(r"[^;]+", line):
                bare = piece.group().strip()
                if bare:
                    yield at + piece.start() + len(piece.group()) - len(piece.group().lstrip()), bare
            at += len(line) + 1

    def group(at: int, end: int):
        """The specifications of a declaration: those between its parentheses, or the one that follows."""
        m = re.compile(r"\s*\(").match(code, at, end)
        if m and m.end() - 1 in source.close:
            yield from lines(m.end(), source.close[m.end() - 1])
        else:
            stop = code.find("\n", at)
            rest = code[at : stop if stop > 0 else end]
            yield at + len(rest) - len(rest.lstrip()), rest.strip()

    def imports(at: int) -> None:
        m = re.compile(r"\s*\(").match(code, at)
        stop = source.close.get(m.end() - 1, len(code)) if m else code.find("\n", at) if code.find("\n", at) > 0 else len(code)
        for spec in re.finditer(r"(?:(?P<alias>[\w.]+)[ \t]+)?[\"`](?P<path>[^\"`\n]+)[\"`]", text[at:stop]):
            alias = spec["alias"]
            facts.seek(file, alias if alias and alias not in (".", "_") else last(spec["path"], "/"), "imports", spec["path"])

    def references(start: int, end: int, made: str) -> None:
        body = code[start:end]
        for m in CALL.finditer(body):
            name = m["name"]
            if name in ("func", "if", "for", "switch", "return", "go", "defer", "select", "range") or re.search(r"\bfunc\s*$", body[: m.start("name")]):
                continue
            if m["on"]:
                facts.seek(made, name, "calls", "".join((m["on"] + name).split()))
            elif name not in FUNCTIONS:
                facts.seek(made, name, "calls", name)
        for m in LITERAL.finditer(body):
            name = last(m["type"], ".")
            if name not in TYPES and m["type"] not in ("struct", "interface", "map", "func"):
                facts.seek(made, name, "instantiates", f"&{m['type']}{{...}}")
                facts.seek(made, name, "has_type")
        for m in TYPED.finditer(body):
            name = last(next(x for x in m.groups() if x), ".")
            if name not in TYPES and name not in ("map", "chan", "func", "struct", "interface"):
                facts.seek(made, name, "has_type")

    def named_types(text_: str, made: str) -> None:
        for m in re.finditer(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?", text_):
            name = last(m.group(), ".")
            if name not in TYPES and name not in ("map", "chan", "func", "struct", "interface"):
                facts.seek(made, name, "has_type")

    def fields(start: int, end: int, chain: list[str], parent: str) -> None:
        for at, line in lines(start, end):
            stop = code.find("\n", at)
            tag = re.search(r"`[^`]*`", text[at : stop if 0 < stop else end])
            bare = line.split("`")[0].strip()
            attributes = {"tag": tag.group() if tag else None, "doc_summary": source.doc(at)}
            if m := re.match(r"((?:\w+\s*,\s*)*\w+)\s+(\S.*)$", bare):
                for name in re.findall(r"\w+", m[1]):
                    made = facts.node("field", name, chain, at, at + len(bare), parent, **attributes, type=m[2].strip())
                    named_types(m[2], made)
            elif m := re.match(r"\*?([\w.]+)(?:\[.*\])?$", bare):
                facts.seek(parent, last(m[1], "."), "extends", m[1])

    def methods(start: int, end: int, chain: list[str], parent: str) -> None:
        for at, line in lines(start, end):
            if m := re.match(r"(\w+)\s*(\(.*?\))\s*(.*)$", line):
                facts.node("method", m[1], chain, at, at + len(line), parent, doc_summary=source.doc(at), parameters=m[2], return_type=m[3])
            elif m := re.match(r"([\w.]+)$", line):
                facts.seek(parent, last(m[1], "."), "extends", m[1])

    def types(at: int, line: str, doc: str | None) -> None:
        m = re.match(r"(\w+)(?:\[[^\]]*\])?\s*(=)?\s*(.*)$", line, re.S)
        if not m:
            return
        name, body = m[1], source.body(at) if re.match(r"(struct|interface)\b", m[3]) else None
        kind = m[3].split("{")[0].strip() if body else "type"
        end = body[1] + 1 if body else at + len(line)
        made = facts.node(kind, name, [], at, end, file, doc_summary=doc, underlying=None if body else m[3].strip())
        if body:
            (fields if kind == "struct" else methods)(*body, [name], made)

    flat, at = source.flat(0, len(code)), 0
    while m := TOP.search(flat, at):
        word, begin, at = m["word"], m.start("word"), m.end()
        if word == "package":
            if name := re.compile(r"\s+(\w+)").match(code, at):
                facts.node("package", name[1], [], begin, name.end(), file, doc_summary=source.doc(begin))
        elif word == "import":
            imports(at)
            if shut := re.compile(r"\s*\(").match(code, at):
                at = source.close.get(shut.end() - 1, at)
        elif word == "func":
            head = re.compile(r"\s*(?:(?P<receiver>\([^)]*\))\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()").match(code, at)
            if not head:
                continue
            shut = source.close.get(head.end(), head.end())
            body = source.body(shut + 1) if "\n" not in code[shut + 1 : (code.find("{", shut) if code.find("{", shut) > 0 else shut)] else None
            end = body[1] + 1 if body else (code.find("\n", shut) if code.find("\n", shut) > 0 else len(code))
            result = code[shut + 1 : body[0] - 1 if body else end].strip()
            attributes = {"doc_summary": source.doc(begin), "parameters": code[head.end() : shut + 1], "return_type": result}
            if head["receiver"]:
                of = re.sub(r"\[.*", "", head["receiver"].strip("() ").split()[-1].lstrip("*"))
                made = facts.node("method", head["name"], [of], begin, end, file, **attributes, receiver=head["receiver"])
            else:
                made = facts.node("function", head["name"], [], begin, end, file, **attributes)
            named_types(re.sub(r"\b\w+\s+(?=[\w*\[])", "", code[head.end() : shut + 1]) + " " + result, made)
            if body:
                references(*body, made)
            at = end
        else:
            grouped = re.compile(r"\s*\(").match(code, at)
            for place, line in group(at, len(code)):
                doc = source.doc(place) or (None if grouped else source.doc(begin))
                if word == "type":
                    types(place, line, doc)
                elif names := re.match(r"((?:\w+\s*,\s*)*\w+)", line):
                    for name in re.findall(r"\w+", names[1]):
                        facts.node("constant" if word == "const" else "variable", name, [], place, place + len(line), file, doc_summary=doc)
            if grouped:
                at = source.close.get(grouped.end() - 1, at)
