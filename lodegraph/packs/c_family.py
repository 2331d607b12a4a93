"""C and C++: directives, types with their members, functions with the calls in them, and file-level data."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts
from lodegraph.packs.source import Source, last, parts

C_SUFFIXES = (".c", ".h")
PLUS_SUFFIXES = (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++")
# C++ type names that are no references.
PLUS_TYPES = frozenset("bool char char8_t char16_t char32_t wchar_t short int long signed unsigned float double void auto size_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())
WORDS = frozenset("if for while switch return sizeof do else case goto break continue default new delete throw catch try using typename operator alignof decltype static_cast const_cast dynamic_cast reinterpret_cast const static struct union enum class public private protected virtual inline extern typedef template namespace this volatile register friend explicit mutable constexpr noexcept override final".split())
PRIMITIVE = frozenset("bool char short int long signed unsigned float double void auto size_t".split())
DIRECTIVE = re.compile(r"(?m)^[ \t]*#[ \t]*(?P<word>\w+)(?P<rest>(?:[^\n\\]|\\\n|\\.)*)")
TYPE = re.compile(r"\b(?P<word>class|struct|union|enum)\b(?:\s+(?:class|struct))?(?:\s*\[\[[^\]]*\]\])*\s*(?P<name>[A-Za-z_][\w:]*)?\s*(?:final\s*)?(?:<[^{}]*>\s*)?(?P<bases>:[^{]*)?$")
CALL = re.compile(r"\b(?P<name>[A-Za-z_]\w*)\s*(?:<[\w:,\s*&]*>\s*)?\(")
LOCAL = re.compile(r"(?:^|[;{}(,]|\bconst\b|\breturn\b|\bnew\b)\s*(?:const\s+|static\s+)*(?:struct\s+|union\s+|enum\s+)?(?P<type>[A-Za-z_][\w:]*)(?:<[^;{}()]*>)?\s*[*&]*\s+[*&]*[A-Za-z_]\w*\s*(?=[=;,)\[({])")


def accepts_c(path: str, sample: str) -> bool:
    return path.endswith(C_SUFFIXES)


def accepts_plus(path: str, sample: str) -> bool:
    return path.endswith(PLUS_SUFFIXES) or path.endswith(".h") and bool(re.search(r"\b(class|namespace|template)\b|\bstd::|\bpublic:", sample))


def extract_c(facts: Facts) -> None:
    _Walk(facts, False).run()


def extract_plus(facts: Facts) -> None:
    _Walk(facts, True).run()


class _Walk:
    def __init__(self, facts: Facts, plus: bool):
        self.facts, self.plus, self.source = facts, plus, Source(facts.text, "c")
        self.file = facts.file()

    def run(self) -> None:
        directives = [(m.start(), m) for m in DIRECTIVE.finditer(self.source.code)]
        blank = list(self.source.code)
        for _, m in directives:
            self.directive(m)
            for k in range(m.start(), m.end()):
                blank[k] = blank[k] if blank[k] == "\n" else " "
        self.source.code = "".join(blank)
        self.region(0, len(blank), [], self.file, None)

    def directive(self, m: re.Match) -> None:
        text = self.facts.text[m.start("rest") : m.end("rest")].strip()
        if m["word"] == "include":
            name = last(text.strip('<>" \t').split(">")[0].split('"')[0], "/")
            for suffix in (".hpp", ".hh", ".hxx", ".h") if self.plus else (".h",):
                if name.endswith(suffix):
                    name = name[: -len(suffix)]
                    break
            self.facts.seek(self.file, name, "imports", text)
        elif m["word"] == "define" and (d := re.match(r"(\w+)(\([^)]*\))?\s*(.*)", text, re.S)):
            kind = "function" if d[2] else "constant"
            self.facts.node(kind, d[1], [], m.start(), m.end(), self.file, doc_summary=self.source.doc(m.start()), parameters=d[2], value=d[3].strip() or None)

    def region(self, at: int, end: int, chain: list[str], parent: str, access: str | None) -> None:
        code, source = self.source.code, self.source
        while at < end:
            if code[at].isspace() or code[at] in ";}":
                at += 1
                continue
            if label := re.compile(r"(public|private|protected)\s*(?:\w+\s*)?:(?!:)").match(code, at, end):
                access, at = label[1], label.end()
                continue
            if self.plus and (opened := re.compile(r"template\s*<").match(code, at, end)):
                begin, depth, at = at, 1, opened.end()
                while at < end and depth:
                    depth += (code[at] == "<") - (code[at] == ">")
                    at += 1
                at = self.statement(at, end, chain, parent, access, begin)
                continue
            at = self.statement(at, end, chain, parent, access, at)

    def statement(self, at: int, end: int, chain: list[str], parent: str, access: str | None, begin: int) -> int:
        """One declaration from `at`; the place after it. `begin`: where it starts with what stands before, as a template."""
        code, source, facts = self.source.code, self.source, self.facts
        at += len(code[at:end]) - len(code[at:end].lstrip())
        place = at
        while place < end and code[place] not in ";{}":
            place = source.close.get(place, place) + 1 if code[place] in "([" else place + 1
        head = code[at:place]
        if place >= end or code[place] == "}":
            return max(place, at + 1)
        if code[place] == ";":
            self.declaration(at, place, head, chain, parent, access, begin)
            return place + 1
        shut = source.close.get(place)
        if shut is None:
            return end
        doc = source.doc(begin)
        if self.plus and (m := re.match(r"(?:inline\s+)?namespace\s*([\w:]*)", head)):
            name = m[1]
            made = facts.node("namespace", name, chain, begin, shut + 1, parent, doc_summary=doc) if name else parent
            self.region(place + 1, shut, [*chain, name] if name else chain, made, None)
            return shut + 1
        if re.fullmatch(r"extern\s*", head):
            self.region(place + 1, shut, chain, parent, access)
            return shut + 1
        if (m := TYPE.search(head)) and "(" not in head[m.start() :]:
            tail = source.statement_end(shut + 1, end)
            names = [re.sub(r"[\s*&]|\[.*", "", x) for x in parts(code[shut + 1 : tail].rstrip(";"))]
            typedef = head.startswith("typedef")
            self.type(m, begin, place, shut, chain, parent, access, names[0] if typedef and names else None, doc)
            for name in names if not typedef else []:
                if re.fullmatch(r"\w+", name):
                    facts.node("field" if chain and access else "variable", name, chain, begin, tail, parent)
            for name in names[bool(typedef and not m["name"]) :] if typedef else []:
                if re.fullmatch(r"\w+", name):
                    facts.node("type", name, chain, begin, tail, parent, doc_summary=doc)
            return tail
        if "=" in head and "(" not in head.split("=")[0] and not re.search(r"\boperator\b", head):
            stop = source.statement_end(shut + 1, end) if code[shut + 1 : end].lstrip().startswith(";") else shut + 1
            self.declaration(at, place, head, chain, parent, access, begin)
            return stop
        if "(" in head:
            self.function(head, begin, at, place, shut, chain, parent, access, doc)
        return shut + 1

    def type(self, m: re.Match, begin: int, place: int, shut: int, chain: list[str], parent: str, access: str | None, alias: str | None, doc: str | None) -> None:
        facts, code = self.facts, self.source.code
        name = m["name"] or alias
        kind = {"class": "class", "enum": "enum"}.get(m["word"], "struct") if m["name"] or not alias else "type"
        made = facts.node(kind, name, chain, begin, shut + 1, parent, doc_summary=doc, visibility=access) if name else parent
        inside = [*chain, name] if name else chain
        if m["word"] == "enum":
            at = place + 1
            for piece in code[place + 1 : shut].split(","):
                if v := re.match(r"\s*(\w+)\s*(?:=\s*(.*))?", piece, re.S):
                    where = at + piece.index(v[1])
                    facts.node("constant", v[1], inside, where, where + len(piece.strip()), made, doc_summary=self.source.doc(where), value=(v[2] or "").strip())
                at += len(piece) + 1
            return
        for base in parts((m["bases"] or "").lstrip(": ")) if self.plus else []:
            bare = re.sub(r"^(?:(?:public|protected|private|virtual)\s+)*", "", base).split("<")[0]
            facts.seek(made, last(bare, "::"), "extends", base)
        self.region(place + 1, shut, inside, made, "private" if m["word"] == "class" else "public")

    def declaration(self, at: int, place: int, head: str, chain: list[str], parent: str, access: str | None, begin: int) -> None:
        facts, doc = self.facts, self.source.doc(begin)
        bare = head.strip()
        if self.plus and (m := re.match(r"using\s+(?:namespace\s+)?([\w:]+)\s*(=)?\s*(.*)$", bare, re.S)):
            if m[2]:
                facts.node("type", m[1], chain, begin, place + 1, parent, doc_summary=doc, aliased=m[3].strip(), visibility=access)
            else:
                facts.seek(parent, last(m[1], "::"), "imports", bare)
            return
        if bare.startswith("typedef"):
            m = re.search(r"\(\s*\*\s*(\w+)\s*\)\s*\(", bare) or re.search(r"(\w+)\s*(?:\[[^\]]*\])?$", bare)
            if m:
                facts.node("type", m[1], chain, begin, place + 1, parent, doc_summary=doc, underlying=bare[7 : m.start(1)].strip())
            return
        if re.match(r"(return|goto|friend|extern\s+template|static_assert|public|private|protected)\b", bare) or re.fullmatch(r"(?:class|struct|union|enum)\b[\s\w:]*", bare):
            return
        before = bare.split("=")[0]
        if "(" in before and not re.search(r"\(\s*\*", before):
            if chain and access and (name := self.function_name(before)):  # a member function without its body
                facts.node("constructor" if name == chain[-1] else "method", name, chain, begin, place + 1, parent, doc_summary=doc, visibility=access)
            return
        pieces = parts(bare)
        first = re.match(r"(?P<type>[\w:\s*&<>,]+?[\s*&>])(?P<name>[A-Za-z_]\w*)\s*(?:\[.*|:\s*\d+\s*|\(\s*\*.*)?$", pieces[0].split("=")[0].strip(), re.S) if pieces else None
        if not first or first["type"].split()[0] in ("return", "delete", "throw", "else", "case"):
            return
        kind = "field" if chain and access else "constant" if re.search(r"\b(const|constexpr)\b", first["type"]) else "variable"
        for name in [first["name"], *(m[1] for x in pieces[1:] if (m := re.match(r"[*&\s]*(\w+)", x)))]:
            facts.node(kind, name, chain, begin, place + 1, parent, doc_summary=doc, type=" ".join(first["type"].split()), visibility=access)

    def function_name(self, head: str) -> str | None:
        m = re.search(r"(operator\s*[^\s\w(]+|operator\s*\(\s*\)|(?:[\w]+(?:<[^()]*>)?\s*::\s*)*~?\s*[A-Za-z_]\w*)\s*\(", head)
        return None if not m or m[1] in WORDS else re.sub(r"\s+", "", m[1])

    def function(self, head: str, begin: int, at: int, place: int, shut: int, chain: list[str], parent: str, access: str | None, doc: str | None) -> None:
        name = self.function_name(head)
        if not name:
            return
        simple = last(name, "::")
        kind = "function"
        if self.plus:
            kind = "constructor" if chain and name == chain[-1] else "method" if chain or "::" in name or name.startswith("~") else "function"
        open_ = at + head.index("(", head.index(name.split("::")[-1].lstrip("~")[:3]) if name.split("::")[-1].lstrip("~")[:3] in head else 0)
        qualified = "::".join([*chain, simple]) if chain else name
        result = re.sub(r"\s+", " ", head[: head.find(simple.lstrip("~"))]).strip(" *&~:")
        made = self.facts.node(kind, simple, chain, begin, shut + 1, parent, qualified, doc_summary=doc, visibility=access, return_type=result, parameters=self.source.code[open_ : self.source.close.get(open_, open_) + 1])
        self.references(open_, shut, made)

    def references(self, start: int, end: int, made: str) -> None:
        body = self.source.code[start:end]
        inner = body.find("{")
        for m in CALL.finditer(body, max(inner, 0)):
            if m["name"] not in WORDS and not re.search(r"\bnew\s+[\w:]*$", body[: m.start()][-60:]):
                self.facts.seek(made, m["name"], "calls", m["name"])
        for m in LOCAL.finditer(body):
            name = last(m["type"], "::")
            if name not in WORDS and name not in PRIMITIVE and not (self.plus and name in PLUS_TYPES):
                self.facts.seek(made, name, "has_type")
