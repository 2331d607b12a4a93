"""Java and C#: packages and namespaces, types with their members, and references of bodies."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts
from lodegraph.packs.source import Source, last, parts

# Type names that are no references.
JAVA_TYPES = frozenset("byte short int long float double boolean char void String Integer Long Double Float Boolean Byte Short Character Object Class Void var".split())
SHARP_TYPES = frozenset("bool byte sbyte char decimal double float int uint nint nuint long ulong short ushort object string void var dynamic Boolean Byte Int16 Int32 Int64 UInt16 UInt32 UInt64 Single Double Decimal String Object Task ValueTask".split())
WORDS = frozenset("if for while switch return catch synchronized super this new throw else do try assert foreach using lock fixed nameof typeof sizeof default checked unchecked await when yield base in is as case instanceof".split())
JAVA_MODIFIERS = r"public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed|non-sealed"
SHARP_MODIFIERS = r"public|protected|private|internal|static|readonly|sealed|abstract|virtual|override|async|const|partial|extern|unsafe|new|volatile|required|event|file|ref"
JAVA_KINDS = {"class": "class", "interface": "interface", "@interface": "interface", "enum": "enum", "record": "struct"}
SHARP_KINDS = {"class": "class", "interface": "interface", "struct": "struct", "record": "struct", "enum": "enum"}
CALL = re.compile(r"(?P<on>(?:[\w)\]>]+\s*\??\.\s*)*)\b(?P<name>[A-Za-z_]\w*)\s*(?:<[\w,\s.<>\[\]?]*>\s*)?\(")
MADE = re.compile(r"\bnew\s+(?P<type>[A-Za-z_][\w.]*)\s*(?:<[^;{}()]*>)?\s*(?=[(\[{])")


def accepts_java(path: str, sample: str) -> bool:
    return path.endswith(".java")


def accepts_sharp(path: str, sample: str) -> bool:
    return path.endswith(".cs")


def extract_java(facts: Facts) -> None:
    _Walk(facts, "java").run()


def extract_sharp(facts: Facts) -> None:
    _Walk(facts, "csharp").run()


def visibility(modifiers: str) -> str | None:
    return next((v for v in ("public", "protected", "private", "internal") if re.search(rf"\b{v}\b", modifiers)), None)


class _Walk:
    def __init__(self, facts: Facts, language: str):
        self.facts, self.java, self.source = facts, language == "java", Source(facts.text, language)
        self.builtin = JAVA_TYPES if self.java else SHARP_TYPES
        self.kinds = JAVA_KINDS if self.java else SHARP_KINDS
        own = JAVA_MODIFIERS if self.java else SHARP_MODIFIERS
        mark = r"@(?!interface\b)[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?" if self.java else r"\[[^\]]*\]"
        self.modifiers = re.compile(rf"(?:(?:{mark})\s*|\b(?:{own})\b\s+)*")
        words = r"class|interface|enum|record|@interface" if self.java else r"class|interface|struct|record(?:\s+(?:struct|class))?|enum"
        self.declared = re.compile(rf"(?P<word>{words})\s+(?P<name>[A-Za-z_]\w*)\s*(?P<rest>.*)$", re.S)

    def run(self) -> None:
        self.file = self.facts.file()
        self.region(0, len(self.source.code), [], self.file, None)

    def doc(self, at: int) -> str | None:
        found = self.source.doc(at)
        return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", found)).strip() or None if found and not self.java else found

    def region(self, at: int, end: int, chain: list[str], parent: str, owner: str | None) -> None:
        code, source = self.source.code, self.source
        while at < end:
            if code[at].isspace() or code[at] in ";}":
                at += 1
                continue
            if not self.java and code[at] == "#":
                at = code.find("\n", at) if 0 < code.find("\n", at) < end else end
                continue
            begin = at
            place = self.modifiers.match(code, at, end).end()
            while place < end and code[place] not in ";{}" and not (code[place : place + 2] == "=>" and not self.java):
                place = source.close.get(place, place) + 1 if code[place] in "([" else place + 1
            if place >= end or code[place] == "}":
                at = max(place, at + 1)
                continue
            arrow = code[place : place + 2] == "=>"
            body = (place + 1, source.close[place]) if code[place] == "{" and place in source.close else None
            if arrow:
                stop = source.statement_end(place + 2, end)
                while code[stop - 1] != ";" and stop < end and code[stop:end].lstrip()[:1] not in ("", "}"):
                    stop = source.statement_end(stop, end)
                body = (place + 2, stop)
            head, initial = code[begin:place], None
            if body and not arrow and "=" in (plain := re.sub(r"\([^()]*\)|\[[^\]]*\]", "", head)) and not re.search(r"\b(class|interface|enum|record|struct)\b", plain):
                stop, initial = source.statement_end(body[1] + 1, end), body
                while code[stop - 1] != ";" and stop < end:
                    stop = source.statement_end(stop, end)
                body = None
            elif not arrow:
                stop = body[1] + 1 if body else place + 1
                if body and not self.java and code[stop:end].lstrip().startswith("=") and "(" not in head:  # a property's first value
                    stop = source.statement_end(stop, end)
            nested = self.statement(begin, head, body, stop, chain, parent, owner, arrow)
            if nested:  # a file's namespace holds what follows
                self.region(stop, end, *nested, None)
                return
            at = stop

    def statement(self, begin: int, head: str, body: tuple[int, int] | None, stop: int, chain: list[str], parent: str, owner: str | None, arrow: bool) -> tuple | None:
        facts, code = self.facts, self.source.code
        modifiers = self.modifiers.match(head).group().strip()
        bare = head[self.modifiers.match(head).end() :].strip()
        doc = self.doc(begin)
        common = {"doc_summary": doc, "modifiers": " ".join(modifiers.split()) or None, "visibility": visibility(modifiers)}
        if self.java and (m := re.match(r"package\s+([\w.]+)", bare)):
            facts.node("package", m[1], chain, begin, stop, parent, doc_summary=doc)
        elif self.java and (m := re.match(r"import\s+(?:static\s+)?([\w.*]+)", bare)):
            facts.seek(parent, last(m[1], "."), "imports", m[1])
        elif not self.java and (m := re.match(r"namespace\s+([\w.]+)", bare)):
            made = facts.node("namespace", m[1], chain, begin, stop, parent, doc_summary=doc)
            if not body:
                return [*chain, m[1]], made
            self.region(*body, [*chain, m[1]], made, None)
        elif not self.java and (m := re.match(r"(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)", bare)) and not body and owner is None:
            facts.seek(parent, last(m[1], "."), "imports", bare)
        elif m := self.declared.match(bare):
            self.type(m, begin, body, stop, chain, parent, common)
        elif not self.java and (m := re.match(r"delegate\s+.*?(\w+)\s*(?:<[^>]*>)?\s*\(", bare, re.S)):
            facts.node("type", m[1], chain, begin, stop, parent, **common)
        elif owner is not None:
            self.member(bare, modifiers, begin, body, stop, chain, parent, owner, arrow, common)
        return None

    def type(self, m: re.Match, begin: int, body: tuple[int, int] | None, stop: int, chain: list[str], parent: str, common: dict) -> None:
        facts, code = self.facts, self.source.code
        word, name, rest = m["word"].split()[0], m["name"], m["rest"]
        header = re.match(r"(?:<[^({]*?>)?\s*(\((?P<of>.*?)\))?", rest, re.S) if word == "record" or not self.java else None
        made = facts.node(self.kinds[word], name, chain, begin, stop, parent, **common)
        inside = [*chain, name]
        if header and header["of"]:
            for part in parts(header["of"]):
                if c := re.match(r"(?:@\w+\s+|\[[^\]]*\]\s*)*(?P<type>.+?)\s+(?P<name>\w+)\s*(?:=.*)?$", part, re.S):
                    facts.node("field", c["name"], inside, begin, stop, made, type=c["type"])
        if self.java:
            for keyword, kind in (("extends", "extends"), ("implements", "implements")):
                if c := re.search(rf"\b{keyword}\b(.*?)(?=\b(?:extends|implements|permits)\b|$)", rest, re.S):
                    for base in parts(c[1]):
                        facts.seek(made, base.split("<")[0], kind, base)
        elif c := re.search(r"(?:^|[\s)>]):(?!:)(.*?)(?=\bwhere\b|$)", rest, re.S):
            for base in parts(c[1]):
                facts.seek(made, last(base.split("<")[0].split("(")[0], "."), "extends", base)
        if not body:
            return
        at = body[0]
        if word == "enum":
            cut = self.source.flat(*body)
            end = cut.find(";", at)
            end = end if end >= 0 else body[1]
            flat = re.sub(r"\([^()]*\)", lambda x: " " * len(x.group()), cut[at:end])
            for piece in re.finditer(r"[^,]+", flat):
                c = re.match(r"\s*(?:@\w+\s*|\[[^\]]*\]\s*)*([A-Za-z_]\w*)", piece.group())
                if c:
                    where = at + piece.start() + c.start(1)
                    facts.node("constant", c[1], inside, where, where + len(c[1]), made, doc_summary=self.doc(where))
            at = min(end + 1, body[1])
        self.region(at, body[1], inside, made, name if self.kinds[word] != "interface" or not self.java else f"interface {name}")

    def member(self, bare: str, modifiers: str, begin: int, body: tuple[int, int] | None, stop: int, chain: list[str], parent: str, owner: str, arrow: bool, common: dict) -> None:
        facts = self.facts
        before = re.split(r"=(?![=>])", bare)[0]
        called = re.match(r"(?:<[^(]*?>\s*)?(?P<type>[\w.<>\[\],?\s&:*]*?)\s*(?P<name>~?[A-Za-z_][\w.]*)\s*(?:<[^(]*>)?\s*(?P<params>\(.*\))", before, re.S)
        if called and "(" in before:
            name, result = last(called["name"], "."), called["type"].strip()
            kind = "method" if result or name.startswith("~") else "constructor"
            made = facts.node(kind, name, chain, begin, stop, parent, **common, parameters=called["params"], return_type=result)
            self.types(f"{result} {called['params']}", made)
            if body:
                self.references(*body, made)
            return
        if not self.java and (body is not None) and (m := re.match(r"(?P<type>.+?)\s+(?P<name>[\w.]+)\s*$|(?P<index>.+?)\s+this\s*\[", bare, re.S)):
            made = facts.node("property", last(m["name"], ".") if m["name"] else "this", chain, begin, stop, parent, **common, type=(m["type"] or m["index"]).strip())
            self.references(*body, made)
            return
        m = re.match(r"(?P<type>[\w.]+(?:\s*<.*?>+)?(?:\s*\[[\s,]*\])*\??)\s+(?P<names>[A-Za-z_].*)$", bare, re.S)
        if not m or body:
            return
        fixed = re.search(r"\bconst\b", modifiers) if not self.java else owner.startswith("interface ") or re.search(r"\bstatic\b", modifiers) and re.search(r"\bfinal\b", modifiers)
        for piece in parts(m["names"]):
            if n := re.match(r"[A-Za-z_]\w*", piece):
                made = facts.node("constant" if fixed else "field", n.group(), chain, begin, stop, parent, **common, type=m["type"])
                self.types(m["type"], made)
                if "=" in piece:
                    for x in MADE.finditer(piece):
                        self.instance(x, made)

    def types(self, text: str, made: str) -> None:
        """Types that are named: capitalised in Java, generic ones in C#."""
        for m in re.finditer(r"\b[A-Z]\w*\b" if self.java else r"\b([A-Za-z_]\w*)(?=\s*<)", text):
            if m.group() not in self.builtin:
                self.facts.seek(made, m.group(), "has_type")

    def instance(self, m: re.Match, made: str) -> None:
        name = last(m["type"], ".")
        if name not in self.builtin:
            self.facts.seek(made, name, "instantiates", f"new {m['type']}(...)")

    def references(self, start: int, end: int, made: str) -> None:
        body = self.source.code[start:end]
        for m in CALL.finditer(body):
            if m["name"] not in WORDS and not re.search(r"\bnew\s+[\w.]*$", body[: m.start("name")][-80:]):
                self.facts.seek(made, m["name"], "calls", "".join((m["on"] + m["name"]).split()))
        for m in MADE.finditer(body):
            self.instance(m, made)
        local = r"(?:^|[;{}(])\s*(?:final\s+)?([A-Z]\w*(?:<[^;{}()]*>)?)(?:\[\])*\s+\w+\s*[=;:,)]|\bnew\s+([A-Z]\w*)" if self.java else r"([A-Za-z_]\w*<[^;{}()]*>)"
        for m in re.finditer(local, body):
            self.types(next(x for x in m.groups() if x), made)
