"""What the packs of brace languages share: blanked comments and strings, matched brackets, bodies, doc comments."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
QUOTED = r'"(?:\\.|[^"\\\n])*"'
LETTER = r"'(?:\\[^\n']*|[^'\\\n])'"
#: Comments and strings by language; the first group is what a comment is.
LEXICAL = {
    "rust": re.compile(rf'({SLASHES})|b?r(?P<h>#*)"[\s\S]*?"(?P=h)|"(?:\\[\s\S]|[^"\\])*"|{LETTER}'),
    "script": re.compile(rf"({SLASHES})|{QUOTED}|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`"),
    "go": re.compile(rf"({SLASHES})|{QUOTED}|`[^`]*`|{LETTER}"),
    "c": re.compile(rf'({SLASHES})|R"(?P<h>[^(\s]*)\([\s\S]*?\)(?P=h)"|{QUOTED}|{LETTER}'),
    "java": re.compile(rf'({SLASHES})|"""[\s\S]*?"""|{QUOTED}|{LETTER}'),
    "csharp": re.compile(rf'({SLASHES})|\$?"""[\s\S]*?"""|(?:\$?@|@\$)"(?:[^"]|"")*"|\$?{QUOTED}|{LETTER}'),
}
SPACES = re.compile(r"[^\n]")


class Source:
    def __init__(self, text: str, lexical: str):
        self.text, self.comments = text, []
        blank = []
        at = 0
        for m in LEXICAL[lexical].finditer(text):
            if m.group(1) is not None:
                self.comments.append((m.start(), m.end()))
            blank += [text[at : m.start()], SPACES.sub(" ", m.group())]
            at = m.end()
        self.code = "".join([*blank, text[at:]])

    @cached_property
    def close(self) -> dict[int, int]:
        """Places of brackets' partners; those without one have none."""
        out, open_ = {}, []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m.group()
            if c in "([{":
                open_.append((c, m.start()))
            else:
                while open_ and open_[-1][0] != pairs[c]:
                    open_.pop()
                if open_:
                    out[open_.pop()[1]] = m.start()
        return out

    def body(self, at: int, stop: int | None = None) -> tuple[int, int] | None:
        """(start, end) inside the braces that open at or after `at` and before a semicolon at the same level."""
        stop = len(self.code) if stop is None else stop
        while at < stop:
            c = self.code[at]
            if c == "{":
                return (at + 1, self.close[at]) if at in self.close else None
            if c == ";":
                return None
            at = self.close.get(at, at) + 1 if c in "([" else at + 1
        return None

    def flat(self, start: int, end: int) -> str:
        """The code from start to end, what is inside braces blanked. Offsets stay."""
        out, at = [], start
        for m in re.finditer(r"\{", self.code[start:end]):
            place = start + m.start()
            if place >= at and (shut := self.close.get(place)):
                out += [self.code[at : place + 1], " " * (min(shut, end) - place - 1)]
                at = min(shut, end)
        return " " * start + "".join([*out, self.code[at:end]])

    def statement_end(self, at: int, end: int) -> int:
        """Place after the semicolon or the body that ends a statement which begins at `at`."""
        while at < end:
            c = self.code[at]
            if c == ";":
                return at + 1
            if c in "([{":
                shut = self.close.get(at)
                if shut is None:
                    return end
                if c == "{":
                    return shut + 1
                at = shut
            at += 1
        return end

    def comment_before(self, at: int) -> list[str]:
        """Comments right before a place, with nothing but white space between; first to last."""
        found = []
        k = bisect_right(self.comments, (at, 0)) - 1
        while k >= 0 and self.comments[k][1] <= at and not self.code[self.comments[k][1] : at].strip():
            start, end = self.comments[k]
            found.append(self.text[start:end].strip())
            at, k = start, k - 1
        return found[::-1]

    def doc(self, at: int) -> str | None:
        """Summary from the comments before a place: lines without marks, joined by blanks."""
        lines = []
        for c in self.comment_before(at):
            inside = c[2:-2] if c.startswith("/*") else c.lstrip("/")
            lines += [x.strip().lstrip("*").strip() for x in inside.splitlines()]
        return " ".join(x for x in lines if x) or None


def last(name: str, separator: str) -> str:
    return name.rsplit(separator, 1)[-1].strip()


def parts(text: str) -> list[str]:
    """Text cut at commas outside brackets."""
    out, depth, begin = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(text[begin:k])
            begin = k + 1
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]
