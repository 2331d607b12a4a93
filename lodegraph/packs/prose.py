"""Documents: headings, their sections, and links between documents."""

from __future__ import annotations

import re

from lodegraph.packs.facts import Facts

SUFFIXES = (".md", ".markdown", ".txt")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
LINK = re.compile(r"\[[^\]]*\]\(([^)]*)\)")


def accepts(path: str, sample: str) -> bool:
    return path.endswith(SUFFIXES)


def links_within(destination: str) -> bool:
    """Whether a link leads to a document: a relative path, or Markdown, and no address."""
    return (destination.startswith(("./", "../")) or destination.endswith(".md") or ".md#" in destination) and not destination.startswith(("http://", "https://"))


def extract(facts: Facts) -> None:
    """Each heading gives a heading and a section; the section contains what follows until one of its level or above."""
    stack = [(0, facts.file("document"), "")]
    at, fence, before = 0, None, None
    for line in facts.text.split("\n"):
        start, at, bare = at, at + len(line) + 1, line.rstrip("\r")
        mark = re.match(r" {0,3}(```+|~~~+)", bare)
        if fence or mark:
            fence = None if fence and mark and mark.group(1).startswith(fence) else fence or mark.group(1)
            before = None
            continue
        level, title, begin = 0, "", start
        if m := ATX.match(bare):
            level, title = len(m.group(1)), (m.group(2) or "").strip()
        elif before and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", bare)):
            level, title, begin = (1 if m.group(1)[0] == "=" else 2), before[1], before[0]
        before = (start, bare.strip()) if bare.strip() and not level and not re.match(r"\s*(>|[-*+] |\d+[.)] |\|)", bare) else None
        if level and title:
            while len(stack) > 1 and stack[-1][0] >= level:
                stack.pop()
            chain, parent = [name for _, _, name in stack[1:]], stack[-1][1]
            end = start + len(bare)
            facts.node("heading", title, chain, begin, end, parent, title, level=str(level))
            stack.append((level, facts.node("section", title, chain, begin, end, parent, f"Section: {title}", level=str(level)), title))
        for m in LINK.finditer(bare):
            destination = m.group(1).strip()
            if links_within(destination):
                facts.seek(stack[-1][1], destination, "links_to", destination)
