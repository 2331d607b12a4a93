"""Python, by its own parser; a file that does not parse gives its file node and a diagnostic."""

from __future__ import annotations

import ast
import re

from lodegraph.packs.facts import Facts

SUFFIXES = (".py", ".pyi", ".pyw")


def accepts(path: str, sample: str) -> bool:
    return path.endswith(SUFFIXES) or bool(re.match(r"#!.*python", sample.split("\n", 1)[0]))


def extract(facts: Facts) -> None:
    file = facts.file()
    try:
        tree = ast.parse(facts.text)
    except (SyntaxError, ValueError, RecursionError) as e:
        facts.diagnostic(f"not parsed: {e}")
        return
    lines = facts.text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(line: int, column: int) -> int:
        """Character offset of the parser's line and byte column."""
        return starts[line - 1] + len(lines[line - 1].encode("utf-8", "surrogateescape")[:column].decode("utf-8", "replace"))

    def span(node: ast.AST) -> tuple[int, int]:
        return place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)

    def text(node: ast.AST | None) -> str | None:
        return None if node is None else facts.text[slice(*span(node))]

    def visit(body: list, chain: list[str], parent: str) -> None:
        for node in body:
            inside = chain[-1] if chain else ""
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = ("constructor" if node.name in ("__init__", "__new__") else "method") if inside.startswith("class ") else "function"
                made = facts.node(kind, node.name, chain, *span(node), parent, decorators=[text(d) for d in node.decorator_list], is_async="true" if isinstance(node, ast.AsyncFunctionDef) else None, doc_summary=summary(node), return_type=text(node.returns))
                visit(node.body, [*chain, f"fn {node.name}"], made)
            elif isinstance(node, ast.ClassDef):
                made = facts.node("class", node.name, chain, *span(node), parent, decorators=[text(d) for d in node.decorator_list], doc_summary=summary(node))
                for base in node.bases:
                    if isinstance(base, ast.Name | ast.Attribute):
                        facts.seek(made, text(base), "extends", text(base))
                visit(node.body, [*chain, f"class {node.name}"], made)
            elif isinstance(node, ast.TypeAlias):
                facts.node("type", node.name.id, chain, *span(node), parent)
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name) and (target.id == "__all__" or not (target.id.startswith("_") and target.id.endswith("_"))):
                    kind = "field" if inside.startswith("class ") else "constant" if target.id.upper() == target.id and re.search(r"\w", target.id) else "variable"
                    facts.node(kind, target.id, chain, *span(node), parent, type_annotation=text(node.annotation) if isinstance(node, ast.AnnAssign) else None)
            elif isinstance(node, ast.Import):
                for name in node.names:
                    facts.seek(parent, name.name, "imports", text(node))
            elif isinstance(node, ast.ImportFrom):
                for name in node.names:
                    facts.seek(parent, name.name, "imports", text(node))
                facts.seek(parent, node.module or "", "imports", text(node))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    visit(getattr(node, inner, None) or [], chain, parent)
                for case in [*getattr(node, "handlers", []), *getattr(node, "cases", [])]:
                    visit(case.body, chain, parent)

    visit(tree.body, [], file)


def summary(node: ast.AST) -> str | None:
    doc = ast.get_docstring(node)
    return " ".join(x.strip() for x in doc.splitlines() if x.strip()) or None if doc else None
