"""Language packs: what turns one file into facts. The first that accepts a file extracts it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lodegraph.packs import c_family, go, managed, prose, python_files, rust, script
from lodegraph.packs.facts import Facts

SAMPLE = 4096


@dataclass(frozen=True)
class Pack:
    """An extension point: `accepts` sees a path and the start of the content, `extract` fills the facts."""

    name: str
    accepts: Callable[[str, str], bool]
    extract: Callable[[Facts], None]
    version: str = "1"


PACKS: tuple[Pack, ...] = (
    Pack("rust", rust.accepts, rust.extract),
    Pack("typescript", script.accepts, script.extract),
    Pack("python", python_files.accepts, python_files.extract),
    Pack("markdown", prose.accepts, prose.extract),
    Pack("go", go.accepts, go.extract),
    Pack("c", c_family.accepts_c, c_family.extract_c),
    Pack("cpp", c_family.accepts_plus, c_family.extract_plus),
    Pack("java", managed.accepts_java, managed.extract_java),
    Pack("csharp", managed.accepts_sharp, managed.extract_sharp),
)


def extract(root: str, path: str, content: bytes | str, packs: tuple[Pack, ...] = PACKS) -> Facts | None:
    """The facts of a file, by the first pack that accepts it and doesn't fail; none where there is none."""
    text = content.decode("utf-8", "surrogateescape") if isinstance(content, bytes) else content
    failed: list[str] = []
    for pack in packs:
        if not pack.accepts(path, text[:SAMPLE]):
            continue
        facts = Facts(root, path, text, pack.name, f"{pack.name}_pack", pack.version)
        try:
            pack.extract(facts)
        except Exception as e:  # noqa: BLE001  a pack's failure is the next one's turn, and is told
            failed.append(f"{pack.name}: {type(e).__name__}: {e}")
            continue
        for message in failed:
            facts.diagnostic(message)
        return facts
    return None
