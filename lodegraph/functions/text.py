"""Text functions: redaction, previews, numbered lines, headings and links. All are JVM-side Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose values search previews hide, and those that context snippets hide.
PREVIEW_KEYS = ("api_key", "secret", "password", "token", "auth")
CONTEXT_KEYS = ("api_key", "access_key", "credential", "private_key", "secret", "password", "token", "auth", "bearer")
LINK = r"\[[^\]]*\]\(([^)]*)\)"


def redact_preview(line: Column) -> Column:
    """If a key occurs, what follows the line's first '=' (else ':') is hidden."""
    has = F.lower(line).rlike("|".join(PREVIEW_KEYS))
    cut = F.when(line.contains("="), F.concat(F.substring_index(line, "=", 1), F.lit("= [REDACTED]"))).when(line.contains(":"), F.concat(F.substring_index(line, ":", 1), F.lit(": [REDACTED]"))).otherwise(line)
    return F.when(has, cut).otherwise(line)


def redact_lines(text: Column) -> Column:
    """Each line by itself: what follows the first '=' or ':' after its earliest key is hidden."""
    pattern = "(?i)^(.*?(?:" + "|".join(CONTEXT_KEYS) + ")[^=:]*[=:]).*$"
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, pattern, "$1 [REDACTED]")), "\n")


def numbered(line: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), " "), F.lit(": "), line)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def identifier_words(name: Column) -> Column:
    """camelCase, snake_case and digits apart."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Za-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a byte offset; null beyond the content."""
    before = _before(content, offset)
    return F.when((offset >= 0) & (offset <= F.octet_length(content)), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(content: Column, offset: Column) -> Column:
    """1-based column, in characters, of a byte offset; null beyond the content."""
    return F.when((offset >= 0) & (offset <= F.octet_length(content)), F.length(F.substring_index(_before(content, offset), "\n", -1)) + 1).cast("long")


def _before(content: Column, offset: Column) -> Column:
    return F.decode(F.substring(F.encode(content, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")


def number_list(text: Column) -> Column:
    """The list of whole numbers between the first [ and the last ] of a text; null where that is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<int>")


def as_json(value: Column) -> Column:
    return F.to_json(value)


def from_range_json(text: Column) -> Column:
    """A range as JSON, as other tools keep it, in this one's shape."""
    from lodegraph.model import RANGE

    got = F.from_json(text, "span struct<start:bigint,`end`:bigint>, start struct<line:int,column:int>, `end` struct<line:int,column:int>")
    return F.when(got.isNotNull(), F.struct(got["span"]["start"], got["span"]["end"], got["start"]["line"], got["start"]["column"], got["end"]["line"], got["end"]["column"])).cast(RANGE)


def version_order(version: Column) -> Column:
    """Versions of numbers and points as arrays that sort by number; what follows a - or + doesn't count."""
    return F.transform(F.split(F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
