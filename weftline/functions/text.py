"""Line, pattern and source metrics of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of Java sources.
IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*(?:\.\*)?)\s*;"
PACKAGE = r"(?m)^\s*package\s+([A-Za-z_][\w.]*)\s*;"
BRANCH = r"\b(?:if|while|for|do|switch|case|catch)\b|\?|&&|\|\|"
TYPE = r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_]\w*)"
#: Access flags of class files, in the order in which they decide the kind.
FLAGS = ((0x2000, "annotation"), (0x0200, "interface"), (0x4000, "enum"))


def lines(text: Column) -> Column:
    """Lines as a reader counts them: \\r\\n and \\r end lines too, a last newline ends the last line, an empty text has none."""
    t = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "\\n\\z", "")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.expr("array()").cast("array<string>")).otherwise(F.split(t, "\n"))


def line_count(text: Column) -> Column:
    """Without building the lines: newlines, and one if the text does not end in one."""
    t = F.regexp_replace(text, "\\r\\n?", "\n")
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n + F.when(t.endswith("\n"), 0).otherwise(1)).cast("long")


def blank_count(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: F.trim(F.translate(x, "\t\x0b\x0c", "   ")) == "")).cast("long")


def comment_count(text: Column) -> Column:
    """Lines that start with //, /* or *, after white space."""
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"^[ \t\x0b\x0c]*(//|/\*|\*)"))).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """Non-overlapping matches; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def has_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def imports(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMPORT), F.lit(1))


def package_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PACKAGE, 1), F.lit(""))


def declared_types(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TYPE), F.lit(2))


def cyclomatic(text: Column, methods: Column) -> Column:
    """An approximation without a parser: one a method and one a branch word, `?`, `&&` or `||`."""
    return methods + matches(text, BRANCH)


def type_kind(flags: Column, is_record: Column) -> Column:
    """annotation, interface, enum, record or class, by the first flag that is set."""
    out = None
    for bit, kind in FLAGS:
        test = flags.bitwiseAND(bit) != 0
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.when(is_record, "record").otherwise("class")


def java_version(major: Column) -> Column:
    """Of a class file's major number: 1.1 for 45, 1.2 to 1.4, then 5 and up."""
    return F.when(major < 45, None).when(major < 49, F.concat(F.lit("1."), (major - 44).cast("string"))).otherwise((major - 44).cast("string"))
