"""String expressions shared by extraction, splitting and retrieval; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the note format.
NAME_EXTENSION = r"(?i)\.(?:md|txt|yaml|yml|json)$"
NAME_SEPARATORS = r"[_/\\]+"
MARKDOWN_IMAGE = r"(?i)!\[([^\n\r]*?)\]\(data:image/[^;]+;base64,[^)]+\)"
HTML_IMAGE = r"""(?i)<img\s+[^>]*src=["']data:image/[^;]+;base64,[^"']+["'][^>]*>"""
SPACE = r"[\s\u00A0\uFEFF\p{Z}]"


def trimmed(c: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalized_name(c: Column) -> Column:
    """Entity name as it is compared: no note extension, separators as dashes, trimmed, lower case."""
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(c, NAME_EXTENSION, ""), NAME_SEPARATORS, "-")))


def without_inline_images(c: Column) -> Column:
    """Inline base64 images replaced by their alternative text or a mark."""
    return F.regexp_replace(F.regexp_replace(c, MARKDOWN_IMAGE, "![$1]"), HTML_IMAGE, "[image]")


def basename(path: Column) -> Column:
    """Last component of a path, without its extension."""
    last = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("bigint")


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, as case-insensitive comparison in the store works."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
