"""Tokens of the full-text index and the query sanitiser."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters that decompose into a base letter and exactly one mark, and their bases."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) and chr(point).islower():
            pairs.append((chr(point), parts[0]))
    return "".join(p for p, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()
MARKS = r"[\u0300-\u036f]"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(c: Column) -> Column:
    """Runs of letters and numbers, lower case, single diacritics folded; null gives an empty array."""
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(F.regexp_replace(c, MARKS, "")), FOLD_FROM, FOLD_TO)).otherwise(F.lower(c))
    return F.coalesce(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_phrases(c: Column) -> Column:
    """What is left of a query after sanitising: its terms, each to be quoted; a term with ``_`` is a phrase."""
    bare = F.regexp_replace(c, r"[^\p{L}\p{N}\s\u00A0\uFEFF\p{Z}_]", " ")
    return F.filter(F.split(bare, r"[\s\u00A0\uFEFF\p{Z}]+"), lambda t: t != "")


def match_expression(c: Column) -> Column:
    """The sanitised query as a match expression: quoted terms joined by OR, empty if none is left."""
    return F.array_join(F.transform(query_phrases(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
