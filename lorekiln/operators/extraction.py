"""Entities and links from notes: frontmatter, wikilinks and relative Markdown links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import basename, normalized_name, trimmed

# Frontmatter fields that name links, with the link's type and weight.
FIELD_EDGES = (("depends_on", "DEPENDS_ON", 1.0), ("implements", "IMPLEMENTS", 0.9), ("supersedes", "SUPERSEDES", 1.0), ("conflicts_with", "CONFLICTS_WITH", 0.8), ("references", "REFERENCES", 0.6))
OWNER_EDGE = ("owner", "OWNED_BY", 1.0)
METADATA = ("title", "status", "version", "tags", "owner", "description", "team")
ENTITY_TYPES = ("document", "service", "api", "schema", "team", "concept")
PATH_TYPES = (("api", ("/api/", "openapi", "swagger")), ("service", ("/service/", "/svc/")), ("schema", ("/schema/", "/db/", "/database/")), ("team", ("/team/", "/owner/")))
# Patterns of frontmatter, wikilinks and links to notes.
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)"
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
NOTE_LINK = r"(?i)\[[^\]]+\]\((?!https?://)([^)]+\.(?:md|txt))\)"


INLINE_ITEM = r"""\s*"[^"]*"\s*|\s*'[^']*'\s*|[^,]+"""
#: Plain scalars that are numbers or truth values.
NUMBER, TRUTH = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?$", r"(?i)^(?:true|false)$"


def frontmatter(text: Column) -> Column:
    """The block between the opening and closing dashes, without them; empty if there is none."""
    return F.coalesce(F.regexp_extract(text, FRONTMATTER, 1), F.lit(""))


def body(text: Column) -> Column:
    """The text behind the frontmatter."""
    return F.regexp_replace(text, FRONTMATTER, "")


def field(block: Column, key: str) -> Column:
    """The raw value of a top-level key, list lines included; empty if it is missing."""
    return F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\r\n]*(?:\r?\n[ \t]*- [^\r\n]*)*)", 1))


def values(raw: Column) -> Column:
    """Scalar, ``[a, b]`` or ``- a`` lines as an array, quotes and blanks removed; empty values dropped."""
    # a comma inside quotes separates nothing
    inline = F.regexp_extract_all(F.regexp_replace(raw, r"^\[|\]$", ""), F.lit(INLINE_ITEM), F.lit(0))
    lines = F.split(raw, r"(?:^|\r?\n)[ \t]*- ")
    split = F.when(raw.startswith("["), inline).when(raw.rlike(r"(^|\n)[ \t]*- "), lines).otherwise(F.array(raw))
    return F.filter(F.transform(split, unquoted), lambda v: v != "")


def unquoted(v: Column) -> Column:
    return F.regexp_replace(trimmed(v), r"""^["']|["']$""", "")


def scalar(block: Column, key: str) -> Column:
    """First value of a key, or null."""
    return F.get(values(field(block, key)), 0)


def link_targets(content: Column) -> Column:
    """Distinct normalised targets of wikilinks, then of relative note links, in order."""
    wiki = F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1)), normalized_name)
    notes = F.transform(F.regexp_extract_all(content, F.lit(NOTE_LINK), F.lit(1)), lambda p: normalized_name(basename(p)))
    return F.filter(F.array_distinct(F.concat(wiki, notes)), lambda t: t != "")


def entity_name(block: Column, path: Column) -> Column:
    """Name of a note's entity: id, else title, else file name, normalised unless that leaves nothing."""
    raw = F.coalesce(scalar(block, "id"), scalar(block, "title"), basename(path))
    name = normalized_name(raw)
    return F.when(name == "", raw).otherwise(name)


def entity_type(block: Column, path: Column) -> Column:
    """A valid type field, else what the path says, else document."""
    stated, lower = F.lower(F.coalesce(scalar(block, "type"), F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    out = F.when(stated.isin(*ENTITY_TYPES), stated)
    for name, marks in PATH_TYPES:
        test = F.lit(False)
        for m in marks:
            test = test | lower.contains(m)
        out = out.when(test, name)
    return out.otherwise("document")


def metadata(block: Column) -> Column:
    """JSON of the known fields that are present; a list stays a list, plain numbers and truth values stay such."""
    parts = []
    for key in METADATA:
        raw = field(block, key)
        listed = raw.startswith("[") | raw.rlike(r"(^|\n)[ \t]*- ")
        text = F.regexp_replace(F.to_json(F.array(unquoted(raw))), r"^\[|\]$", "")
        # a number without the zeros at its end
        number = F.regexp_replace(F.regexp_replace(raw, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.when(listed, F.to_json(values(raw))).when(raw.rlike(NUMBER), number).when(raw.rlike(TRUTH), F.lower(raw)).otherwise(text)
        parts.append(F.when(raw != "", F.concat(F.lit(f'"{key}":'), text)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def frontmatter_edges(notes: DataFrame) -> DataFrame:
    """(path, nth, target_name, edge_type, weight, confidence, source_type) from notes (path, content).

    A target stated twice comes twice; names that normalise to nothing are dropped.
    """
    block = frontmatter(F.col("content"))
    items = [
        F.transform(values(field(block, key)), _edge(kind, weight, 100_000 * i))
        for i, (key, kind, weight) in enumerate((*FIELD_EDGES, OWNER_EDGE))
    ]
    rows = notes.select("path", F.explode(F.flatten(F.array(*items))).alias("e")).select("path", "e.*")
    return rows.filter("target_name != ''").select("path", "nth", "target_name", "edge_type", "weight", F.lit(1.0).alias("confidence"), F.lit("frontmatter").alias("source_type"))


def _edge(kind: str, weight: float, base: int):
    def made(value: Column, i: Column) -> Column:
        return F.struct(normalized_name(value).alias("target_name"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), (i + base).alias("nth"))

    return made


def note_entities(notes: DataFrame) -> DataFrame:
    """(path, name, type, source, metadata): one entity for each note (path, content)."""
    block = frontmatter(F.col("content"))
    return notes.select("path", entity_name(block, F.col("path")).alias("name"), entity_type(block, F.col("path")).alias("type"), F.lit("frontmatter").alias("source"), metadata(block).alias("metadata"))


def note_edges(notes: DataFrame) -> DataFrame:
    """Frontmatter links, then wikilinks to other names that no frontmatter link of the note has.

    Same columns as ``frontmatter_edges``. Null contents give no links; all work stays in the row, so nothing is
    shuffled.
    """
    block = frontmatter(F.col("content"))
    stated = F.flatten(F.array(*[F.transform(values(field(block, key)), normalized_name) for key, _, _ in (*FIELD_EDGES, OWNER_EDGE)]))
    own = F.lower(entity_name(block, F.col("path")))
    free = F.filter(link_targets(F.col("content")), lambda t: (t != own) & ~F.array_contains(stated, t))
    wiki = notes.select("path", F.posexplode(free).alias("nth", "target_name"))
    wiki = wiki.select("path", (F.col("nth") + 1_000_000).alias("nth"), "target_name", F.lit("REFERENCES").alias("edge_type"), F.lit(0.7).alias("weight"), F.lit(0.9).alias("confidence"), F.lit("wikilink").alias("source_type"))
    return frontmatter_edges(notes).unionByName(wiki)
