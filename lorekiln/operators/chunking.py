"""Heading sections and chunks of notes, as expressions inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import SPACE, trimmed, without_inline_images
from lorekiln.operators.extraction import body

MAX_CHARS, OVERLAP_CHARS = 2_800, 400
HEADING = rf"^(#{{1,6}}){SPACE}+([^\r]+)$"


def _sections(lines: Column) -> Column:
    """array<struct<path, content>> from an array of lines; blank sections are left out."""
    marked = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("at"), l.alias("line"))), lambda h: h["line"].startswith("#"))
    heads = F.transform(marked, lambda h: F.struct(h["at"].alias("at"), F.length(F.regexp_extract(h["line"], HEADING, 1)).alias("level"), trimmed(F.regexp_extract(h["line"], HEADING, 2)).alias("title")))
    heads = F.filter(heads, lambda h: h["level"] > 0)
    stack, out = "array<struct<level:int,title:string>>", "array<struct<at:int,path:string>>"
    start = F.struct(F.array().cast(stack).alias("stack"), F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("path"))).cast(out).alias("out"))

    def push(acc: Column, h: Column) -> Column:
        kept = F.concat(F.filter(acc["stack"], lambda s: s["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        path = F.array_join(F.transform(kept, lambda s: s["title"]), " > ")
        return F.struct(kept.cast(stack).alias("stack"), F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), path.alias("path")))).cast(out).alias("out"))

    found = F.aggregate(heads, start, push)["out"]
    ends = F.concat(F.transform(F.slice(found, 2, F.size(lines) + 1), lambda h: h["at"]), F.array(F.size(lines)))
    pieces = F.zip_with(
        found, ends, lambda h, e: F.struct(h["path"].alias("path"), trimmed(F.array_join(F.slice(lines, h["at"] + 2, e - h["at"] - 1), "\n")).alias("content"))
    )
    return F.filter(pieces, lambda p: p["content"] != "")


def heading_sections(text: Column) -> Column:
    """array<struct<path, content>>: the heading path and the trimmed lines below it, one for each heading."""
    # the lambda binds the lines, which would be split again for each heading
    return F.flatten(F.transform(F.array(F.split(body(without_inline_images(text)), r"\r?\n")), _sections))


def split_long(text: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, trim: bool = True) -> Column:
    """array<string>: paragraphs packed up to ``limit``, the tail of a flushed piece carried over.

    A piece may exceed the limit by the overlap and two characters; a paragraph over the limit is sliced at a
    stride of limit - overlap, without carry-over.
    """
    whole, stride = trimmed(text) if trim else text, limit - overlap
    paragraphs = F.filter(F.transform(F.split(whole, rf"\n{SPACE}*\n"), trimmed), lambda p: p != "")

    def slices(p: Column) -> Column:
        last = F.ceil((F.length(p) - overlap) / F.lit(stride)).cast("int") - 1
        cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: trimmed(F.substring(p, i * stride + 1, F.lit(limit))))
        return F.filter(cut, lambda s: s != "")

    def flushed(buf: Column, out: Column) -> Column:
        return F.when(buf == "", out).otherwise(F.concat(out, F.array(trimmed(buf))))

    def step(acc: Column, p: Column) -> Column:
        buf, out = acc["buf"], acc["out"]
        both = F.when(buf == "", p).otherwise(F.concat(buf, F.lit("\n\n"), p))
        tail = trimmed(F.substring(buf, F.greatest(F.length(buf) - overlap, F.lit(0)) + 1, F.lit(overlap)))
        carried = F.when((buf == "") | (tail == ""), p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        long, fits = F.length(p) > limit, F.length(both) <= limit
        return F.struct(
            F.when(long, F.lit("")).when(fits, both).otherwise(carried).alias("buf"),
            F.when(long, F.concat(flushed(buf, out), slices(p))).when(fits, out).otherwise(flushed(buf, out)).alias("out"),
        )

    packed = F.aggregate(paragraphs, F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out")), step, lambda acc: flushed(acc["buf"], acc["out"]))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= limit, F.array(whole)).otherwise(packed)


def chunk_notes(notes: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(path, chunk_index, heading_path, content) of notes (path, content).

    Markdown is cut at headings first; other files are one section without heading. Null contents give no chunks.
    """
    plain = F.array(F.struct(F.lit("").alias("path"), trimmed(without_inline_images(F.col("content"))).alias("content")))
    sections = F.when(F.lower("path").endswith(".txt"), plain).otherwise(heading_sections(F.col("content")))
    pieces = F.flatten(F.transform("sections", lambda s: F.transform(split_long(s["content"], limit, overlap, trim=False), lambda c: F.struct(s["path"].alias("heading_path"), c.alias("content")))))
    rows = notes.filter("content is not null").select("path", sections.alias("sections"))
    return rows.select("path", F.posexplode(pieces).alias("chunk_index", "c")).select("path", "chunk_index", "c.heading_path", "c.content")
