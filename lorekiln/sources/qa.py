"""Question sets: ground truth as JSON, and multi-hop questions turned into linked notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Field names of the two JSON formats.
GROUND_TRUTH = (
    "id string, category string, query string, expectedFiles array<string>, expectedEntities array<string>, expectedPath array<string>, "
    "expectedOwner string, expectedConflicts array<string>, targetEntity string, description string"
)
QUESTIONS = "_id string, question string, answer string, type string, level string, supporting_facts array<array<string>>, context array<struct<title:string,sentences:array<string>>>"


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ground-truth items; missing fields are null."""
    return spark.read.schema(GROUND_TRUTH).json(path, multiLine=True)


def clean_title(title: Column) -> Column:
    """Letters, numbers, blanks, ``_`` and ``-`` of a title, blanks joined by ``_``."""
    return F.regexp_replace(F.trim(F.regexp_replace(title, r"[^\p{L}\p{N}\s_-]", "")), r"\s+", "_")


def question_notes(questions: DataFrame, max_samples: int = 100) -> DataFrame:
    """(path, content): a note for each passage of the first ``max_samples`` questions (a sampling feature).

    ``questions`` has n (its place), and context. A note references the question's other passages. Notes of one
    file name come once, the first.
    """
    rows = questions.filter(F.col("n") < max_samples).select("n", "context", F.posexplode("context").alias("at", "c"))
    name, plain = clean_title(F.col("c.title")), F.trim(F.regexp_replace("c.title", r"[^\p{L}\p{N}\s_-]", ""))
    others = F.transform(F.filter("context", lambda o: o["title"] != F.col("c.title")), lambda o: clean_title(o["title"]))
    stated = F.array_join(F.transform(others, lambda o: F.concat(F.lit("  - "), o)), "\n")
    linked = F.array_join(F.transform(others, lambda o: F.concat(F.lit("- [["), o, F.lit("]]"))), "\n")
    head = F.concat(F.lit("---\nid: "), name, F.lit("\ntitle: "), plain, F.lit("\ntype: document\nreferences:\n"), stated, F.lit("\n---\n\n# "), plain)
    content = F.concat(head, F.lit("\n\n"), F.array_join("c.sentences", " "), F.lit("\n\n## Related\n"), linked, F.lit("\n"))
    notes = rows.select(F.concat(name, F.lit(".md")).alias("path"), content.alias("content"), "n", "at")
    first = F.row_number().over(Window.partitionBy("path").orderBy("n", "at"))
    return notes.withColumn("r", first).filter("r = 1").select("path", "content")


def question_truth(questions: DataFrame, max_samples: int = 100) -> DataFrame:
    """The ground-truth items, in the fields of ``read_ground_truth``, of the first ``max_samples`` questions.

    Expected are the notes of the passages that a question's facts come from, in the order of their first mention; a
    bridge question counts as multi_hop, any other as single_hop. ``questions`` has n and the fields of ``QUESTIONS``.
    """
    titles = F.array_distinct(F.transform("supporting_facts", lambda f: f[0]))
    rows = questions.filter(F.col("n") < max_samples)
    fields = {
        "id": F.col("_id"),
        "category": F.when(F.col("type") == "bridge", "multi_hop").otherwise("single_hop"),
        "query": F.col("question"),
        "expectedFiles": F.transform(titles, lambda t: F.concat(clean_title(t), F.lit(".md"))),
        "description": F.col("answer"),
    }
    kinds = dict(part.strip().split(" ", 1) for part in GROUND_TRUTH.split(", "))
    return rows.select(*[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])
